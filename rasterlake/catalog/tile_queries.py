"""Images as tiles: comparison, reshaping and the transform, over buffers."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.catalog.pixel_queries import (
    _LAB_SQL, _TH, _TM, _TQ, B709_TO_2020, SRGB, sq_pq, sq_psnr, sq_srgb, sq_srgb_inv,
)
from rasterlake.catalog.registry import ORACLE_BODIES as ORACLES
from rasterlake.catalog.registry import query, r6
from rasterlake.functions import color, matrices
from rasterlake.functions.curves import named_curve
from rasterlake.model import PRIMARIES
from rasterlake.operators import gaintiles, halo, tiles, transform
from rasterlake.operators.colorspace import Transform

#: Every third image lost the last line of its frame 1.
_LOST = "asset_id % 3 = 0 and frame = 1 and y0 = 2"


@query("j01_align_buffers", f"""select asset_id, frame, cast(y as int) y0, code, case when not ({_LOST.replace('y0', 'y')}) then code2 end code2 from px8f where x = 5""")
def _(t):
    both = tiles.align(t.ref_tiles, t.enc_tiles.where(f"not ({_LOST})"))
    byte = lambda c: F.ascii(F.decode(F.substring(c, 6, 1), "ISO-8859-1"))
    return both.select("asset_id", "frame", "y0", byte("buf").alias("code"), byte("buf2").alias("code2"))


@query("a01_psnr_bits_buffers", f"""select asset_id, sse, n, {sq_psnr('sse', 'n', 65535)} psnr, 'ok' status from (
    select asset_id, cast(sum(cast((code-code2) as bigint)*257*(code-code2)*257) as bigint) sse, count(*) n from px8f group by asset_id)""")
def _(t):
    return tiles.psnr(*t.wide_tiles).withColumn("psnr", r6("psnr"))


@query("a01_psnr_channels_buffers", f"""select asset_id, sse, n, {sq_psnr('sse', 'n', 255)} psnr, 'ok' status from (
    select asset_id, cast(sum((r%8)*(r%8) + (g%8)*(g%8) + (b%8)*(b%8)) as bigint) sse, 3 * count(*) n from pxrgb group by asset_id)""")
def _(t):
    return tiles.psnr(t.rgb_tiles, _coarse_rgb(t)).withColumn("psnr", r6("psnr"))


def _coarse_rgb(t):
    px = tiles.unpack(t.rgb_tiles).withColumn("code", (F.col("code") - F.col("code") % 8).cast("int"))
    cut = F.when(F.col("y") < 5, 0).otherwise(5)
    packed = px.groupBy("asset_id", "frame", cut.alias("y0")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "channel", "code"))), lambda s: s["code"]).alias("codes"))
    shaped = packed.withColumns({"x0": F.lit(0), "w": F.lit(8), "h": F.when(F.col("y0") == 0, 5).otherwise(3)})
    return tiles.from_arrays(shaped, "codes", 3)


@query("a02_psnr_multiframe_buffers", f"""select asset_id, count(*) frames, case when asset_id % 3 <> 0 then {sq_psnr('sum(sse)', 'sum(n)', 255)} end avg_db,
    case when asset_id % 3 <> 0 then min({sq_psnr('sse', 'n', 255)}) end min_db, case when asset_id % 3 <> 0 then max({sq_psnr('sse', 'n', 255)}) end max_db,
    case when asset_id % 3 = 0 then 'length_mismatch' else 'ok' end status from (
    select asset_id, frame, cast(sum((code-code2)*(code-code2)) as bigint) sse, count(*) n from px8f group by asset_id, frame) group by asset_id""")
def _(t):
    return tiles.psnr_multiframe(t.ref_tiles, t.enc_tiles.where(f"not ({_LOST})")).select(
        "asset_id", "frames", r6("avg_db", "avg_db"), r6("min_db", "min_db"), r6("max_db", "max_db"), "status")


@query("a03_psnr16_buffers", f"""select asset_id, {sq_psnr('sse', 'n', 65535)} psnr from (
    select asset_id, cast(sum(cast((code-code2) as bigint)*257*(code-code2)*257) as bigint) sse, count(*) n from px8f group by asset_id)""")
def _(t):
    return tiles.psnr(*t.wide_tiles).select("asset_id", r6("psnr", "psnr"))


@query("a04_ssim_blocks_buffers", """select asset_id, count(*) blocks, round(avg(s), 6) ssim, case when avg(s) >= 1 then 'inf'::double
    else round(-10e0*log10(1e0-avg(s)), 4) end ssim_db, 'ok' status from (
    select asset_id, ((2e0*ma*mb+6.5025e0)*(2e0*cv+58.5225e0))/((ma*ma+mb*mb+6.5025e0)*(va+vb+58.5225e0)) s from (
    select asset_id, frame, avg(code) ma, avg(code2) mb, var_pop(code) va, var_pop(code2) vb, covar_pop(code, code2) cv
    from px8f group by asset_id, frame, y // 8, x // 8)) group by asset_id""")
def _(t):
    return tiles.ssim(t.ref_tiles, t.enc_tiles).select("asset_id", "blocks", r6("ssim", "ssim"), F.round("ssim_db", 4).alias("ssim_db"), "status")


@query("a05_max_abs_diff_buffers", """select asset_id, case when asset_id % 3 <> 0 then cast(max(abs(code - code2)) as bigint) end max_abs,
    case when asset_id % 3 = 0 then 'length_mismatch' else 'ok' end status from px8f group by asset_id""")
def _(t):
    return tiles.max_abs_diff(t.ref_tiles.where(f"not ({_LOST})"), t.enc_tiles)


@query("a06_delta_e_stats_buffers", f"select asset_id, round(avg(de), 6) mean_de, round(max(de), 6) max_de, 'ok' status from ({_LAB_SQL}) group by asset_id")
def _(t):
    return tiles.delta_e(t.rgb_tiles, _coarse_rgb(t)).select("asset_id", r6("mean_de", "mean_de"), r6("max_de", "max_de"), "status")


@query("j19_stitch_tiles_buffers", """select asset_id, y, x, code from (
    select asset_id, y, x, code from px8) where y < 7 and x < 6 and asset_id % 10 <> 3""")
def _(t):
    numbered = t.square_tiles.withColumn("tile", (F.col("y0") / 2 + F.col("x0") / 4).cast("int")).drop("y0", "x0")
    grid = t.rasters.select(
        "asset_id", F.lit(2).alias("cols"), F.when(F.col("asset_id") % 10 == 3, 3).otherwise(2).alias("rows"),
        F.lit(4).alias("tile_w"), F.lit(4).alias("tile_h"), F.lit(6).alias("out_w"), F.lit(7).alias("out_h"))
    return tiles.unpack(tiles.stitch(numbered, grid)).select("asset_id", "y", "x", F.col("code").cast("int").alias("code"))


@query("j23_plane_identity_buffers", """select asset_id, count(*) samples, count(case when asset_id % 3 = 0 and frame = 1 and y = 2 then 1 end) unmatched,
    count(case when not (asset_id % 3 = 0 and frame = 1 and y = 2) and code <> code2 then 1 end) differing,
    cast(coalesce(max(case when not (asset_id % 3 = 0 and frame = 1 and y = 2) then abs(code - code2) end), 0) as bigint) max_abs,
    case when asset_id % 3 = 0 then 'shape_mismatch' when count(case when code <> code2 then 1 end) > 0 then 'differs' else 'identical' end verdict
    from px8f group by asset_id""")
def _(t):
    return tiles.plane_identity(t.ref_tiles, t.enc_tiles.where(f"not ({_LOST})"))


@query("j24_combine_sample_planes_buffers", """select asset_id, y, x, cast(greatest(0, least(65535, code * 400 + (255 - code) // 16)) as int) sample from px8 where asset_id % 10 <> 3
    union all select distinct asset_id, 0, 0, -16 from px8 where asset_id % 10 = 3""")
def _(t):
    """A missing residual tile leaves the samples of its place out, but says so."""
    residual = tiles.from_arrays(_arrays(t.square_tiles).withColumn("codes", F.transform("codes", lambda c: 255 - c)), "codes")
    lost = (F.col("asset_id") % 10 == 3) & (F.col("x0") == 4)
    got = tiles.combine_planes(t.square_tiles, residual.where(~lost), 400, 16)
    whole = tiles.unpack(got.where(F.col("asset_id") % 10 != 3)).select("asset_id", "y", "x", F.col("code").cast("int").alias("sample"))
    flagged = got.where("status = 'length_mismatch' and buf is null").groupBy("asset_id").agg((-F.count(F.lit(1)) * 8).cast("int").alias("sample"))
    return whole.unionByName(flagged.select("asset_id", F.lit(0).alias("y"), F.lit(0).alias("x"), "sample"))


def _arrays(t):
    """Tiles with their samples as an array again."""
    px = tiles.unpack(t.withColumns({"frame": F.col("y0") * 100 + F.col("x0")}))
    packed = px.groupBy("asset_id", "frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "code"))), lambda s: s["code"]).alias("codes"))
    return packed.select("asset_id", F.lit(0).alias("frame"), F.floor(F.col("frame") / 100).cast("int").alias("y0"), (F.col("frame") % 100).alias("x0"),
                         F.lit(4).alias("w"), F.lit(4).alias("h"), "codes")


@query("j22_same_colour_outliers_buffers", ORACLES["j22_same_colour_outliers"])
def _(t):
    """Tiles of four by four, smaller than the apron, so neighbours come from two tiles away."""
    got = tiles.unpack(halo.same_colour_deviation(t.square_tiles, t.px8.where("code >= 200").select("asset_id", "y", "x")))
    both = got.groupBy("asset_id", "y", "x").agg(F.max(F.when(F.col("channel") == 0, F.col("code"))).cast("long").alias("n"), F.max(F.when(F.col("channel") == 1, F.col("code"))).alias("dev"))
    return both.where("n >= 8").select("asset_id", "y", "x", "n", r6("dev", "dev"))


@query("r05_orient_image_buffers", """select asset_id,
    case turns when 1 then 7 - mx when 2 then 7 - my when 3 then mx else my end y,
    case turns when 1 then my when 2 then 7 - mx when 3 then 7 - my else mx end x, code from (
    select *, case when asset_id % 3 = 0 then 7 - x else x end mx, case when asset_id % 3 = 1 then 7 - y else y end my,
    asset_id % 4 turns from px8)""")
def _(t):
    meta = t.rasters.select(
        "asset_id", F.lit(8).alias("img_w"), F.lit(8).alias("img_h"), (F.col("asset_id") % 3).cast("int").alias("mirror"),
        (F.col("asset_id") % 4).cast("int").alias("turns"))
    return tiles.unpack(tiles.orient(t.square_tiles, meta)).select("asset_id", "y", "x", F.col("code").cast("int").alias("code"))


# --- the transform ---------------------------------------------------------------
_2020_TO_709 = tuple(matrices.between(PRIMARIES["bt2020"], PRIMARIES["bt709"]))
HLG = named_curve("arib-std-b67")
PQ = named_curve("smpte2084")
PLANS = {
    "srgb_pq": Transform(SRGB, PQ, matrix=B709_TO_2020, encode_scale=0.0203, dither=True),
    "pq_srgb": Transform(PQ, SRGB, _2020_TO_709, linear_scale=10000.0 / 203.0, tone="hable", peak_nits=1000.0),
    "hlg_srgb": Transform(HLG, SRGB, _2020_TO_709, src_scene_peak=1000.0, linear_scale=1000.0 / 203.0, gamut_keep=0.8),
}
_PLAN = "case asset_id % 4 when 0 then 'srgb_pq' when 1 then 'pq_srgb' when 2 then 'hlg_srgb' else 'none' end"


def sq_hlg(x):
    return f"(case when {x} <= 0.5 then {x}*{x}/3e0 else (exp(({x}-0.55991073e0)/0.17883277e0)+0.28466892e0)/12e0 end)"


_HEAD = 1000.0 / 203.0


def _hab(x):
    return f"((({x})*(({x})*0.15e0+0.05e0)+0.004e0)/(({x})*(({x})*0.15e0+0.5e0)+0.06e0)-0.02e0/0.30e0)"


_TB = [f"({_2020_TO_709[3 * i]!r}::double*r + {_2020_TO_709[3 * i + 1]!r}::double*g + {_2020_TO_709[3 * i + 2]!r}::double*b)" for i in range(3)]
_L7 = color.LUMA_709
#: The three plans one after the other, as linear light of the target; codes of 16 bits are sixteen-bit quantised formulas.
_LINEAR = f"""p as (select *, {_PLAN} plan from pxrgb),
    a1 as (select asset_id, y, x, {sq_srgb('(r/255e0)')} lr, {sq_srgb('(g/255e0)')} lg, {sq_srgb('(b/255e0)')} lb from p where plan = 'srgb_pq'),
    a as (select asset_id, y, x, {_TM[0]} mr, {_TM[1]} mg, {_TM[2]} mb from a1),
    b1 as (select asset_id, y, x, {sq_pq('(r/255e0)')}*{10000 / 203!r}::double r, {sq_pq('(g/255e0)')}*{10000 / 203!r}::double g, {sq_pq('(b/255e0)')}*{10000 / 203!r}::double b from p where plan = 'pq_srgb'),
    b2 as (select *, greatest(r,g,b) t from b1), b3 as (select *, case when t <= 1e-6 then 1e0 else ({_hab('t')}/{_hab(f'{_HEAD!r}::double')})/t end k from b2),
    b4 as (select asset_id, y, x, r*k r, g*k g, b*k b from b3), b as (select asset_id, y, x, {_TB[0]} r, {_TB[1]} g, {_TB[2]} b from b4),
    c1 as (select asset_id, y, x, {sq_hlg('(r/255e0)')} r, {sq_hlg('(g/255e0)')} g, {sq_hlg('(b/255e0)')} b from p where plan = 'hlg_srgb'),
    c2 as (select *, 0.2627e0*r+0.6780e0*g+0.0593e0*b ys from c1), c3 as (select *, case when ys = 0 then 0e0 else pow(ys, 0.2e0)*{_HEAD!r}::double end k from c2),
    c4 as (select asset_id, y, x, r*k r, g*k g, b*k b from c3), c5 as (select asset_id, y, x, {_TB[0]} r, {_TB[1]} g, {_TB[2]} b from c4),
    l as (select *, {_L7[0]}e0*r+{_L7[1]}e0*g+{_L7[2]}e0*b yy from c5), d as (select *, r-yy dr, g-yy dg, b-yy db from l),
    s1 as (select *, case when dr < 0 then greatest(0e0, r/dr) else 0e0 end sr from d), s2 as (select *, case when dg < 0 then greatest(sr, g/dg) else sr end sg from s1),
    s3 as (select *, case when db < 0 then greatest(sg, b/db) else sg end sb from s2),
    m as (select *, greatest(0e0, case when dr <= 0 then sr else r/dr-1/dr end, case when dg <= 0 then sg else g/dg-1/dg end, case when db <= 0 then sb else b/db-1/db end) lm from s3),
    o as (select asset_id, y, x, mix*(yy-r)+r r, mix*(yy-g)+g g, mix*(yy-b)+b b from (select *, least(greatest(0.8e0*(sb-lm)+lm, 0e0), 1e0) mix from m)),
    c as (select asset_id, y, x, r/greatest(1e0,r,g,b) r, g/greatest(1e0,r,g,b) g, b/greatest(1e0,r,g,b) b from o)"""
_E16 = "cast(floor(least(greatest({v},0e0),1e0)*65535e0+0.5e0) as int)"
_PQ16 = [_E16.format(v=sq_pq_inv_) for sq_pq_inv_ in (
    "case when v <= 0 then 0e0 else pow(({c1}+{c2}*pow(v,{m1}))/(1e0+{c3}*pow(v,{m1})), {m2}) end".format(
        c1=f"{3424 / 4096!r}::double", c2=f"{2413 / 4096 * 32!r}::double", c3=f"{2392 / 4096 * 32!r}::double",
        m1=f"{2610 / 16384!r}::double", m2=f"{2523 / 4096 * 128!r}::double").replace("v", f"least(greatest({c}*0.0203e0,0e0),1e0)") for c in ("mr", "mg", "mb"))]
_SRGB16 = [_E16.format(v=sq_srgb_inv(c)) for c in ("r", "g", "b")]


def _codes(px):
    """r, g, b of a table of samples."""
    return px.groupBy("asset_id", "y", "x").pivot("channel", [0, 1, 2]).agg(F.max("code").cast("int")).select(
        "asset_id", "y", "x", *(F.col(str(i)).alias(c) for i, c in enumerate("rgb")))


@query("r06_by_plan_buffers", f"""with {_LINEAR} select asset_id, y, x, {_TQ[0]} r, {_TQ[1]} g, {_TQ[2]} b from a
    union all select asset_id, y, x, {_TH[0]}, {_TH[1]}, {_TH[2]} from b union all select asset_id, y, x, {_TH[0]}, {_TH[1]}, {_TH[2]} from c""")
def _(t):
    """sRGB, PQ and HLG images in one table, each by its own plan; a fourth of the images names an unknown one."""
    planned = t.rgb_tiles.withColumn("plan", F.expr(_PLAN))
    return _codes(tiles.unpack(transform.transform_tiles(planned, PLANS).where("status = 'ok'")))


@query("r06_by_plan_16_buffers", f"""with {_LINEAR} select asset_id, y, x, {_PQ16[0]} r, {_PQ16[1]} g, {_PQ16[2]} b from a
    union all select asset_id, y, x, {_SRGB16[0]}, {_SRGB16[1]}, {_SRGB16[2]} from b union all select asset_id, y, x, {_SRGB16[0]}, {_SRGB16[1]}, {_SRGB16[2]} from c""")
def _(t):
    planned = t.rgb_tiles.withColumn("plan", F.expr(_PLAN))
    return _codes(tiles.unpack(transform.transform_tiles(planned, PLANS, bits=16).where("status = 'ok'")))


@query("r06_transform_volume_buffers", f"""with px as (select asset_id, cast(pos % 64 as int) x, pos // 64 y, code r, 255 - code g, code // 2 b from text_px),
    l as (select asset_id, y, x, {sq_srgb('(r/255e0)')} lr, {sq_srgb('(g/255e0)')} lg, {sq_srgb('(b/255e0)')} lb from px),
    m as (select asset_id, y, x, {_TM[0]} mr, {_TM[1]} mg, {_TM[2]} mb from l)
    select asset_id, count(*) n, cast(sum({_TQ[0]}) as bigint) r, cast(sum({_TQ[1]}) as bigint) g, cast(sum({_TQ[2]}) as bigint) b from m group by asset_id""")
def _(t):
    done = transform.transform_tiles(t.text_rgb_tiles.withColumn("plan", F.lit("srgb_pq")), PLANS)
    return transform.channel_sums(done).select("asset_id", "n", *(F.get("sums", F.lit(i)).alias(c) for i, c in enumerate("rgb")))


# --- histograms and gain maps ------------------------------------------------------
@query("f12_stride_sample_buffers", """select asset_id, y, x, code from px8 where y < bh(asset_id) and x < bw(asset_id)
    and (y * bw(asset_id) + x) % greatest(1, (bw(asset_id) * bh(asset_id)) // 16) = 0""".replace("bw(asset_id)", "(case asset_id % 3 when 2 then 5 else 8 end)").replace(
        "bh(asset_id)", "(case asset_id % 3 when 0 then 8 when 1 then 6 else 7 end)"))
def _(t):
    """Images of three sizes in one table."""
    got = gaintiles.stride_sample(t.mixed_tiles, t.mixed_sizes, 16)
    return got.select("asset_id", "y", "x", F.get("codes", F.lit(0)).cast("int").alias("code"))


@query("a09_gamut_fit_buffers", ORACLES["a09_gamut_fit"])
def _(t):
    return gaintiles.gamut_fit(t.rgb_tiles).select(
        "asset_id", "samples", r6("floor", "floor"), "above", "outside", r6("worst", "worst"), "status")


def _gain_pairs(t):
    """The pairs of a10: two images to an area, linear light as 64-bit samples, lines of the sides cut alike."""
    def side(name):
        light = F.transform("codes", lambda c: c / 255.0)
        if name == "hdr":
            light = F.transform(light, lambda v: F.least(F.lit(8.0), v * v * 6.0 + 0.01))
        half = t.rasters.select(F.floor(F.col("asset_id") / 2).alias("asset_id"), F.lit(0).alias("frame"), ((F.col("asset_id") % 2) * 8).cast("int").alias("y0"),
                                F.lit(0).alias("x0"), F.lit(8).alias("w"), F.lit(8).alias("h"), light.alias("v"))
        return tiles.from_arrays(half, "v", bits=64)

    return side("hdr"), side("sdr")


@query("a10_gain_range_buffers", ORACLES["a10_gain_range"])
def _(t):
    return gaintiles.gain_range(*_gain_pairs(t)).select(
        "asset_id", "n", "measured", *[r6(c, c) for c in ("low", "high", "abs_min", "abs_max")])


@query("a11_gain_base_class_buffers", ORACLES["a11_gain_base_class"])
def _(t):
    text = t.buffers.select("asset_id", F.lit(0).alias("frame"), F.lit(0).alias("y0"), F.lit(0).alias("x0"), F.octet_length("buf").alias("w"),
                            F.lit(1).alias("h"), F.lit(1).alias("channels"), F.lit(8).alias("bits"), "buf")
    return gaintiles.gain_base_class(text)


@query("r07_compute_gain_map_buffers", ORACLES["r07_compute_gain_map"])
def _(t):
    return tiles.unpack(gaintiles.compute_gain_map(*_gain_pairs(t), 2)).select("asset_id", "y", "x", F.col("code").cast("int").alias("code"))


_MULTI = f"""with v as (select asset_id, y, x, c, {sq_srgb('(code/255e0)')} s, least(8e0, (h/255e0)*(h/255e0)*6e0+0.01e0) h from (
      select asset_id, y, x, 0 c, r code, g h from pxrgb union all select asset_id, y, x, 1, g, b from pxrgb union all select asset_id, y, x, 2, b, r from pxrgb)),
    g as (select asset_id // 2 asset_id, y + (asset_id % 2) * 8 y, x, c, log2((h+0.015625e0)/(s+0.015625e0)) g from v),
    k as (select * from g where g > -10 and g < 10), n as (select asset_id, c, count(*) n from k group by 1, 2),
    lo as (select asset_id, c, min(case when run >= total // 100 then bin end) bin from (select asset_id, c, bin, sum(n) over (partition by asset_id, c order by bin) run,
      cast(sum(n) over (partition by asset_id, c) as bigint) total from (select asset_id, c, least(4095, greatest(0, cast(trunc((g+16e0)/32e0*4096) as int))) bin, count(*) n from k group by 1, 2, 3)) group by 1, 2),
    hi as (select asset_id, c, max(case when run >= greatest(total // 10000, 1) then bin end) bin from (select asset_id, c, bin, sum(n) over (partition by asset_id, c order by bin desc) run,
      cast(sum(n) over (partition by asset_id, c) as bigint) total from (select asset_id, c, least(8191, greatest(0, cast(trunc((g+16e0)/32e0*8192) as int))) bin, count(*) n from k group by 1, 2, 3)) group by 1, 2),
    b as (select asset_id, c, case when n >= 100 then least((lo.bin+0.5e0)*32e0/4096-16e0, 0e0) else 0e0 end low,
      case when n >= 100 then greatest((hi.bin+0.5e0)*32e0/8192-16e0, 0e0) else 0e0 end high from n join lo using (asset_id, c) join hi using (asset_id, c)),
    e as (select asset_id, c, low, case when low = 0 and high <= 0 then 1e0 else high end high from b)
    select asset_id, cast(y // 2 as int) y, cast(x // 2 as int) x, c channel, cast(floor(avg(code)) as int) code from (
      select asset_id, c, y, x, case when high - low <= 0 then 0 else cast(floor((least(greatest(g, low), high)-low)/(high-low)*255e0) as int) end code
      from g join e using (asset_id, c)) group by 1, 2, 3, 4"""


@query("r07_multi_buffers", _MULTI)
def _(t):
    """Three channels with a range each; the SDR side is delivered codes, the HDR side linear light of other channels."""
    half = lambda codes, bits: tiles.from_arrays(t.rasters.select(
        F.floor(F.col("asset_id") / 2).alias("asset_id"), F.lit(0).alias("frame"), ((F.col("asset_id") % 2) * 8).cast("int").alias("y0"), F.lit(0).alias("x0"),
        F.lit(8).alias("w"), F.lit(8).alias("h"), codes.alias("v")), "v", 3, bits)
    at = lambda i, by: F.get("codes", ((i + by) % 64).cast("int"))
    sdr = F.flatten(F.transform("codes", lambda c, i: F.array(c, at(i, 21), at(i, 42))))
    up = lambda c: F.least(F.lit(8.0), (c / 255.0) * (c / 255.0) * 6.0 + 0.01)
    hdr = F.flatten(F.transform("codes", lambda c, i: F.array(up(at(i, 21)), up(at(i, 42)), up(c))))
    return tiles.unpack(gaintiles.compute_gain_map(half(hdr, 64), half(sdr, 8), 2)).select("asset_id", "y", "x", "channel", F.col("code").cast("int").alias("code"))


#: As the long form, with the sizes of three kinds of image.
_MIXED = """with z as (select vec_id asset_id, case vec_id % 3 when 2 then 5 else 8 end bw, case vec_id % 3 when 0 then 8 when 1 then 6 else 7 end bh,
      case vec_id % 3 when 0 then 4 when 1 then 3 else 5 end gw, case vec_id % 3 when 0 then 4 when 1 then 2 else 3 end gh from embeddings),
    g as (select asset_id, y gy, x gx, code/255e0 v from px8 join z using (asset_id) where y < gh and x < gw),
    p as (select asset_id, y, x, code, least(greatest((y+0.5e0)*gh/bh-0.5e0, 0e0), gh-1e0) fy0, least(greatest((x+0.5e0)*gw/bw-0.5e0, 0e0), gw-1e0) fx0, gw, gh
      from px8 join z using (asset_id) where y < bh and x < bw),
    q as (select *, cast(floor(fy0) as int) y0, cast(floor(fx0) as int) x0, fy0-floor(fy0) fy, fx0-floor(fx0) fx from p),
    s as (select q.asset_id, q.y, q.x, q.code, a.v*(1-fx)*(1-fy) + b.v*fx*(1-fy) + c.v*(1-fx)*fy + d.v*fx*fy gain from q
    join g a on a.asset_id=q.asset_id and a.gy=y0 and a.gx=x0 join g b on b.asset_id=q.asset_id and b.gy=y0 and b.gx=least(x0+1,gw-1)
    join g c on c.asset_id=q.asset_id and c.gy=least(y0+1,gh-1) and c.gx=x0 join g d on d.asset_id=q.asset_id and d.gy=least(y0+1,gh-1) and d.gx=least(x0+1,gw-1))"""


def _grid_tiles(t):
    """The grids of _MIXED in tiles of two by two cells."""
    n = F.explode(F.sequence(F.lit(0), F.lit(8))).alias("i")
    cut = t.rasters.join(t.mixed_sizes, "asset_id").select("asset_id", "codes", "gain_w", "gain_h", n).select(
        "asset_id", F.lit(0).alias("frame"), (F.floor(F.col("i") / 3) * 2).cast("int").alias("y0"), (F.col("i") % 3 * 2).alias("x0"), "codes", "gain_w", "gain_h")
    cut = cut.where((F.col("y0") < F.col("gain_h")) & (F.col("x0") < F.col("gain_w"))).withColumns({
        "w": F.least(F.lit(2), F.col("gain_w") - F.col("x0")), "h": F.least(F.lit(2), F.col("gain_h") - F.col("y0"))})
    lines = F.flatten(F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda i: F.slice("codes", (F.col("y0") + i) * 8 + F.col("x0") + 1, F.col("w"))))
    return tiles.from_arrays(cut.withColumn("v", lines), "v")


@query("j18_gain_bilinear_buffers", _MIXED + "select asset_id, y, x, round(gain, 6) gain from s")
def _(t):
    got = gaintiles.upsample(t.mixed_tiles, _grid_tiles(t), t.mixed_sizes)
    return tiles.unpack(got).select("asset_id", "y", "x", r6("code", "gain"))


@query("r08_reconstruct_hdr_buffers", _MIXED + f"""select asset_id, y, x, round(({sq_srgb('(code/255e0)')}+0.015625e0)*pow(2e0, 0e0*(1-g)+iso_max*g)-0.015625e0, 6) hdr from (
    select s.*, m.iso_max, pow(s.gain, 1e0/1.5e0) g from s join gmeta m using (asset_id))""")
def _(t):
    meta = t.gmeta.select("asset_id", F.col("iso_min").alias("low"), F.col("iso_max").alias("high"), F.lit(1.5).alias("gamma"))
    got = gaintiles.reconstruct(t.mixed_tiles, _grid_tiles(t), t.mixed_sizes, meta)
    return tiles.unpack(got).select("asset_id", "y", "x", r6("code", "hdr"))
