"""Pixels: reshapes, alignment, quality, measurement, gain maps, transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.catalog.registry import query, r6
from rasterlake.functions import color, curves, gain, matrices
from rasterlake.functions.curves import named_curve
from rasterlake.model import PRIMARIES
from rasterlake.operators import colorspace, gainmap, measure, ordered, pixels, quality

SRGB = named_curve("iec61966-2-1")


def rgb_columns():
    return tuple(F.col(c) for c in "rgb")


def unit_columns():
    return tuple(F.col(c) / 255.0 for c in "rgb")


P3_TO_2020 = tuple(matrices.between(PRIMARIES["smpte432"], PRIMARIES["bt2020"]))
B709_TO_2020 = tuple(matrices.between(PRIMARIES["bt709"], PRIMARIES["bt2020"]))


def sq(m):
    """Numbers of a matrix as SQL double literals."""
    return [f"({v!r}::double)" for v in m]


def sq_apply(m, r="r", g="g", b="b"):
    c = sq(m)
    return [f"({c[3 * i]}*{r} + {c[3 * i + 1]}*{g} + {c[3 * i + 2]}*{b})" for i in range(3)]


def sq_srgb(x):
    return f"case when {x} < 0.04045e0 then {x}/12.92e0 else pow(({x}+0.055e0)/1.055e0, 2.4e0) end"


def sq_srgb_inv(x):
    return f"case when {x} < {0.04045 / 12.92!r}::double then {x}*12.92e0 else 1.055e0*pow(greatest({x},0e0), {1 / 2.4!r}::double)-0.055e0 end"


M1, M2 = 2610 / 16384, 2523 / 4096 * 128
C1, C2, C3 = 3424 / 4096, 2413 / 4096 * 32, 2392 / 4096 * 32


def sq_pq(x):
    p = f"pow({x}, {1 / M2!r}::double)"
    return f"case when {x} <= 0 then 0e0 else pow(greatest({p}-{C1!r}::double,0e0)/({C2!r}::double-{C3!r}::double*{p}), {1 / M1!r}::double) end"


def sq_pq_inv(x):
    y = f"pow({x}, {M1!r}::double)"
    return f"case when {x} <= 0 then 0e0 else pow(({C1!r}::double+{C2!r}::double*{y})/(1e0+{C3!r}::double*{y}), {M2!r}::double) end"


def sq_psnr(sse, n, peak):
    return f"case when {sse} = 0 then 'inf'::double else round(10e0*log10({peak * peak}e0/({sse}/cast({n} as double))), 6) end"


# --- reshape -------------------------------------------------------------------
@query("r01_unpack_pixels", "select asset_id, pos, y, x, code from px8")
def _(t):
    return t.px8


@query("r01_unpack_bytes", "select code, count(*) n, cast(sum(pos) as bigint) pos_sum, count(distinct asset_id) assets from text_px group by code")
def _(t):
    per = t.text_px.groupBy("code", "asset_id").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("p"))
    return per.groupBy("code").agg(
        F.sum("n").alias("n"), F.sum("p").alias("pos_sum"), F.count(F.lit(1)).alias("assets"))


@query("r02_planar_to_packed", "select asset_id, y, x, r, g, b from pxrgb")
def _(t):
    return pixels.planar_to_packed(pixels.packed_to_planar(t.pxrgb))


@query("r02_packed_to_planar", """select asset_id, y, x, 'r' ch, r v from pxrgb union all select asset_id, y, x, 'g', g from pxrgb
    union all select asset_id, y, x, 'b', b from pxrgb""")
def _(t):
    return pixels.packed_to_planar(t.pxrgb)


@query("r03_split_frames", "select asset_id, frame, count(*) samples, cast(sum(code) as bigint) total from px8f group by asset_id, frame")
def _(t):
    px = pixels.split_frames(t.rasters, "codes", 24, 8)
    return px.groupBy("asset_id", "frame").agg(F.count(F.lit(1)).alias("samples"), F.sum("code").alias("total"))


@query("r05_orient_image", """select asset_id,
    case turns when 1 then 7 - mx when 2 then 7 - my when 3 then mx else my end y,
    case turns when 1 then my when 2 then 7 - mx when 3 then 7 - my else mx end x, code from (
    select *, case when asset_id % 3 = 0 then 7 - x else x end mx, case when asset_id % 3 = 1 then 7 - y else y end my,
    asset_id % 4 turns from px8)""")
def _(t):
    meta = t.rasters.select(
        "asset_id", F.lit(8).alias("w"), F.lit(8).alias("h"), (F.col("asset_id") % 3).cast("int").alias("mirror"),
        (F.col("asset_id") % 4).cast("int").alias("turns"))
    return pixels.orient_image(t.px8.drop("pos"), meta)


@query("c35_orient_xy", """select asset_id, x, y, case when asset_id % 2 = 1 then y else 7 - x end ox,
    case when asset_id % 2 = 1 then 7 - x else 7 - y end oy from px8""")
def _(t):
    from rasterlake.functions.media import orient_xy
    turns = F.when(F.col("asset_id") % 2 == 1, 1).otherwise(2)
    at = orient_xy(F.col("x"), F.col("y"), F.lit(8), F.lit(8), F.lit(-1), turns)
    return t.px8.select("asset_id", "x", "y", at["x"].alias("ox"), at["y"].alias("oy"))


# --- alignment -----------------------------------------------------------------
@query("j01_align_pixels", "select asset_id, frame, y, x, code, code2 from px8f")
def _(t):
    return quality.paired(t.ref, t.enc)


@query("j03_length_mismatch", """select asset_id, frame, n_a, n_b from (
    select asset_id, frame, count(*) n_a, count(case when code > 40 then 1 end) n_b from px8f group by asset_id, frame) where n_a <> n_b""")
def _(t):
    return pixels.length_mismatch(t.ref, t.ref.where("code > 40"))


@query("j19_stitch_tiles", """select asset_id, y, x, code from (
    select asset_id, cast(floor(pos/16/2)*4 + floor((pos%16)/4) as int) y, cast((floor(pos/16)%2)*4 + pos%4 as int) x, code
    from (select asset_id, cast(floor(pos/16) as int) t, pos, code from px8)) where y < 7 and x < 6 and asset_id % 10 <> 3""")
def _(t):
    tiles = t.px8.select(
        "asset_id", F.floor(F.col("pos") / 16).cast("int").alias("tile"),
        F.floor((F.col("pos") % 16) / 4).cast("int").alias("y"), (F.col("pos") % 4).cast("int").alias("x"), "code")
    grid = t.rasters.select(
        "asset_id", F.lit(2).alias("cols"), F.when(F.col("asset_id") % 10 == 3, 3).otherwise(2).alias("rows"),
        F.lit(4).alias("tile_w"), F.lit(4).alias("tile_h"), F.lit(6).alias("out_w"), F.lit(7).alias("out_h"))
    return pixels.stitch_tiles(tiles, grid)


@query("j22_same_colour_outliers", """select a.asset_id, a.y, a.x, count(*) n, round(abs(a.code - median(b.code)), 6) dev
    from px8 a join px8 b on a.asset_id = b.asset_id and abs(a.y - b.y) <= 8 and abs(a.x - b.x) <= 8
    and (a.y - b.y) % 2 = 0 and (a.x - b.x) % 2 = 0 and (a.y <> b.y or a.x <> b.x) and b.code < 200
    group by a.asset_id, a.y, a.x, a.code having count(*) >= 8""")
def _(t):
    out = pixels.same_colour_outliers(t.px8.drop("pos"), t.px8.where("code >= 200"))
    return out.select("asset_id", "y", "x", F.col("n").cast("long").alias("n"), r6("dev", "dev"))


@query("j23_plane_identity", """select asset_id, count(*) samples, count(case when code2 >= 190 then 1 end) unmatched,
    count(case when not (code2 >= 190) and code <> code2 then 1 end) differing,
    cast(coalesce(max(case when not (code2 >= 190) then abs(code - code2) end), 0) as bigint) max_abs,
    case when count(case when code2 >= 190 then 1 end) > 0 then 'shape_mismatch'
    when count(case when code <> code2 then 1 end) > 0 then 'differs' else 'identical' end verdict from px8f group by asset_id""")
def _(t):
    a = t.ref.selectExpr("asset_id", "frame * 8 + y y", "x", "code")
    b = t.enc.where("code < 190").selectExpr("asset_id", "frame * 8 + y y", "x", "code")
    return pixels.plane_identity(a, b)


@query("j24_combine_sample_planes", """select asset_id, y, x, cast(greatest(0, least(65535, code * 400 + (255 - code) // 16)) as int) sample from px8""")
def _(t):
    residual = t.px8.select("asset_id", "y", "x", (F.lit(255) - F.col("code")).alias("code"))
    return pixels.combine_sample_planes(t.px8, residual, 400, 16)


@query("f12_stride_sample", "select asset_id, y, x, code from px8 where (y * 8 + x) % 4 = 0")
def _(t):
    return pixels.stride_sample(t.px8.drop("pos"), 8, target=16).select("asset_id", "y", "x", "code")


# --- quality -------------------------------------------------------------------
@query("a01_psnr", f"""select asset_id, sse, n, {sq_psnr('sse', 'n', 255)} psnr, 'ok' status from (
    select asset_id, cast(sum((code-code2)*(code-code2)) as bigint) sse, count(*) n from px8f group by asset_id)""")
def a01_psnr(t):
    return quality.psnr(t.ref, t.enc).withColumn("psnr", r6("psnr"))


@query("a01_psnr_truncated", f"""select asset_id, case when cut = 0 then sse end sse, n, case when cut = 0 then {sq_psnr('sse', 'n', 255)} end psnr,
    case when cut = 0 then 'ok' else 'length_mismatch' end status from (
    select asset_id, cast(sum((code-code2)*(code-code2)) as bigint) sse, count(*) n, count(case when asset_id % 3 = 0 and frame = 1 and x > 5 then 1 end) cut from px8f group by asset_id)""")
def _(t):
    return quality.psnr(t.ref, t.enc.where("not (asset_id % 3 = 0 and frame = 1 and x > 5)")).withColumn("psnr", r6("psnr"))


@query("a01_psnr_tiles", f"""select asset_id, sse, n, {sq_psnr('sse', 'n', 255)} psnr, 'ok' status from (
    select asset_id, cast(sum((code % 16) * (code % 16)) as bigint) sse, count(*) n from px8 group by asset_id)""")
def _(t):
    tiles = t.rasters.select("asset_id", F.lit(0).alias("tile"), F.col("codes").alias("samples"))
    coarse = tiles.withColumn("samples", F.transform("samples", lambda c: (c - c % 16)))
    return quality.psnr_tiles(tiles, coarse).withColumn("psnr", r6("psnr"))


@query("a01_psnr_buffers", f"""select asset_id, case when asset_id % 7 <> 0 then sse end sse, case when asset_id % 7 <> 0 then n else 0 end n,
    case when asset_id % 7 <> 0 then {sq_psnr('sse', 'n', 255)} end psnr, case when asset_id % 7 <> 0 then 'ok' else 'length_mismatch' end status from (
    select asset_id, count(case when code between 97 and 104 then 1 end) sse, count(*) n from text_px group by asset_id)""")
def _(t):
    # Every seventh image lost its last byte.
    ref = t.buffers.select("asset_id", "part", F.when(F.col("asset_id") % 7 == 0, F.substr("buf", F.lit(1), F.octet_length("buf") - 1)).otherwise(F.col("buf")).alias("buf"))
    enc = t.buffers.select("asset_id", "part", F.col("buf2").alias("buf"))
    return quality.psnr_buffers(ref, enc).withColumn("psnr", r6("psnr"))


@query("a02_psnr_multiframe", f"""select asset_id, count(*) frames, {sq_psnr('sum(sse)', 'sum(n)', 255)} avg_db,
    min({sq_psnr('sse', 'n', 255)}) min_db, max({sq_psnr('sse', 'n', 255)}) max_db, 'ok' status from (
    select asset_id, frame, cast(sum((code-code2)*(code-code2)) as bigint) sse, count(*) n from px8f group by asset_id, frame) group by asset_id""")
def _(t):
    return quality.psnr_multiframe(t.ref, t.enc).select(
        "asset_id", "frames", r6("avg_db", "avg_db"), r6("min_db", "min_db"), r6("max_db", "max_db"), "status")


@query("a03_psnr16", f"""select asset_id, {sq_psnr('sse', 'n', 65535)} psnr from (
    select asset_id, cast(sum(cast((code-code2) as bigint)*257*(code-code2)*257) as bigint) sse, count(*) n from px8f group by asset_id)""")
def _(t):
    wide = [df.withColumn("code", F.col("code") * 257) for df in (t.ref, t.enc)]
    return quality.psnr16(*wide).select("asset_id", r6("psnr", "psnr"))


@query("a04_ssim_blocks", """select asset_id, count(*) blocks, round(avg(s), 6) ssim, case when avg(s) >= 1 then 'inf'::double
    else round(-10e0*log10(1e0-avg(s)), 4) end ssim_db from (
    select asset_id, ((2e0*ma*mb+6.5025e0)*(2e0*cv+58.5225e0))/((ma*ma+mb*mb+6.5025e0)*(va+vb+58.5225e0)) s from (
    select asset_id, frame, avg(code) ma, avg(code2) mb, var_pop(code) va, var_pop(code2) vb, covar_pop(code, code2) cv
    from px8f group by asset_id, frame, y // 8, x // 8)) group by asset_id""")
def _(t):
    return quality.ssim_blocks(t.ref, t.enc).select(
        "asset_id", "blocks", r6("ssim", "ssim"), F.round("ssim_db", 4).alias("ssim_db"))


@query("a05_max_abs_diff", "select asset_id, max(abs(code - code2)) max_abs, 'ok' status from px8f group by asset_id")
def _(t):
    return quality.max_abs_diff(t.ref, t.enc)


_D50 = matrices.colorants_d50(*PRIMARIES["bt709"])


def sq_lab(r, g, b):
    lin = [sq_srgb(f"({c}/255e0)") for c in (r, g, b)]
    x, y, z = sq_apply(_D50, *[f"({v})" for v in lin])

    def f(v):
        return f"(case when {v} > 0.008856e0 then cbrt({v}) else 7.787e0*{v} + 16e0/116e0 end)"

    fx, fy, fz = f(f"({x}/0.9642e0)"), f(f"({y})"), f(f"({z}/0.8249e0)")
    return f"(116e0*{fy}-16e0)", f"(500e0*({fx}-{fy}))", f"(200e0*({fy}-{fz}))"


def sq_de(a, b):
    return "sqrt(" + " + ".join(f"({p}-{q})*({p}-{q})" for p, q in zip(a, b)) + ")"


_LAB_SQL = "select asset_id, {de} de from (select asset_id, {la} from (select *, (r//8)*8 r2, (g//8)*8 g2, (b//8)*8 b2 from pxrgb))".format(
    de=sq_de(("l1", "a1", "b1"), ("l2", "a2", "b2")),
    la=", ".join(f"{e} {n}{i}" for i, rgb in ((1, ("r", "g", "b")), (2, ("r2", "g2", "b2"))) for e, n in zip(sq_lab(*rgb), "lab")))


def _coarse(px):
    return px.select("asset_id", "y", "x", *[(F.col(c) - F.col(c) % 8).alias(c) for c in "rgb"])


@query("a06_delta_e_stats", f"select asset_id, round(avg(de), 6) mean_de, round(max(de), 6) max_de, 'ok' status from ({_LAB_SQL}) group by asset_id")
def _(t):
    return quality.delta_e_stats(t.pxrgb, _coarse(t.pxrgb)).select("asset_id", r6("mean_de", "mean_de"), r6("max_de", "max_de"), "status")


@query("c24_delta_e76", f"select asset_id, round(sum(de), 4) total_de from ({_LAB_SQL}) group by asset_id")
def _(t):
    coarse = tuple(c - c % 8 for c in rgb_columns())
    let = color.Stages(t.pxrgb)
    de = let("de", color.delta_e76(rgb_columns(), coarse, _D50, let))
    return let.df.select("asset_id", de.alias("de")).groupBy("asset_id").agg(F.round(F.sum("de"), 4).alias("total_de"))


@query("t03_worst_frames", f"""select asset_id, frame, db, rk from (select *, cast(row_number() over (partition by asset_id order by db, frame) as int) rk from (
    select asset_id, frame, {sq_psnr('sum((code-code2)*(code-code2))', 'count(*)', 255)} db from px8f group by asset_id, frame)) where rk <= 2""")
def _(t):
    frames = quality.frame_errors(quality.paired(t.ref, t.enc)).select(
        "asset_id", "frame", r6(quality.psnr_of(F.col("sse"), F.col("n"), 255.0), "db"))
    return quality.worst_frames(frames, 2)


# --- measurement ---------------------------------------------------------------
@query("a07_content_peak_nits", f"""select asset_id, round(m, 6) measured, round(least(greatest(m, 203e0), 1000e0), 6) applied from (
    select asset_id, max(v)*2.5e0*203e0 m from (select asset_id, {sq_srgb('(greatest(r,g,b)/255e0)')} v from pxrgb) group by asset_id)""")
def _(t):
    return measure.content_peak_nits(t.pxrgb, 255.0, SRGB, 1000.0, scale=2.5).select(
        "asset_id", r6("measured", "measured"), r6("applied", "applied"))


@query("a08_max_nits", f"select asset_id, round(max({sq_pq('(greatest(r,g,b)/255e0)')})*203e0, 6) max_nits from pxrgb group by asset_id")
def _(t):
    return measure.max_nits(t.pxrgb, 255.0, named_curve("smpte2084")).select("asset_id", r6("max_nits", "max_nits"))


_FIT = sq_apply(color.M_2020_TO_709)


@query("a09_gamut_fit", f"""with p as (select asset_id, r/255e0 r, g/255e0 g, b/255e0 b, 0.2627e0*(r/255e0)+0.6780e0*(g/255e0)+0.0593e0*(b/255e0) lum from pxrgb),
    h as (select asset_id, least(65535, greatest(0, cast(floor(lum*65535e0+0.5e0) as int))) bin, count(*) n from p group by 1, 2),
    c as (select asset_id, bin, sum(n) over (partition by asset_id order by bin) run, sum(n) over (partition by asset_id) total from h),
    f as (select asset_id, max(total) total, greatest(1e0/65535e0, 0.25e0*min(case when run >= greatest(1, least(ceil(total*0.999e0), total-1)) then bin end)/65535e0) fl from c group by 1),
    s as (select asset_id, cast(max(total) as bigint) samples, max(fl) as floor_v, count(case when lum >= fl then 1 end) above,
    count(case when lum >= fl and lo < -1e-4 then 1 end) outside, coalesce(min(case when lum >= fl and lo < -1e-4 then lo end), 0e0) worst
    from (select p.*, f.total, f.fl, least({_FIT[0]}, {_FIT[1]}, {_FIT[2]}) lo from p join f using (asset_id)) group by 1)
    select asset_id, samples, round(floor_v, 6) "floor", above, outside, round(worst, 6) worst,
    case when above = 0 then 'unmeasurable' when cast(outside as double)/above < 0.001e0 and worst > -0.005e0 then 'fits' else 'exceeds' end status from s""")
def _(t):
    return measure.gamut_fit(t.pxrgb, 255.0).select(
        "asset_id", "samples", r6("floor", "floor"), "above", "outside", r6("worst", "worst"), "status")


_G = "log2((h + 0.015625e0)/(s + 0.015625e0))"


@query("f13_keep_finite_gain", "select asset_id, y, x, round(g, 6) g from (select asset_id, y, x, code/16e0-6e0 g from px8) where g > -10 and g < 10")
def _(t):
    gains = t.px8.select("asset_id", "y", "x", (F.col("code") / 16.0 - 6.0).alias("g"))
    return measure.keep_finite_gain(gains).select("asset_id", "y", "x", r6("g", "g"))


# Two 8x8 images share one measured area, so that groups pass 100 samples.
_RANGE = """with g as (select asset_id // 2 asset_id, log2((hdr + 0.015625e0)/(sdr + 0.015625e0)) g from gain),
    k as (select * from g where g > -10 and g < 10),
    t as (select asset_id, count(*) n, least(min(g), 0e0) mn, greatest(max(g), 0e0) mx from k group by 1),
    lo as (select asset_id, min(case when run >= total // 100 then bin end) bin from (select asset_id, bin, sum(n) over (partition by asset_id order by bin) run,
      cast(sum(n) over (partition by asset_id) as bigint) total from (select asset_id, least(4095, greatest(0, cast(trunc((g+16e0)/32e0*4096) as int))) bin, count(*) n from k group by 1, 2)) group by 1),
    hi as (select asset_id, max(case when run >= greatest(total // 10000, 1) then bin end) bin from (select asset_id, bin, sum(n) over (partition by asset_id order by bin desc) run,
      cast(sum(n) over (partition by asset_id) as bigint) total from (select asset_id, least(8191, greatest(0, cast(trunc((g+16e0)/32e0*8192) as int))) bin, count(*) n from k group by 1, 2)) group by 1),
    b as (select asset_id, n, n >= 100 measured, case when n >= 100 then least((lo.bin+0.5e0)*32e0/4096-16e0, 0e0) else 0e0 end low,
      case when n >= 100 then greatest((hi.bin+0.5e0)*32e0/8192-16e0, 0e0) else 0e0 end high, mn, mx
      from t join lo using (asset_id) join hi using (asset_id))"""


def _pairs(t):
    return t.gain.select(
        F.floor(F.col("asset_id") / 2).alias("asset_id"),
        (F.col("y") + (F.col("asset_id") % 2) * 8).cast("int").alias("y"), "x", "sdr", "hdr")


@query("a10_gain_range", _RANGE + "select asset_id, n, measured, round(low, 6) low, round(high, 6) high, round(mn, 6) abs_min, round(mx, 6) abs_max from b")
def _(t):
    return measure.gain_range(gainmap.log_gains(_pairs(t))).select(
        "asset_id", "n", "measured", *[r6(c, c) for c in ("low", "high", "abs_min", "abs_max")])


@query("a11_gain_base_class", """select asset_id, total, p05, case when p05 <= 8 then 'zero_based' when p05 >= 16 then 'mid_based' else 'undetermined' end base_class from (
    select asset_id, cast(max(total) as bigint) total, min(case when run >= greatest(1, ceil(total*0.005e0)) then code end) p05 from (
    select asset_id, code, sum(n) over (partition by asset_id order by code) run, sum(n) over (partition by asset_id) total from (
    select asset_id, code, count(*) n from text_px group by 1, 2)) group by 1)""")
def _(t):
    return measure.gain_base_class(t.text_px)


@query("w09_hist_quantile", """select asset_id, cast(max(total) as bigint) total, min(case when run >= ceil(total*0.9e0) then code end) bin from (
    select asset_id, code, sum(n) over (partition by asset_id order by code) run, sum(n) over (partition by asset_id) total from (
    select asset_id, code, count(*) n from px8 group by 1, 2)) group by 1""")
def _(t):
    return ordered.hist_quantile(t.px8, ["asset_id"], "code", F.ceil(F.col("total") * 0.9))


@query("a12_has_distinct_channels", "select asset_id, bool_or(abs(r-g) > 0 or abs(g-b) > 0) distinct_channels from pxrgb group by asset_id")
def _(t):
    return measure.has_distinct_channels(t.pxrgb)


@query("a13_block_mean", "select asset_id, y//3 by_, x//3 bx, cast(floor(avg(code)) as int) mean from px8 group by 1, 2, 3")
def _(t):
    return pixels.block_mean(t.px8, 3).withColumnRenamed("by", "by_")


_INV = matrices.invert(list(B709_TO_2020))


@query("a29_round_trip_drift", f"""select asset_id, round(max(d), 6) max_drift, round(avg(d), 6) mean_drift from (
    select asset_id, greatest(abs({sq_apply(_INV, 'a', 'bb', 'c')[0]}-r), abs({sq_apply(_INV, 'a', 'bb', 'c')[1]}-g), abs({sq_apply(_INV, 'a', 'bb', 'c')[2]}-b)) d from (
    select *, {sq_apply(B709_TO_2020)[0]} a, {sq_apply(B709_TO_2020)[1]} bb, {sq_apply(B709_TO_2020)[2]} c from (
    select asset_id, r/255e0 r, g/255e0 g, b/255e0 b from pxrgb))) group by asset_id""")
def _(t):
    return measure.round_trip_drift(t.pxrgb, B709_TO_2020).select(
        "asset_id", r6("max_drift", "max_drift"), r6("mean_drift", "mean_drift"))


# --- gain maps -----------------------------------------------------------------
@query("j16_reconcile_gainmap_meta", """select asset_id, case when apart then xmp_min else iso_min end gain_min,
    case when apart then xmp_max else iso_max end gain_max, case when iso_cap = 0 then case when has_xmp then xmp_cap else iso_cap end else iso_cap end cap_max,
    case when has_xmp then base_is_hdr else false end base_is_hdr, apart took_xmp, case when apart and xmp_gamma > 0 then xmp_gamma else 1e0 end gamma,
    case when apart then 0.01e0 else 0.015625e0 end offset_sdr, case when apart then 0.02e0 else 0.015625e0 end offset_hdr
    from (select *, has_xmp and (abs(xmp_max-iso_max) > 0.02e0 or abs(xmp_min-iso_min) > 0.02e0) apart from gmeta)""")
def _(t):
    parts = ("min", "max", "gamma", "offset_sdr", "offset_hdr", "cap")
    iso = t.gmeta.select("asset_id", *[f"iso_{p}" for p in parts])
    xmp = t.gmeta.where("has_xmp").select("asset_id", *[f"xmp_{p}" for p in parts], "base_is_hdr")
    return gainmap.reconcile_meta(iso, xmp)


_BIL = """with g as (select asset_id, y gy, x gx, avg(code)/255e0 v from (select asset_id, y//2 y, x//2 x, code from px8) group by 1, 2, 3),
    p as (select asset_id, y, x, least(greatest((y+0.5e0)*4/8-0.5e0, 0e0), 3e0) fy0, least(greatest((x+0.5e0)*4/8-0.5e0, 0e0), 3e0) fx0, code/255e0 base from px8),
    q as (select *, cast(floor(fy0) as int) y0, cast(floor(fx0) as int) x0, fy0-floor(fy0) fy, fx0-floor(fx0) fx from p),
    s as (select q.asset_id, q.y, q.x, q.base, a.v*(1-fx)*(1-fy) + b.v*fx*(1-fy) + c.v*(1-fx)*fy + d.v*fx*fy gain from q
    join g a on a.asset_id=q.asset_id and a.gy=y0 and a.gx=x0 join g b on b.asset_id=q.asset_id and b.gy=y0 and b.gx=least(x0+1,3)
    join g c on c.asset_id=q.asset_id and c.gy=least(y0+1,3) and c.gx=x0 join g d on d.asset_id=q.asset_id and d.gy=least(y0+1,3) and d.gx=least(x0+1,3))"""


def _small_gain(t):
    return t.px8.groupBy("asset_id", F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x")).agg(
        (F.avg("code") / 255.0).alias("v"))


def _base(t):
    return t.px8.select("asset_id", "y", "x", (F.col("code") / 255.0).alias("base"))


@query("j18_gain_bilinear", _BIL + "select asset_id, y, x, round(gain, 6) gain from s")
def _(t):
    return gainmap.bilinear(_base(t), _small_gain(t), 8, 8, 4, 4).select("asset_id", "y", "x", r6("gain", "gain"))


@query("r07_compute_gain_map", _RANGE + """, c as (select asset_id, y, x, case when high - low <= 0 then 0 else
    cast(floor((least(greatest(g, low), high)-low)/(high-low)*255e0) as int) end code from (
    select gn.asset_id // 2 asset_id, gn.y + (gn.asset_id % 2)*8 y, x, log2((hdr + 0.015625e0)/(sdr + 0.015625e0)) g from gain gn) z
    join (select asset_id, low, case when low = 0 and high <= 0 then 1e0 else high end high from b) using (asset_id))
    select asset_id, cast(y//2 as int) y, cast(x//2 as int) x, cast(floor(avg(code)) as int) code from c group by 1, 2, 3""")
def _(t):
    return gainmap.compute_gain_map(_pairs(t), 2)


@query("r08_reconstruct_hdr", _BIL + """select asset_id, y, x, round((base+0.015625e0)*pow(2e0, 0e0*(1-g)+iso_max*g)-0.015625e0, 6) hdr from (
    select s.*, m.iso_max, pow(s.gain, 1e0/1.5e0) g from s join gmeta m using (asset_id))""")
def _(t):
    meta = t.gmeta.select("asset_id", F.col("iso_min").alias("low"), F.col("iso_max").alias("high"), F.lit(1.5).alias("gamma"))
    return gainmap.reconstruct_hdr(_base(t), _small_gain(t), meta, 8, 8, 4, 4).withColumn("hdr", r6("hdr"))


@query("r08_reconstruct_hdr_headroom", _BIL + """select asset_id, y, x, round(base*(1e0+(iso_max+0.5e0)*
    case when gain < 0.081e0 then gain/4.5e0 else pow((gain+0.099e0)/1.099e0, 1e0/0.45e0) end), 6) hdr from s join gmeta using (asset_id)""")
def _(t):
    meta = t.gmeta.select("asset_id", (F.col("iso_max") + 1.5).alias("headroom"))
    return gainmap.reconstruct_hdr(_base(t), _small_gain(t), meta, 8, 8, 4, 4, headroom=True).withColumn("hdr", r6("hdr"))


@query("c29_log2_gain", """select asset_id, y, x, round(log2(greatest((hdr+0.015625e0)/(sdr+0.015625e0), 1e0)), 6) floored,
    round(log2((hdr+0.015625e0)/(sdr+0.015625e0)), 6) signed from gain""")
def _(t):
    h, s = F.col("hdr"), F.col("sdr")
    return t.gain.select("asset_id", "y", "x", r6(gain.log2_gain(h, s), "floored"), r6(gain.log2_gain(h, s, False), "signed"))


@query("c30_gain_to_byte", """select asset_id, y, x, cast(floor(least(greatest(hdr*4-2, -1e0), 3e0)*255e0/4e0 + 255e0/4e0) as int) affine,
    cast(floor(least(hdr, 1e0)*255e0) as int) legacy, 0 flat from gain""")
def _(t):
    g = F.col("hdr") * 4.0 - 2.0
    return t.gain.select(
        "asset_id", "y", "x", gain.gain_to_byte(g, F.lit(3.0), F.lit(-1.0)).alias("affine"),
        gain.gain_to_byte(F.col("hdr"), F.lit(0.0), F.lit(0.0)).alias("legacy"),
        gain.gain_to_byte(g, F.lit(-1.0), F.lit(-1.0)).alias("flat"))


@query("c31_apply_gain", """select asset_id, y, x, round((sdr+0.015625e0)*pow(2e0, -0.5e0*(1-g)+2e0*g)-0.015625e0, 6) v from (select *, pow(sdr, 1e0/1.2e0) g from gain)""")
def _(t):
    v = gain.apply_gain(F.col("sdr"), F.col("sdr"), F.lit(-0.5), F.lit(2.0), F.lit(1.2))
    return t.gain.select("asset_id", "y", "x", r6(v, "v"))


@query("c32_apply_gain_headroom", """select asset_id, y, x, round(hdr*(1e0+3e0*case when sdr < 0.081e0 then sdr/4.5e0 else pow((sdr+0.099e0)/1.099e0, 1e0/0.45e0) end), 6) v from gain""")
def _(t):
    return t.gain.select("asset_id", "y", "x", r6(gain.apply_gain_headroom(F.col("hdr"), F.col("sdr"), F.lit(4.0)), "v"))


@query("c33_base_from_bytes", f"select asset_id, y, x, round({sq_srgb('(code/255e0)')}, 6) v from px8")
def _(t):
    return t.px8.select("asset_id", "y", "x", r6(gain.base_from_bytes(F.col("code")), "v"))


# --- curves and colour ---------------------------------------------------------
_LUT = [0.0, 0.01, 0.05, 0.12, 0.25, 0.4, 0.6, 0.8, 1.0]


def sq_lut(x, lut):
    n = len(lut) - 1
    arr = "[" + ",".join(f"{v}e0" for v in lut) + "]"
    u = f"(least(greatest({x},0e0),1e0)*{n})"
    i = f"cast(floor({u}) as int)"
    return f"case when {i} >= {n} then {lut[-1]}e0 else {arr}[{i}+1] + ({arr}[least({i}+2,{n + 1})]-{arr}[{i}+1])*({u}-{i}) end"


@query("c19_to_linear", f"""select asset_id, y, x, round({sq_srgb('v')}, 6) srgb, round(sign(s)*pow(abs(s), 2.2e0), 6) gamma22,
    round({sq_pq('v')}, 6) pq, round(case when v <= 0.5 then v*v/3e0 else (exp((v-0.55991073e0)/0.17883277e0)+0.28466892e0)/12e0 end, 6) hlg,
    round({sq_lut('v', _LUT)}, 6) "table", v linear from (select *, code/255e0 v, code/255e0-0.5e0 s from px8)""")
def _(t):
    v = F.col("code") / 255.0
    return t.px8.select(
        "asset_id", "y", "x", r6(curves.to_linear(v, SRGB), "srgb"), r6(curves.to_linear(v - 0.5, named_curve("bt470m")), "gamma22"),
        r6(curves.to_linear(v, named_curve("smpte2084")), "pq"), r6(curves.to_linear(v, named_curve("arib-std-b67")), "hlg"),
        r6(curves.to_linear(v, curves.table_curve(_LUT)), "table"), curves.to_linear(v, named_curve("linear")).alias("linear"))


def sq_lut_inv(x, lut):
    n = len(lut) - 1
    arms = " ".join(
        f"when {x} < {lut[i + 1]}e0 then ({i}e0 + ({x}-{lut[i]}e0)/({lut[i + 1]}e0-{lut[i]}e0))/{n}e0" for i in range(n))
    return f"case when {x} <= {lut[0]}e0 then 0e0 when {x} >= {lut[-1]}e0 then 1e0 {arms} end"


@query("c19_from_linear", f"""select asset_id, y, x, round({sq_srgb_inv('v')}, 6) srgb, round({sq_pq_inv('v')}, 6) pq,
    round(case when v <= 1e0/12e0 then sqrt(3e0*v) else 0.17883277e0*ln(12e0*v-0.28466892e0)+0.55991073e0 end, 6) hlg,
    round({sq_lut_inv('v', _LUT)}, 6) "table" from (select *, code/255e0 v from px8)""")
def _(t):
    v = F.col("code") / 255.0
    return t.px8.select(
        "asset_id", "y", "x", r6(curves.from_linear(v, SRGB), "srgb"), r6(curves.from_linear(v, named_curve("smpte2084")), "pq"),
        r6(curves.from_linear(v, named_curve("arib-std-b67")), "hlg"), r6(curves.from_linear(v, curves.table_curve(_LUT)), "table"))


_APPLY = sq_apply(P3_TO_2020, "(r/255e0)", "(g/255e0)", "(b/255e0)")


@query("c20_apply_matrix", f"select asset_id, y, x, round({_APPLY[0]}, 6) mr, round({_APPLY[1]}, 6) mg, round({_APPLY[2]}, 6) mb from pxrgb")
def _(t):
    out = color.apply_matrix(unit_columns(), P3_TO_2020)
    return t.pxrgb.select("asset_id", "y", "x", *[r6(v, n) for v, n in zip(out, ("mr", "mg", "mb"))])


_GC_SRC = "select asset_id, y, x, r/128e0-0.4e0 r, g/128e0-0.4e0 g, b/128e0-0.4e0 b from pxrgb"


@query("c22_gamut_compress", f"""with s as ({_GC_SRC}), l as (select *, 0.2126e0*r+0.7152e0*g+0.0722e0*b yy from s),
    d as (select *, r-yy dr, g-yy dg, b-yy db from l),
    s1 as (select *, case when dr < 0 then greatest(0e0, r/dr) else 0e0 end sr from d),
    s2 as (select *, case when dg < 0 then greatest(sr, g/dg) else sr end sg from s1),
    s3 as (select *, case when db < 0 then greatest(sg, b/db) else sg end sb from s2),
    m as (select *, greatest(0e0, case when dr <= 0 then sr else r/dr-1/dr end, case when dg <= 0 then sg else g/dg-1/dg end,
      case when db <= 0 then sb else b/db-1/db end) lm from s3),
    x as (select *, least(greatest(0.8e0*(sb-lm)+lm, 0e0), 1e0) mix from m),
    o as (select asset_id, y, x, mix*(yy-r)+r r, mix*(yy-g)+g g, mix*(yy-b)+b b from x)
    select asset_id, y, x, round(r/greatest(1e0,r,g,b), 6) cr, round(g/greatest(1e0,r,g,b), 6) cg, round(b/greatest(1e0,r,g,b), 6) cb from o""")
def _(t):
    let = color.Stages(t.pxrgb)
    rgb = let.triple("lin", [c / 128.0 - 0.4 for c in rgb_columns()])
    out = color.gamut_compress(rgb, color.LUMA_709, 0.8, let)
    return let.df.select("asset_id", "y", "x", *[r6(v, n) for v, n in zip(out, ("cr", "cg", "cb"))])


_HEAD = 1000.0 / 203.0


def _hab(x):
    return f"((({x})*(({x})*0.15e0+0.05e0)+0.004e0)/(({x})*(({x})*0.15e0+0.5e0)+0.06e0)-0.02e0/0.30e0)"


_MD = 0.09 - 0.6 + _HEAD
_MA, _MB = -0.09 * (_HEAD - 1.0) / _MD, (0.09 - 0.6 * _HEAD + _HEAD) / max(_HEAD - 1.0, 1e-6)
_RH, _RS = 1 + 32 * (1000 / 10000) ** (1 / 12.4), 1 + 32 * (100 / 10000) ** (1 / 12.4)


@query("c23_tone_map", f"""with s as (select asset_id, y, x, r/60e0 r, g/60e0 g, b/60e0 b, greatest(r,g,b)/60e0 t from pxrgb),
    k as (select *, case when t <= 0.75 then t else 0.75e0+0.25e0*least(greatest(2e0*((t-0.75e0)/{_HEAD - 0.75!r}::double)/((t-0.75e0)/{_HEAD - 0.75!r}::double+1e0),0e0),1e0) end rh,
      case when t <= 0 then 0e0 else {_hab('t')}/{_hab(f'{_HEAD!r}::double')} end ha,
      case when t <= 0.3 then t else {(_MB * _MB + 0.6 * _MB + 0.09) / (_MB - _MA)!r}::double*(t+({_MA!r}::double))/(t+{_MB!r}::double) end mo,
      pow(greatest(r*0.203e0,0e0),{1 / 12.4!r}::double) pr, pow(greatest(g*0.203e0,0e0),{1 / 12.4!r}::double) pg, pow(greatest(b*0.203e0,0e0),{1 / 12.4!r}::double) pb from s),
    l as (select *, 0.2627e0*pr+0.6780e0*pg+0.0593e0*pb yp from k),
    a as (select *, ln(1e0+{_RH - 1!r}::double*yp)/ln({_RH!r}::double) p1 from l),
    c as (select *, case when p1 <= 0.7399 then 1.0770e0*p1 when p1 < 0.9909 then -1.1510e0*p1*p1+2.7811e0*p1-0.6302e0 else 0.5e0*p1+0.5e0 end p2 from a),
    e as (select *, (pow({_RS!r}::double,p2)-1e0)/{_RS - 1!r}::double ys from c),
    f as (select *, case when yp <= 0 then 1e0 else pow(ys/yp,1.1e0) end ff from e),
    h as (select *, ff*(pb-yp)/1.8814e0 cb, ff*(pr-yp)/1.4746e0 cr from f),
    o as (select *, ys-greatest(0.1e0*cr,0e0) yo from h),
    u as (select *, yo+1.4746e0*cr ro, yo+1.8814e0*cb bo from o)
    select asset_id, y, x, round(case when t <= 1e-6 then r else r*(rh/t) end, 6) reinhard, round(case when t <= 1e-6 then g else g*(ha/t) end, 6) hable,
    round(case when t <= 1e-6 then b else b*(mo/t) end, 6) mobius, round({sq_srgb('least(greatest((yo-0.2627e0*ro-0.0593e0*bo)/0.6780e0,0e0),1e0)')}, 6) bt2446 from u""")
def _(t):
    let = color.Stages(t.pxrgb)
    rgb = let.triple("lin", [c / 60.0 for c in rgb_columns()])
    picks = (("reinhard", 0), ("hable", 1), ("mobius", 2), ("bt2446a", 1))
    out = [r6(color.tone_map(rgb, mode, 1000.0, SRGB, let=let)[i], mode[:6] if mode == "bt2446a" else mode) for mode, i in picks]
    return let.df.select("asset_id", "y", "x", *out)


@query("c25_ootf", """with s as (select asset_id, y, x, r/255e0 r, g/255e0 g, b/255e0 b, 0.2627e0*(r/255e0)+0.6780e0*(g/255e0)+0.0593e0*(b/255e0) ys from pxrgb)
    select asset_id, y, x, round(case when ys = 0 then 0e0 else r*1000e0*pow(ys, 0.2e0) end, 6) display_r, round(g, 6) back_g from s""")
def _(t):
    let = color.Stages(t.pxrgb)
    display = let.triple("display", color.ootf(unit_columns(), 1000.0, let))
    back = color.ootf_inverse(display, 1000.0, let)
    return let.df.select("asset_id", "y", "x", r6(display[0], "display_r"), r6(back[1], "back_g"))


@query("c26_sdr_to_hdr_nits", """select asset_id, y, x, round(case when code <= 0 then 0e0 else pow(code::double, case when code <= 70
    then 1.8712e-5*code*code-2.7334e-3*code+1.3141e0 else 2.8305e-6*code*code-7.4622e-4*code+1.2528e0 end) end, 4) nits from px8""")
def _(t):
    return t.px8.select("asset_id", "y", "x", F.round(color.sdr_to_hdr_nits(F.col("code") / 255.0), 4).alias("nits"))


_BAYER = "[0,8,2,10,12,4,14,6,3,11,1,9,15,7,13,5]"


@query("c27_dither4x4", f"select asset_id, y, x, {_BAYER}[(x & 3) + (y & 3)*4 + 1]/16e0 - 0.46875e0 offset_, code + ({_BAYER}[(x & 3) + (y & 3)*4 + 1]/16e0 - 0.46875e0) v from px8")
def _(t):
    off = color.dither_offset(F.col("x"), F.col("y"))
    return t.px8.select("asset_id", "y", "x", off.alias("offset_"), (F.col("code") + off).alias("v"))


@query("c28_quantize", f"""select asset_id, y, x, cast(least(greatest(floor(code16/65535e0*255e0+0.5e0),0),255) as int) plain,
    cast(least(greatest(floor(code16/65535e0*255e0+({_BAYER}[(x & 3) + (y & 3)*4 + 1]/16e0 - 0.46875e0)+0.5e0),0),255) as int) dithered,
    cast(floor(({sq_srgb_inv('(code/255e0)')})*65535e0+0.5e0) as int) encoded from (select *, code*200+37 code16 from px8)""")
def _(t):
    c16 = (F.col("code") * 200 + 37).cast("double")
    return t.px8.select(
        "asset_id", "y", "x", color.quantize8(c16).alias("plain"),
        color.quantize8(c16, color.dither_offset(F.col("x"), F.col("y"))).alias("dithered"),
        color.encode16(F.col("code") / 255.0, SRGB).alias("encoded"))


@query("c34_luma", """select asset_id, y, x, round((0.2126e0*r+0.7152e0*g+0.0722e0*b)/255e0, 6) y709, round((0.2627e0*r+0.6780e0*g+0.0593e0*b)/255e0, 6) y2020 from pxrgb""")
def _(t):
    return measure.luma_of(t.pxrgb).select("asset_id", "y", "x", r6("y709", "y709"), r6("y2020", "y2020"))


@query("c41_lookup_lut", f"select asset_id, y, x, round({sq_lut('(code/200e0)', _LUT)}, 6) v from px8")
def _(t):
    lut = F.array(*[F.lit(v) for v in _LUT])
    return t.px8.select("asset_id", "y", "x", r6(curves.lookup_lut(F.col("code") / 200.0, lut), "v"))


_TM = sq_apply(B709_TO_2020, "lr", "lg", "lb")
_TQ = [f"cast(least(greatest(floor(floor(least(greatest({sq_pq_inv(f'(least(greatest({c}*0.0203e0,0e0),1e0))')},0e0),1e0)*65535e0+0.5e0)/65535e0*255e0"
       f"+({_BAYER}[(x & 3) + (y & 3)*4 + 1]/16e0 - 0.46875e0)+0.5e0),0),255) as int)" for c in ("mr", "mg", "mb")]


@query("r06_transform_pixels", f"""with l as (select asset_id, y, x, {sq_srgb('(r/255e0)')} lr, {sq_srgb('(g/255e0)')} lg, {sq_srgb('(b/255e0)')} lb from pxrgb),
    m as (select asset_id, y, x, {_TM[0]} mr, {_TM[1]} mg, {_TM[2]} mb from l)
    select asset_id, y, x, {_TQ[0]} r, {_TQ[1]} g, {_TQ[2]} b from m""")
def _(t):
    plan = colorspace.Transform(SRGB, named_curve("smpte2084"), matrix=B709_TO_2020, encode_scale=0.0203, dither=True)
    return colorspace.transform_pixels(t.pxrgb, plan)


@query("r06_transform_volume", f"""with px as (select asset_id, cast(pos % 64 as int) x, pos // 64 y, code r, 255 - code g, code // 2 b from text_px),
    l as (select asset_id, y, x, {sq_srgb('(r/255e0)')} lr, {sq_srgb('(g/255e0)')} lg, {sq_srgb('(b/255e0)')} lb from px),
    m as (select asset_id, y, x, {_TM[0]} mr, {_TM[1]} mg, {_TM[2]} mb from l)
    select asset_id, count(*) n, cast(sum({_TQ[0]}) as bigint) r, cast(sum({_TQ[1]}) as bigint) g, cast(sum({_TQ[2]}) as bigint) b from m group by asset_id""")
def _(t):
    px = t.text_px.select(
        "asset_id", "y", "x", F.col("code").alias("r"), (F.lit(255) - F.col("code")).alias("g"),
        F.floor(F.col("code") / 2).cast("int").alias("b"))
    plan = colorspace.Transform(SRGB, named_curve("smpte2084"), matrix=B709_TO_2020, encode_scale=0.0203, dither=True)
    return colorspace.transform_pixels(px, plan).groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in "rgb"])


_TH = [f"cast(least(greatest(floor(floor(least(greatest({sq_srgb_inv(c)},0e0),1e0)*65535e0+0.5e0)/65535e0*255e0+0.5e0),0),255) as int)" for c in ("r", "g", "b")]
_TB = sq_apply(matrices.between(PRIMARIES["bt2020"], PRIMARIES["bt709"]))


@query("r06_transform_hdr_to_sdr", f"""with l as (select asset_id, y, x, {sq_pq('(r/255e0)')}*{10000 / 203!r}::double r, {sq_pq('(g/255e0)')}*{10000 / 203!r}::double g, {sq_pq('(b/255e0)')}*{10000 / 203!r}::double b from pxrgb),
    t as (select *, greatest(r,g,b) t from l), s as (select *, case when t <= 1e-6 then 1e0 when t <= 0 then 0e0 else ({_hab('t')}/{_hab(f'{_HEAD!r}::double')})/t end k from t),
    v as (select asset_id, y, x, r*k r, g*k g, b*k b from s), m as (select asset_id, y, x, {_TB[0]} r, {_TB[1]} g, {_TB[2]} b from v)
    select asset_id, y, x, {_TH[0]} r, {_TH[1]} g, {_TH[2]} b from m""")
def _(t):
    plan = colorspace.Transform(
        named_curve("smpte2084"), SRGB, tuple(matrices.between(PRIMARIES["bt2020"], PRIMARIES["bt709"])),
        linear_scale=10000.0 / 203.0, tone="hable", peak_nits=1000.0)
    return colorspace.transform_pixels(t.pxrgb, plan)
