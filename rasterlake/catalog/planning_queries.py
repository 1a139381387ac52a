"""Conversion planning and colour-space decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.catalog.registry import query, r6
from rasterlake.functions import media
from rasterlake.functions.color import SDR_WHITE_NITS
from rasterlake.model import CAPS_FIELDS
from rasterlake.operators import colorspace, jobs, quality
from rasterlake.plans import decisions

col = F.col
_PRIM = "case primaries when 'p3' then 'smpte432' when 'unspecified' then null else primaries end"


# --- pair checks and filters over assets ---------------------------------------
@query("f07_resolution_match", """select asset_id, case when crop_x > 0 and (width <> ew or height <> height) then printf('%dx%d vs %dx%d', width, height, ew, height) end reason,
    not (crop_x > 0 and width <> ew) ok from (select *, case when asset_id % 4 = 0 then width + 2 else width end ew from assets)""")
def _(t):
    pairs = t.assets.selectExpr(
        "asset_id", "case when crop_x > 0 then width else 0 end src_w", "height src_h",
        "case when asset_id % 4 = 0 then width + 2 else width end enc_w", "height enc_h")
    return quality.resolution_match(pairs).select("asset_id", "reason", "ok")


@query("f08_compose_admissible", """select asset_id, reject_reason, reject_reason is null ok from (select asset_id,
    case when crop_x = 0 then 'size_unknown' when asset_id % 4 = 0 then 'size_differs' when transfer in ('smpte2084','arib-std-b67') then 'sdr_slot_is_hdr'
    when transfer = 'linear' then 'sdr_transfer' when asset_id % 3 = 0 then 'hdr_transfer' end reject_reason from assets)""")
def _(t):
    pairs = t.assets.selectExpr(
        "asset_id", "case when crop_x = 0 then 0 else width end sdr_w", "height sdr_h", "case when asset_id % 4 = 0 then width + 2 else width end hdr_w",
        "height hdr_h", "transfer sdr_transfer", "case asset_id % 3 when 0 then 'bt709' when 1 then 'smpte2084' else 'arib-std-b67' end hdr_transfer")
    return jobs.compose_admissible(pairs).select("asset_id", "reject_reason", "ok")


@query("f14_is_hdr_source", "select asset_id, transfer in ('smpte2084','arib-std-b67') or (transfer = 'linear' and peak_nits > 203) hdr from assets")
def _(t):
    return t.assets.select("asset_id", media.is_hdr(col("transfer"), col("peak_nits"), SDR_WHITE_NITS).alias("hdr"))


_TARGET_TRC = "case asset_id % 3 when 0 then null when 1 then 'iec61966-2-1' else 'smpte2084' end"


@query("f15_needs_hdr_to_sdr", f"""select asset_id, transfer in ('smpte2084','arib-std-b67') and not (coalesce(tt is null and (format in ('avif','jxl') or (format = 'png' and asset_id % 2 = 0)), false))
    and not coalesce(format not in ('tiff','jpg','webp') and tt = 'smpte2084', false) needs from (select *, {_TARGET_TRC} tt from assets)""")
def _(t):
    depth = F.when(col("asset_id") % 2 == 0, 16).otherwise(8)
    needs = decisions.needs_hdr_to_sdr(col("format"), col("transfer"), depth, F.expr(_TARGET_TRC))
    return t.assets.select("asset_id", needs.alias("needs"))


@query("f16_compare_domain", """select asset_id, ext in ('png','jxl') rgb_native, case when greatest(case ext when 'png' then 16 else 8 end, case when asset_id % 3 = 0 then 10 else 8 end) > 8 then 16 else 8 end carrier from paths""")
def _(t):
    deepest = F.greatest(F.when(col("ext") == "png", 16).otherwise(8), F.when(col("asset_id") % 3 == 0, 10).otherwise(8))
    return t.paths.select(
        "asset_id", media.is_rgb_native_output(col("path")).alias("rgb_native"), F.when(deepest > 8, 16).otherwise(8).alias("carrier"))


# --- lookups -------------------------------------------------------------------
@query("j05_lookup_caps", "select asset_id, format, known_format, " + ", ".join(CAPS_FIELDS) + " from capped")
def _(t):
    return colorspace.lookup_caps(t.assets).select("asset_id", "format", "known_format", *CAPS_FIELDS)


@query("j06_lookup_primaries", f"select asset_id, token, rx, gy from (select asset_id, {_PRIM} p from assets) left join primaries_dim on token = p")
def _(t):
    out = colorspace.lookup_primaries(t.assets, "primaries")
    return out.select("asset_id", "token", F.get("xy", F.lit(0)).alias("rx"), F.get("xy", F.lit(3)).alias("gy"))


_NEAR = "select asset_id, token, rank, greatest(" + ", ".join(f"abs(m{i}-d{i})" for i in range(9)) + """) err from mats, (select *,
    case token when 'bt709' then 0 when 'bt2020' then 1 when 'smpte432' then 2 when 'smpte431' then 3 when 'bt470bg' then 4
    when 'Adobe RGB' then 5 else 6 end rank from prim_d50)"""


@query("j07_nearest_known_space", f"""select asset_id, round(err, 6) err, case when err <= 2e-3 then token end space from (
    select *, row_number() over (partition by asset_id order by err, rank) rn from ({_NEAR})) where rn = 1""")
def _(t):
    out = colorspace.nearest_known_space(t.mats, [f"m{i}" for i in range(9)])
    return out.select("asset_id", r6("err", "err"), "space")


@query("t02_argmin_per_group", f"""select asset_id, rank, round(err, 6) err from (select *, row_number() over (partition by asset_id order by err, rank) rn from ({_NEAR})) where rn = 1""")
def _(t):
    from rasterlake.operators.measure import argmin_per_group
    cells = [f"m{i}" for i in range(9)]
    options = F.array(*[
        F.struct(F.lit(r).alias("rank"), F.greatest(*[F.abs(col(c) - v) for c, v in zip(cells, colorants)]).alias("err"))
        for r, (_, colorants) in enumerate(colorspace.known_spaces())])
    rows = t.mats.select("asset_id", F.inline(options))
    return argmin_per_group(rows, ["asset_id"], "err", "rank").select("asset_id", "rank", r6("err", "err"))


@query("j08_gamut_contains", f"""select asset_id, target, inside contained from (select a.asset_id, a.target, {_PRIM} p, case target when 'srgb' then 'bt709' when 'display-p3' then 'smpte432' else 'bt2020' end d
    from (select assets.*, unnest(['srgb','display-p3','bt2020-pq']) target from assets) a) left join gamut_pairs on src = p and dst = d""")
def _(t):
    rows = decisions.with_targets(t.assets, ("srgb", "display-p3", "bt2020-pq")).withColumn(
        "dst", F.when(col("target") == "srgb", "bt709").when(col("target") == "display-p3", "display-p3").otherwise("rec2020"))
    return colorspace.gamut_relation(rows, "primaries", "dst").select("asset_id", "target", "contained")


_SUP = """with a as (select capped.*, """ + _PRIM + """ p, transfer in ('smpte2084','arib-std-b67') hdr from capped),
    c as (select * from (values (0,'bt709','iec61966-2-1',false),(1,'smpte432','iec61966-2-1',false),(2,'bt709','bt709',false),(3,'smpte432','bt709',false),
    (4,'bt2020','bt709',false),(5,'bt2020','smpte2084',true),(6,'bt2020','arib-std-b67',true)) t(rk, cp, ct, ch)),
    m as (select a.asset_id, min_by(cp, rk) sp, min_by(ct, rk) st from a join c on ch = hdr and (not hdr or ct = transfer) join gamut_pairs g on g.src = p and g.dst = cp and inside
    where can_cicp and (format <> 'jxl' or ct in ('smpte2084','arib-std-b67') or (ct = 'iec61966-2-1' and cp in ('bt709','smpte432'))) group by 1)"""


@query("j09_narrowest_superset", _SUP + "select a.asset_id, sp superset_primaries, st superset_transfer from a left join m using (asset_id)")
def _(t):
    return colorspace.narrowest_superset(t.assets).select("asset_id", "superset_primaries", "superset_transfer")


# --- planning ------------------------------------------------------------------
_PLAN = """d as (select c.*, """ + _PRIM + """ sp, transfer st, case when target in ('srgb','bt709') then 'bt709' when target = 'display-p3' then 'smpte432' when target is not null then 'bt2020' end dp,
    case when target in ('srgb','display-p3') then 'iec61966-2-1' when target in ('p3-pq','bt2020-pq') then 'smpte2084' when target in ('p3-hlg','bt2020-hlg') then 'arib-std-b67' when target is not null then 'bt709' end dt
    from (select capped.*, unnest([null,'srgb','bt709','display-p3','dci-p3','p3-pq','p3-hlg','bt2020-pq','bt2020-hlg','bt2020','adobe-rgb','prophoto-rgb','colormatch-rgb']) target from capped) c),
    p as (select d.*, case when target is null then 'None' when sp is null then 'Reject' when sp = dp and st = dt then 'None' else 'Map' end as action,
    case when target is null then 'no_target' when sp is null then 'unknown_source' when sp = dp and st = dt then 'equivalent' else 'map' end reason from d),
    q as (select p.*, action = 'Map' and st <> dt needs_curve_change, action = 'Map' and not coalesce(inside, false) outside_gamut,
    action = 'Map' and max_bit_depth <= 8 and (sp <> dp or st <> dt) needs_dither from p left join gamut_pairs g on g.src = sp and g.dst = dp)"""


@query("p01_plan_color", f"with {_PLAN} select asset_id, target, action, reason, needs_curve_change, outside_gamut, needs_dither from q")
def _(t):
    out = decisions.plan_color(decisions.with_targets(t.assets))
    return out.select("asset_id", "target", "action", "reason", "needs_curve_change", "outside_gamut", "needs_dither")


_DECL = "case asset_id % 3 when 0 then 'Recommended' when 1 then 'CarryIcc' else 'Manual' end"


@query("p02_resolve_strategy", f"""select asset_id, declared, case when gm and declared <> 'Recommended' then case when manual_set then 'Manual' else 'Recommended' end else declared end effective,
    case when gm and declared <> 'Recommended' then case when (case when manual_set then 'Manual' else 'Recommended' end) = declared then 'None' else 'GainMapRequiresBaseMapping' end
    when declared <> 'CarryIcc' then 'None' when transfer in ('smpte2084','arib-std-b67') or (transfer = 'linear' and peak_nits > 203) then 'HdrNoIccCarryPath'
    when not can_icc then 'ContainerCannotCarryIcc' else 'None' end reason from (select *, {_DECL} declared, asset_id % 5 = 2 gm, asset_id % 2 = 0 manual_set from capped)""")
def _(t):
    rows = colorspace.lookup_caps(t.assets).withColumns({
        "declared": F.expr(_DECL), "gain_map_requested": col("asset_id") % 5 == 2, "manual_set": col("asset_id") % 2 == 0})
    return decisions.resolve_strategy(rows).select("asset_id", "strategy.*")


@query("p03_carry_profile_outcome", f"select asset_id, case when {_DECL} <> 'CarryIcc' or not has_icc or not can_icc then 'Skip' when icc_and_cicp then 'CarryWithCicp' else 'CarryIccOnly' end outcome from capped")
def _(t):
    rows = colorspace.lookup_caps(t.assets)
    out = decisions.carry_profile_outcome(F.expr(_DECL), col("has_icc"), col("can_icc"), col("icc_and_cicp"))
    return rows.select("asset_id", out.alias("outcome"))


_TOKEN = "case asset_id % 6 when 0 then null when 1 then 'rgb' when 2 then 'xyb' when 3 then 'bt470bg' when 4 then 'ycgco' else 'bt709' end"


@query("p04_out_matrix_capability", f"""select asset_id, case when tk is null then 'NotApplicable'
    when format = 'jpg' and jl then case tk when 'rgb' then 'Redundant' when 'xyb' then 'Carried' else 'Rejected' end
    when format in ('jpg','webp') then case when tk = 'bt470bg' then 'Redundant' else 'Rejected' end
    when format in ('png','tiff') then case when tk = 'rgb' then 'Redundant' else 'Rejected' end
    when format = 'avif' then case when jl or tk in ('ycgco','xyb') then 'Rejected' else 'Carried' end
    when format = 'jxl' then case tk when 'rgb' then 'Redundant' when 'xyb' then 'Carried' else 'Rejected' end else 'Rejected' end capability
    from (select asset_id, format, {_TOKEN} tk, asset_id % 16 < 8 jl from assets)""")
def _(t):
    backend = F.when(col("asset_id") % 16 < 8, "Cjpegli").otherwise("Ffmpeg")
    return t.assets.select("asset_id", decisions.out_matrix_capability(col("format"), F.expr(_TOKEN), backend).alias("capability"))


@query("p05_accepts_cicp", """select asset_id, coalesce(can_cicp and primaries in ('bt709','bt2020','smpte432','smpte431') and (format <> 'jxl'
    or (transfer = 'iec61966-2-1' and primaries in ('bt709','smpte432')) or (transfer in ('smpte2084','arib-std-b67') and primaries = 'bt2020')), false) ok from capped""")
def _(t):
    rows = colorspace.lookup_caps(t.assets)
    return rows.select("asset_id", media.accepts_cicp(col("format"), col("primaries"), col("transfer"), col("can_cicp")).alias("ok"))


def _judged(t):
    rows = decisions.with_targets(t.assets).withColumns({
        "requested_depth": F.when(col("asset_id") % 3 == 0, 16).when(col("asset_id") % 3 == 1, 10).otherwise(8),
        "gain_map_wanted": col("asset_id") % 5 == 1, "tone_requested": col("asset_id") % 2 == 0,
        "gain_map_base": F.when(col("asset_id") % 10 == 1, "bt2020")})
    return decisions.degradations(decisions.with_outlet(decisions.plan_color(rows)))


_JUDGE = f"""with {_PLAN}, o as (select q.*, case asset_id % 3 when 0 then 16 when 1 then 10 else 8 end req, asset_id % 5 = 1 gmw, asset_id % 2 = 0 tone, coalesce(dp, sp) xp, coalesce(dt, st) xt from q),
    u as (select *, least(req, max_bit_depth) td from o),
    v as (select *, case when rgb_native and (action = 'Map' or format in ('png','apng','tiff','jxl')) then case when td <= 8 then 8 else 16 end else td end od, has_icc and can_icc and action <> 'Map' att,
    coalesce(can_cicp and xp is not null and (format <> 'jxl' or (xt = 'iec61966-2-1' and xp in ('bt709','smpte432')) or (xt in ('smpte2084','arib-std-b67') and xp = 'bt2020')), false) nameable from u),
    w as (select *, nameable or att or can_icc_from_cicp labelled, rgb_native and od > td and od <= max_bit_depth raised from v),
    z as (select asset_id, target, action, case when action = 'Reject' then '' else concat_ws('|',
    case when not raised and ((action = 'Map' and od = 8) or (not rgb_native and req > td)) then 'BitDepthReduced' end,
    case when raised then 'BitDepthRaised' end, case when outside_gamut and not (gmw and gain_map and asset_id % 10 = 1 and not has_icc and coalesce(sp in ('bt709','smpte432','bt2020'), false)) then 'GamutClipped' end, case when not labelled and unlabeled_srgb then 'UnlabeledAssumedSrgb' end,
    case when has_icc and not att then 'NoIccCarrier' end, case when has_icc and not att and not can_icc then 'ContainerCannotCarryIcc' end,
    case when gmw and gain_map and tone then 'ToneMapNotAppliedToGainMap' end) end codes from w)"""


@query("p06_degradations", _JUDGE + "select asset_id, target, codes from z")
def _(t):
    return _judged(t).select("asset_id", "target", F.array_join("degradations", "|").alias("codes"))


@query("p07_verdict", _JUDGE + "select asset_id, target, case when action = 'Reject' then 'Reject' when codes <> '' then 'ProceedWithDegradation' else 'Proceed' end verdict from z")
def _(t):
    return _judged(t).select("asset_id", "target", decisions.verdict(col("action"), col("degradations")).alias("verdict"))


@query("p08_bit_depth_outcome", """select run_id, case_id, arm_id, case when not made and rc <> 0 then 'refused' when not made then 'refuse-unclean' when not ra and not re then 'silent-mismatch'
    when (ra and re) or (ra and coalesce(de < rq, false)) or (re and coalesce(de > rq, false)) then 'misannounced' when ra then 'raised-announced' else 'reduced-announced' end verdict
    from (select *, status in ('ok','fail') made, case when status = 'skip' then 0 else 1 end rc, chunk_loss or case_id % 3 = 0 ra, pixel_equal and case_id % 3 <> 0 re,
    case arm_id % 3 when 0 then 8 when 1 then 16 end de, 10 rq from bench)""")
def _(t):
    cells = t.bench.selectExpr(
        "run_id", "case_id", "arm_id", "status in ('ok','fail') made", "case when status = 'skip' then 0 else 1 end rc", "chunk_loss or case_id % 3 = 0 raised",
        "pixel_equal and case_id % 3 <> 0 reduced", "case arm_id % 3 when 0 then 8 when 1 then 16 end delivered", "10 requested")
    return decisions.bit_depth_outcome(cells).select("run_id", "case_id", "arm_id", "verdict")


_PROFILE = "case asset_id % 6 when 0 then 'sRGB' when 1 then 'Adobe RGB' when 2 then 'Display P3' when 3 then 'DCI-P3' when 4 then 'Rec.2100' else 'Camera' end"


@query("p09_profile_semantics", f"""select asset_id, p as profile, case p when 'sRGB' then 'bt709' when 'Adobe RGB' then 'bt709' when 'Display P3' then 'smpte432' when 'DCI-P3' then 'smpte431' when 'Rec.2100' then 'bt2020' end profile_primaries,
    case p when 'sRGB' then 'iec61966-2-1' when 'Adobe RGB' then 'bt709' when 'Display P3' then 'iec61966-2-1' when 'DCI-P3' then 'bt709' when 'Rec.2100' then 'smpte2084' end profile_transfer,
    case when p = 'Adobe RGB' then true when p <> 'Camera' then false end approximated from (select asset_id, {_PROFILE} p from assets)""")
def _(t):
    rows = t.assets.select("asset_id", F.expr(_PROFILE).alias("profile"))
    return decisions.profile_semantics(rows, "profile")


@query("p10_descriptor_confidence", """select asset_id, case when asset_id % 9 = 0 then 4 when asset_id % 5 = 0 then 3
    when primaries is not null and primaries <> 'unspecified' then 2 else 1 end confidence from assets""")
def _(t):
    named = F.when(col("asset_id") % 5 == 0, "sRGB")
    out = decisions.descriptor_confidence(col("primaries"), col("transfer"), named, col("asset_id") % 9 == 0)
    return t.assets.select("asset_id", out.alias("confidence"))


@query("p11_thumbnail_gate", "select owner, case when mode = 'StripAll' then 'metadata mode is StripAll' when exif then 'EXIF is being stripped' end gate from strip_options")
def _(t):
    return t.strip_options.select("owner", decisions.thumbnail_gate(col("mode"), col("exif")).alias("gate"))


@query("p12_default_backend", "select asset_id, format, case when format = 'jxl' and (select bool_or(n_nationkey % 2 = 0) from nation) then 'Cjxl' else 'Ffmpeg' end backend from assets")
def _(t):
    tools = t.nation.selectExpr("case n_nationkey % 3 when 0 then 'Cjxl' when 1 then 'Jxr' else 'Dng' end tool", "n_nationkey % 2 = 0 available")
    return decisions.default_backend(t.assets.select("asset_id", "format"), tools)


_JOB_PRIM = "case asset_id % 3 when 0 then 'bt709' when 1 then 'bt2020' else null end"
_JOB_TRC = "case asset_id % 2 when 0 then 'iec61966-2-1' else 'smpte2084' end"
_JOB_TARGET = "case asset_id % 5 when 0 then null else 'srgb' end"


@query("p13_build_jobs", rf"""with e as (select *, regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]*$', '') st, {_JOB_PRIM} prim, {_JOB_TRC} trc, {_JOB_TARGET} target
    from paths where ext in ('png','jpg','avif','jxl','mp4')),
    n as (select *, row_number() over (partition by lower(st) order by asset_id) rn from e),
    o as (select *, concat('/out/', case when rn > 1 then concat(st, '_', rn - 1) else st end, '.jxl') output, rn > 1 renamed from n),
    x as (select distinct concat('/out/', page_id, '.jxl') output from pages)
    select o.asset_id, o.output, o.renamed, x.output is not null refused, case when x.output is not null then 'failed: exists' else 'pending' end status,
    'Cjxl' backend, case when target is null then 'None' when prim is null then 'Reject' when prim = 'bt709' and trc = 'iec61966-2-1' then 'None' else 'Map' end as action
    from o left join x on x.output = o.output""")
def _(t):
    existing = t.pages.select(F.concat(F.lit("/out/"), col("page_id"), F.lit(".jxl")).alias("output"))
    tools = t.nation.selectExpr("case n_nationkey % 3 when 0 then 'Cjxl' when 1 then 'Jxr' else 'Dng' end tool", "n_nationkey % 2 = 0 available")
    inputs = t.paths.withColumns({"primaries": F.expr(_JOB_PRIM), "transfer": F.expr(_JOB_TRC), "target": F.expr(_JOB_TARGET)})
    out = jobs.build_jobs(inputs, existing, "jxl", "/out", ("PNG", "JPEG", "AVIF", "JPEG XL", "MP4"), overwrite=False,
                          tools=tools, order="asset_id")
    return out.select("asset_id", "output", "renamed", "refused", "status", "backend", "action")


@query("p13_build_compose_jobs", r"""with e as (select *, regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]*$', '') st, row_number() over (order by asset_id) - 1 i
    from paths where ext in ('png','jpg','avif','jxl','mp4')),
    p as (select min_by(asset_id, i) asset_id, min_by(st, i) st, case when count(*) = 2 then max_by(path, i) end reference from e group by i // 2),
    n as (select *, row_number() over (partition by lower(st) order by asset_id) rn from p)
    select asset_id, concat('/out/', st, '_gainmap', case when rn > 1 then concat('_', rn - 1) else '' end, '.avif') output, reference,
    case when reference is null then 'failed: no partner' else 'pending' end status from n""")
def _(t):
    none = t.pages.select(F.concat(F.lit("/none/"), col("page_id")).alias("output"))
    out = jobs.build_jobs(t.paths, none, "avif", "/out", ("PNG", "JPEG", "AVIF", "JPEG XL", "MP4"), overwrite=False, compose=True, order="asset_id", width=64)
    return out.select("asset_id", "output", "reference", "status")
