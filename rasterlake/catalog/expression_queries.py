"""Scalar expressions over formats, geometry, tokens, text and settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.catalog.registry import query, r6
from rasterlake.functions import media, text
from rasterlake.operators import colorspace
from rasterlake.sources import readers

col = F.col


def _parsed(t):
    return t.probe.select("asset_id", media.parse_probe(col("js")).alias("p"))



_DEPTH = """case when pix_fmt like '%f32%' then 32 when pix_fmt like '%f16%' then 16
    when regexp_matches(pix_fmt, 'p[0-9]+(le|be)?$') then cast(regexp_extract(pix_fmt, 'p([0-9]+)(le|be)?$', 1) as int)
    when regexp_matches(pix_fmt, '^(gray|ya)[0-9]+(le|be)?$') then cast(regexp_extract(pix_fmt, '^(gray|ya)([0-9]+)(le|be)?$', 2) as int)
    when pix_fmt in ('rgb24') then 8 when pix_fmt in ('rgb48le', 'rgba64le') then 16
    when pix_fmt like 'yuv%' then 8 else 0 end"""


@query("c01_bit_depth", f"select asset_id, pix_fmt, {_DEPTH} depth from assets")
def _(t):
    return t.assets.select("asset_id", "pix_fmt", media.bit_depth(col("pix_fmt")).alias("depth"))


@query("c02_has_alpha", "select asset_id, pix_fmt in ('rgba64le', 'ya8') alpha from assets")
def _(t):
    return t.assets.select("asset_id", media.has_alpha(col("pix_fmt")).alias("alpha"))


@query("c03_is_float", "select asset_id, pix_fmt = 'gbrpf32le' is_float from assets")
def _(t):
    return t.assets.select("asset_id", media.is_float(col("pix_fmt")).alias("is_float"))


@query("c04_format_size", """select event_id, case when bytes < 1024 then concat(bytes, ' B') when bytes < 1048576 then printf('%.1f KB', floor(bytes/1024e0*10e0+0.5e0)/10e0)
    when bytes < 1073741824 then printf('%.1f MB', floor(bytes/1048576e0*10e0+0.5e0)/10e0) else printf('%.2f GB', floor(bytes/1073741824e0*100e0+0.5e0)/100e0) end txt from docs""")
def _(t):
    return t.docs.select("event_id", text.format_size(col("bytes")).alias("txt"))


@query("c05_format_duration", """select event_id, case when s < 1 then '<1s' when s < 60 then printf('%.1fs', floor(s*10e0+0.5e0)/10e0)
    when s < 3600 then printf('%dm %ds', cast(floor(s/60e0+0.5e0) as int), cast(floor(s) as int) % 60)
    else printf('%dh %dm %ds', cast(floor(s/3600e0+0.5e0) as int), cast(floor(floor(s)/60) as int) % 60, cast(floor(s) as int) % 60) end txt
    from (select event_id, k * k * 0.625e0 + 0.25e0 s from jobs)""")
def _(t):
    return t.jobs.select("event_id", text.format_duration(col("k") * col("k") * F.lit(0.625) + 0.25).alias("txt"))


@query("c06_rational", "select event_id, case when k % 7 = 0 then 0e0 else cast(k as double) end v from docs")
def _(t):
    return t.docs.select("event_id", media.rational(col("rat")).alias("v"))


@query("c07_peak_from_side_data", """select asset_id, cast(asset_id as double) nits, case when asset_id = 0 then null
    when asset_id % 3 = 0 then 'mastering' else 'content_light' end source from assets""")
def _(t):
    peak = media.peak_from_side_data(col("p"))
    return _parsed(t).select("asset_id", peak["nits"].alias("nits"), peak["source"].alias("source"))


# An event without k has no text, and so no score; concat() in DuckDB passes over nulls, || does not.
@query("c08_parse_scores", r"""select event_id, try_cast('0.' || (100 + k) as double) ssim_all, cast(k || '.5' as double) ssim_db,
    case when k % 10 = 0 then 'inf'::double else cast(k || '.25' as double) end psnr_avg,
    case when k is not null then 1.5e0 end psnr_min, case when k is not null then 99e0 end psnr_max from docs""")
def _(t):
    lines = t.docs.select("event_id", text.score_lines(col("txt")).alias("lines"))
    return lines.select("event_id", text.parse_scores(col("lines")).alias("s")).select("event_id", "s.*")


@query("c09_display_size", """select asset_id, case when abs(rotation) % 180 = 90 then height else width - crop_x end w,
    case when abs(rotation) % 180 = 90 then width - crop_x else height end h from assets""")
def _(t):
    size = media.display_size(col("p"))
    return _parsed(t).select("asset_id", size["w"].alias("w"), size["h"].alias("h"))


@query("c10_tile_grid", """select asset_id, cast(case when asset_id % 2 = 0 then asset_id % 12 else 0 end as int) tiles,
    case when asset_id % 2 = 0 then width * 2 else 0 end w, case when asset_id % 2 = 0 then height * 2 else 0 end h from assets""")
def _(t):
    grid = media.tile_grid(col("p"))
    return _parsed(t).select("asset_id", grid["tiles"].alias("tiles"), grid["w"].alias("w"), grid["h"].alias("h"))


@query("c11_fit_longest_edge", """select asset_id, cast(case when greatest(width, height) <= 500 then width when width >= height then 500
    else greatest(floor(width*500e0/height/2e0+0.5e0)*2, 2) end as int) w,
    cast(case when greatest(width, height) <= 500 then height when width >= height then greatest(floor(height*500e0/width/2e0+0.5e0)*2, 2) else 500 end as int) h from assets""")
def _(t):
    size = media.fit_longest_edge(col("width"), col("height"), 500)
    return t.assets.select("asset_id", size["w"].alias("w"), size["h"].alias("h"))


_FLAT = "regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]*$', '')"
_ROOT = "regexp_extract(path, '^/[^/]+/')"


@query("c12_output_path", rf"""select asset_id, concat('/out/', {_FLAT}, '.avif') flat,
    case when {_ROOT} <> '' then concat('/out/', regexp_replace(substr(path, length({_ROOT}) + 1), '[^/]*$', ''), {_FLAT}, '.avif')
    else concat('/out/', {_FLAT}, '.avif') end kept, concat(regexp_replace(path, '/[^/]*$', ''), '/', {_FLAT}, '.avif') beside from paths""")
def _(t):
    root = F.nullif(F.regexp_extract("path", "^/[^/]+/", 0), F.lit(""))
    p = col("path")
    return t.paths.select(
        "asset_id", text.output_path(p, root, "/out", "AVIF", False).alias("flat"),
        text.output_path(p, root, "/out/", "avif", True).alias("kept"),
        text.output_path(p, root, None, "avif", True).alias("beside"))


@query("c13_under_prefix", """select asset_id, starts_with(lower(path), concat(lower(regexp_extract(path, '^/[^/]+')), '/')) inside,
    false sibling from paths""")
def _(t):
    host = F.upper(F.regexp_extract("path", "^/[^/]+", 0))
    return t.paths.select(
        "asset_id", text.under_prefix(col("path"), host).alias("inside"),
        text.under_prefix(F.concat(F.lit("/data/inputs"), col("path")), F.lit("/data/in")).alias("sibling"))


@query("c14_norm_tokens", """select asset_id, transfer_n, primaries_n, matrix_n from (select asset_id,
    case asset_id % 5 when 0 then 'iec61966-2-1' when 1 then 'smpte2084' when 2 then 'arib-std-b67' when 3 then 'bt709' else 'linear' end transfer_n,
    case when primaries = 'p3' then 'smpte432' else primaries end primaries_n,
    matrix matrix_n from assets)""")
def _(t):
    alias = F.element_at(F.array(*[F.lit(a) for a in ("sRGB", " PQ ", "hlg", "709", "8")]), (col("asset_id") % 5 + 1).cast("int"))
    return t.assets.select(
        "asset_id", media.norm_transfer(alias).alias("transfer_n"), media.norm_primaries(F.upper("primaries")).alias("primaries_n"),
        media.norm_matrix(col("matrix")).alias("matrix_n"))


@query("c15_cicp_codes", """select asset_id, case when t is not null then p end p, case when p is not null then t end t from (select asset_id,
    case primaries when 'bt709' then 1 when 'bt2020' then 9 when 'smpte432' then 12 when 'smpte431' then 11 end p,
    case transfer when 'iec61966-2-1' then 13 when 'smpte2084' then 16 when 'arib-std-b67' then 18 when 'bt709' then 1 when 'linear' then 8 end t from assets)""")
def _(t):
    codes = media.cicp_codes(col("primaries"), col("transfer"))
    return t.assets.select("asset_id", codes["p"].alias("p"), codes["t"].alias("t"))


_MATS = ("bt709", "bt2020nc", "gbr", "rgb", "smpte170m", "bt470bg")


@query("c16_cicp_warnings", """select asset_id, nullif(concat_ws('|', case when primaries in ('p3','unspecified') then 'unusual_primaries' end,
    case when transfer in ('smpte2084','arib-std-b67') and primaries = 'bt709' then 'hdr_on_bt709' end,
    case when matrix = 'ipt' then 'matrix_ignored' end,
    case when (primaries = 'bt2020' and matrix not in ('bt2020nc','gbr')) or (primaries in ('bt709','smpte432') and matrix = 'bt2020nc') then 'matrix_mismatch' end), '') warnings from assets""")
def _(t):
    found = media.cicp_warnings(col("primaries"), col("transfer"), col("matrix"), _MATS)
    return t.assets.select("asset_id", F.array_join(found, "|").alias("warnings"))


_DESC = "case event_id % 6 when 0 then concat('sRGB IEC ', k) when 1 then 'Adobe RGB (1998)' when 2 then 'Display P3' when 3 then 'ROMM RGB' when 4 then 'Rec.2020 linear' else concat('Camera ', k) end"


@query("c17_guess_space", f"""select event_id, case event_id % 6 when 0 then 'sRGB' when 1 then 'Adobe RGB' when 2 then 'Display P3' when 3 then 'ProPhoto RGB' when 4 then 'Rec.2020' end space from docs""")
def _(t):
    return t.docs.select("event_id", text.guess_space(F.expr(_DESC)).alias("space"))


@query("c18_color_info", """select asset_id, coalesce(nullif(concat_ws(' / ', case when primaries is not null then concat('primaries=', primaries) end,
    concat('transfer=', transfer), case when matrix is not null and matrix <> 'gbr' then concat('matrix=', matrix) end), ''), '(untagged)') info from assets""")
def _(t):
    return t.assets.select("asset_id", text.color_info(col("primaries"), col("transfer"), col("matrix"), F.lit(None).cast("string")).alias("info"))


_BETWEEN = """with a as (select asset_id, case primaries when 'p3' then 'smpte432' when 'unspecified' then null else primaries end src from assets),
    x as (select token, """ + ", ".join(f"m{i} s{i}" for i in range(9)) + """, wx/wy xw, (1e0-wx-wy)/wy zw from prim_xyz),
    d as (select """ + ", ".join(f"m{i} t{i}" for i in range(9)) + """, wx/wy xd, (1e0-wx-wy)/wy zd,
      m0*(m4*m8-m5*m7)-m1*(m3*m8-m5*m6)+m2*(m3*m7-m4*m6) det from prim_xyz where token = 'bt2020')
    select asset_id, round((t4*t8-t5*t7)/det*v0 + (t2*t7-t1*t8)/det*v3 + (t1*t5-t2*t4)/det*v6, 6) m00,
      round((t5*t6-t3*t8)/det*v1 + (t0*t8-t2*t6)/det*v4 + (t2*t3-t0*t5)/det*v7, 6) m11,
      round((t3*t7-t4*t6)/det*v2 + (t1*t6-t0*t7)/det*v5 + (t0*t4-t1*t3)/det*v8, 6) m22 from (select asset_id, d.*, """ + ", ".join(
    f"({' + '.join(f'b{3 * i + k}*s{3 * k + j}' for k in range(3))}) v{3 * i + j}" for i in range(3) for j in range(3)) + """ from (
    select *, """ + ", ".join(
    f"(i{3 * i}*gl*{(0.8951, 0.2664, -0.1614)[j]}e0 + i{3 * i + 1}*gm*{(-0.7502, 1.7135, 0.0367)[j]}e0 + i{3 * i + 2}*gs*{(0.0389, -0.0685, 1.0296)[j]}e0) b{3 * i + j}"
    for i in range(3) for j in range(3)) + """ from (select a.asset_id, x.*,
    (0.8951e0*xd+0.2664e0-0.1614e0*zd)/(0.8951e0*xw+0.2664e0-0.1614e0*zw) gl, (-0.7502e0*xd+1.7135e0+0.0367e0*zd)/(-0.7502e0*xw+1.7135e0+0.0367e0*zw) gm,
    (0.0389e0*xd-0.0685e0+1.0296e0*zd)/(0.0389e0*xw-0.0685e0+1.0296e0*zw) gs,
    0.986992905466712e0 i0, -0.147054256420990e0 i1, 0.159962651663731e0 i2, 0.432305269723395e0 i3, 0.518360271536777e0 i4, 0.0492912282128556e0 i5,
    -0.00852866457517732e0 i6, 0.0400428216540849e0 i7, 0.968486695787550e0 i8
    from a left join x on x.token = a.src and a.src <> 'bt2020' cross join d) q) z, d)"""


@query("c21_matrix_between", _BETWEEN)
def _(t):
    rows = t.assets.withColumn("dst", F.when(col("asset_id") >= 0, "rec2020"))
    out = colorspace.conversion_matrices(rows, "primaries", "dst")
    return out.select("asset_id", r6("m00", "m00"), r6("m11", "m11"), r6("m22", "m22"))


@query("c36_quality_to_setting", """select asset_id, format, quality, case format when 'jpg' then round_even((100-quality)*29e0/100e0+2e0, 0)
    when 'png' then round_even((100-quality)*9e0/100e0, 0) when 'avif' then round_even((100-quality)*63e0/100e0, 0)
    when 'jxl' then case when quality >= 100 then 0e0 else floor(((100-quality)*0.09e0+0.1e0)*10e0+0.5e0)/10e0 end end setting,
    case when format = 'jxl' then quality end as back from assets""")
def _(t):
    setting = media.quality_to_setting(col("format"), col("quality"))
    return t.assets.select("asset_id", "format", "quality", setting.alias("setting")).withColumn(
        "back", F.when(col("format") == "jxl", media.jxl_distance_to_quality(
            F.when(col("quality") >= 100, 0.0).otherwise((F.lit(100) - col("quality")) * 0.09 + 0.1))))


@query("c37_codec_loss", """select asset_id, case when format in ('png','tiff') then 'Lossless' when format = 'jxl' then case when lossless then 'Lossless' else 'VisuallyLossless' end
    when format in ('webp','avif','heic') then case when lossless then 'Lossless' else 'Lossy' end when format = 'jpg' then 'Lossy' else 'Unknown' end loss from assets""")
def _(t):
    return t.assets.select("asset_id", media.codec_loss(col("format"), col("lossless")).alias("loss"))


@query("c38_value_digest", "select event_id, substr(sha256(txt), 1, 8) digest from docs")
def _(t):
    return t.docs.select("event_id", text.value_digest(col("txt")).alias("digest"))


@query("c40_icc_version", "select asset_id, case when format = 'jpg' and asset_id % 2 = 0 then 'v2.1' else 'v4.4' end icc from assets")
def _(t):
    asked = F.when(col("asset_id") % 2 == 0, "v2").otherwise("v4")
    return t.assets.select("asset_id", media.icc_version(asked, col("format")).alias("icc"))


@query("t04_last_match", "select event_id, concat('0.', 100 + k) v from docs")
def _(t):
    return t.docs.select("event_id", text.last_match(col("txt"), r"All:([0-9.]+)", 1).alias("v"))


@query("t05_tail_chars", "select doc_id, \"right\"(text, 500) tail from documents")
def _(t):
    return t.documents.select("doc_id", text.tail_chars(col("text"), 500).alias("tail"))


@query("t06_pick_stream", "select asset_id, case when asset_id % 3 > asset_id % 5 then 2 else 1 end stream_index from assets")
def _(t):
    return readers.pick_stream(t.probe, "js").select("asset_id", "stream_index")


@query("s02_read_probe_json", "select asset_id, format, width, height, pix_fmt, cast(asset_id % 5 as int) nb_frames from assets")
def _(t):
    return readers.read_probe_json(t.probe, "js").select("asset_id", "format", "width", "height", "pix_fmt", "nb_frames")


# --- fixed values: file heads of known formats, and of none -------------------
_HEADS = {
    "png": "89504E470D0A1A0A0000000D", "jpg": "FFD8FFE000104A4649460001", "webp": "524946460000000057454250",
    "avif": "0000001C6674797061766966", "jxl": "0000000C4A584C200D0A870A", "none": "48656C6C6F20776F726C6421",
}


@query("c39_magic_format", """select page_id, ['png','jpg','webp','avif','jxl',null][page_id % 6 + 1] magic, page_id % 6 <> 5 and page_id % 4 = 0 and page_id % 6 <> 0 mismatch from pages""")
def _(t):
    head = F.element_at(F.array(*[F.lit(h) for h in _HEADS.values()]), (col("page_id") % 6 + 1).cast("int"))
    files = t.pages.select(
        "page_id", F.concat(F.unhex(head), F.encode("html", "UTF-8")).alias("content"),
        F.when(col("page_id") % 4 == 0, "png").otherwise(F.element_at(
            F.array(*[F.lit(h) for h in _HEADS]), (col("page_id") % 6 + 1).cast("int"))).alias("named"))
    return files.select("page_id", media.magic_format(col("content")).alias("magic"), "named").withColumn(
        "mismatch", F.coalesce(col("magic") != col("named"), F.lit(False))).drop("named")


@query("s09_read_matrix_csv", """select cast(asset_id as varchar) src, 'd50' dst, case when m0 > 0.4e0 then 'ok' else 'odd' end status, round(m0, 8) m00, round(m4, 8) m11, round(m8, 8) m22,
    round(abs(m0 + m1 + m2 - 1e0), 8) max_row_sum_dev from mats""")
def _(t):
    from rasterlake.session import work_dir
    folder = work_dir(t.spark, "matrices")
    cells = [col(f"m{i}").alias(f"m{i // 3}{i % 3}") for i in range(9)]
    t.mats.select(
        col("asset_id").cast("string").alias("src"), F.lit("d50").alias("dst"),
        F.when(col("m0") > 0.4, "ok").otherwise("odd").alias("status"),
        F.abs(col("m0") + col("m1") + col("m2") - 1.0).alias("maxRowSumDev"), *cells,
    ).write.option("header", True).csv(folder)
    return readers.read_matrix_csv(t.spark, folder).select(
        "src", "dst", "status", *[F.round(c, 8).alias(c) for c in ("m00", "m11", "m22", "max_row_sum_dev")])
