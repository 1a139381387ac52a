"""The views of `tables`, as DuckDB SQL common table expressions."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "rasters": """select vec_id asset_id, [cast(greatest(0, least(255, floor((cast(e as double) + 0.6e0) * 200e0))) as int)
        for e in embedding] codes from embeddings""",
    "px8": """select asset_id, cast(pos as int) pos, cast(floor(pos / 8) as int) y, cast(pos % 8 as int) x, code
        from (select asset_id, generate_subscripts(codes, 1) - 1 pos, unnest(codes) code from rasters)""",
    "px8f": """select *, cast(least(255, floor(code / (frame * 4 + 1)) * (frame * 4 + 1)) as int) code2 from (
        select asset_id, cast(floor(pos / 24) as int) frame, cast(floor((pos % 24) / 8) as int) y,
        cast((pos % 24) % 8 as int) x, code from px8)""",
    "text_px": """select asset_id, cast(pos as int) pos, cast(('0x' || h) as int) code from (
        select doc_id asset_id, generate_subscripts(hs, 1) - 1 pos, unnest(hs) h from (
        select doc_id, regexp_extract_all(hex(encode(text)), '..') hs from documents))""",
    "pxrgb": """select asset_id, cast(floor(pos / 8) as int) y, cast(pos % 8 as int) x, codes[pos + 1] r,
        codes[(pos + 21) % 64 + 1] g, codes[(pos + 42) % 64 + 1] b
        from (select asset_id, codes, unnest(range(len(codes))) pos from rasters)""",
    "gain": """select asset_id, y, x, code / 255e0 sdr, least(8e0, (code / 255e0) * (code / 255e0) * 6e0 + 0.01e0) hdr from px8""",
    "gmeta": """select asset_id, max(code) / 64e0 iso_max, 0e0 iso_min,
        max(code) / 64e0 + case when asset_id % 5 = 0 then 0.5e0 else 0e0 end xmp_max, 0e0 xmp_min,
        case when asset_id % 3 = 0 then 0e0 else 2e0 end iso_cap, 2.3e0 xmp_cap, asset_id % 7 <> 0 has_xmp, case when asset_id % 4 = 0 then 0e0 else 1.5e0 end xmp_gamma,
        asset_id % 11 = 0 base_is_hdr from px8 group by asset_id""",
    "mats": "select asset_id, " + ", ".join(
        f"{b}e0 + (sum(case when pos % 9 = {i} then code end) / cast(count(case when pos % 9 = {i} then 1 end) as double)"
        f" - 120e0) * case when asset_id % 2 = 0 then 1e-5 else 1e-3 end m{i}"
        for i, b in enumerate((0.4361, 0.3851, 0.1431, 0.2225, 0.7169, 0.0606, 0.0139, 0.0971, 0.7141))
    ) + " from px8 group by asset_id",
    "primaries_dim": """select * from (values
        ('bt709',0.640e0,0.330e0,0.300e0,0.600e0,0.150e0,0.060e0,0.3127e0,0.3290e0),
        ('bt2020',0.708e0,0.292e0,0.170e0,0.797e0,0.131e0,0.046e0,0.3127e0,0.3290e0),
        ('smpte432',0.680e0,0.320e0,0.265e0,0.690e0,0.150e0,0.060e0,0.3127e0,0.3290e0),
        ('smpte431',0.680e0,0.320e0,0.265e0,0.690e0,0.150e0,0.060e0,0.314e0,0.351e0),
        ('bt470bg',0.640e0,0.330e0,0.290e0,0.600e0,0.150e0,0.060e0,0.3127e0,0.3290e0),
        ('Adobe RGB',0.640e0,0.330e0,0.210e0,0.710e0,0.150e0,0.060e0,0.3127e0,0.3290e0),
        ('ProPhoto RGB',0.7347e0,0.2653e0,0.1596e0,0.8404e0,0.0366e0,0.0001e0,0.3457e0,0.3585e0))
        t(token, rx, ry, gx, gy, bx, by_, wx, wy)""",
    # Scale of each primary by Cramer's rule, then Bradford to D50.
    "prim_xyz": """select *, rx*sr m0, gx*sg m1, bx*sb m2, ry*sr m3, gy*sg m4, by_*sb m5,
        (1e0-rx-ry)*sr m6, (1e0-gx-gy)*sg m7, (1e0-bx-by_)*sb m8 from (
        select *, (xw*(gy*zb-by_*zg) - gx*(zb-by_*zw) + bx*(zg-gy*zw)) / det sr,
        (rx*(zb-by_*zw) - xw*(ry*zb-by_*zr) + bx*(ry*zw-zr)) / det sg,
        (rx*(gy*zw-zg) - gx*(ry*zw-zr) + xw*(ry*zg-gy*zr)) / det sb from (
        select *, rx*(gy*zb-by_*zg) - gx*(ry*zb-by_*zr) + bx*(ry*zg-gy*zr) det from (
        select *, 1e0-rx-ry zr, 1e0-gx-gy zg, 1e0-bx-by_ zb, wx/wy xw, (1e0-wx-wy)/wy zw from primaries_dim)))""",
    "prim_d50": """select p.token, """ + ", ".join(
        f"(a{3 * i}*m{j} + a{3 * i + 1}*m{3 + j} + a{3 * i + 2}*m{6 + j}) d{3 * i + j}" for i in range(3) for j in range(3)
    ) + """ from prim_xyz p join (select token, """ + ", ".join(
        f"(i{3 * i}*gl*{(0.8951, 0.2664, -0.1614)[j]}e0 + i{3 * i + 1}*gm*{(-0.7502, 1.7135, 0.0367)[j]}e0"
        f" + i{3 * i + 2}*gs*{(0.0389, -0.0685, 1.0296)[j]}e0) a{3 * i + j}" for i in range(3) for j in range(3)
    ) + """ from (select token,
        (0.8951e0*xd+0.2664e0-0.1614e0*zd)/(0.8951e0*xw+0.2664e0-0.1614e0*zw) gl,
        (-0.7502e0*xd+1.7135e0+0.0367e0*zd)/(-0.7502e0*xw+1.7135e0+0.0367e0*zw) gm,
        (0.0389e0*xd-0.0685e0+1.0296e0*zd)/(0.0389e0*xw-0.0685e0+1.0296e0*zw) gs
        from prim_xyz, (select 0.34570e0/0.35850e0 xd, (1e0-0.34570e0-0.35850e0)/0.35850e0 zd)),
        (select 0.986992905466712e0 i0, -0.147054256420990e0 i1, 0.159962651663731e0 i2, 0.432305269723395e0 i3,
        0.518360271536777e0 i4, 0.0492912282128556e0 i5, -0.00852866457517732e0 i6, 0.0400428216540849e0 i7,
        0.968486695787550e0 i8)) a on a.token = p.token""",
    "prim_xy": """select token, d0/(d0+d3+d6) rx, d3/(d0+d3+d6) ry, d1/(d1+d4+d7) gx, d4/(d1+d4+d7) gy,
        d2/(d2+d5+d8) bx, d5/(d2+d5+d8) by_ from prim_d50""",
    "gamut_pairs": """select *, case when """ + " and ".join(
        f"((d1{p} <= 1e-6 and d2{p} <= 1e-6 and d3{p} <= 1e-6) or (d1{p} >= -1e-6 and d2{p} >= -1e-6 and d3{p} >= -1e-6))"
        for p in "rgb"
    ) + """ then true else false end inside from (select s.token src, d.token dst, """ + ", ".join(
        f"(d.{b}x-d.{a}x)*(s.{py}-d.{a}{'y_' if a == 'b' else 'y'})-(d.{b}{'y_' if b == 'b' else 'y'}-d.{a}{'y_' if a == 'b' else 'y'})*(s.{px}-d.{a}x) d{k}{p}"
        for p, px, py in (("r", "rx", "ry"), ("g", "gx", "gy"), ("b", "bx", "by_"))
        for k, a, b in ((1, "r", "g"), (2, "g", "b"), (3, "b", "r"))
    ) + " from prim_xy s, prim_xy d)",
    "assets": """select p_partkey asset_id,
        case p_partkey % 8 when 0 then 'jpg' when 1 then 'png' when 2 then 'webp' when 3 then 'avif' when 4 then 'jxl'
        when 5 then 'heic' when 6 then 'tiff' else 'xyz' end format,
        cast(320 + p_size * 16 as int) width, cast(200 + (p_partkey % 9) * 24 as int) height,
        cast(p_partkey % 4 - 1 as int) * 90 rotation, cast((p_partkey % 5) * 2 as int) crop_x,
        case p_partkey % 9 when 0 then 'yuv420p' when 1 then 'yuv420p10le' when 2 then 'rgb24' when 3 then 'rgb48le'
        when 4 then 'rgba64le' when 5 then 'gray16le' when 6 then 'gbrpf32le' when 7 then 'ya8' else 'weird' end pix_fmt,
        case p_partkey % 7 when 0 then 'bt709' when 1 then 'bt2020' when 2 then 'smpte432' when 3 then 'p3'
        when 4 then 'unspecified' when 5 then 'smpte431' else null end primaries,
        case p_partkey % 5 when 0 then 'iec61966-2-1' when 1 then 'smpte2084' when 2 then 'arib-std-b67'
        when 3 then 'bt709' else 'linear' end transfer,
        case p_partkey % 6 when 0 then 'bt709' when 1 then 'bt2020nc' when 2 then 'gbr' when 3 then 'ipt' else null end matrix,
        cast(p_retailprice * 1000 as bigint) size_bytes, p_partkey % 3 = 0 lossless, cast(p_size * 40 as double) peak_nits,
        cast(p_partkey % 101 as int) quality, p_partkey % 4 = 1 has_icc, p_brand brand from part""",
    "caps_dim": """select * from (values
        ('png',true,true,true,16,true,true,true,true,false), ('jpg',true,false,true,8,false,false,true,false,true),
        ('tiff',true,false,true,16,true,false,false,false,false), ('webp',true,false,true,8,false,false,true,false,false),
        ('jxl',true,true,true,32,true,true,false,false,true), ('avif',true,true,true,12,false,true,false,true,true),
        ('heic',false,false,false,8,false,false,false,false,false))
        t(cap_format, can_icc, can_cicp, can_icc_from_cicp, max_bit_depth, rgb_native, can_hdr, unlabeled_srgb, icc_and_cicp, gain_map)""",
    "capped": """select a.*, c.cap_format is not null known_format, coalesce(can_icc,false) can_icc, coalesce(can_cicp,false) can_cicp,
        coalesce(can_icc_from_cicp,false) can_icc_from_cicp, coalesce(max_bit_depth,8) max_bit_depth,
        coalesce(rgb_native,false) rgb_native, coalesce(can_hdr,false) can_hdr, coalesce(unlabeled_srgb,false) unlabeled_srgb,
        coalesce(icc_and_cicp,false) icc_and_cicp, coalesce(gain_map,false) gain_map
        from assets a left join caps_dim c on c.cap_format = a.format""",
    "paths": """select page_id asset_id, concat('/', regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '.', ext) path,
        concat('img', page_id % 9) stem, ext, length(html) size from (select *, case page_id % 7 when 0 then 'jpg' when 1 then 'png'
        when 2 then 'webp' when 3 then 'avif' when 4 then 'jxl' when 5 then 'heic' else 'mp4' end ext from pages)""",
    "tags": """select p_partkey asset_id, unnest(['IFD0','IFD0','ExifIFD','ExifIFD','ExifIFD','ExifIFD','ExifIFD','GPS','XMP','ICC_Profile']) grp,
        unnest(['Make','Model','ISO','DateTimeOriginal','FocalLength','FNumber','ExposureTime','GPSLatitude','Label','ProfileDescription']) tag,
        unnest([p_brand, p_name, cast(p_size as varchar), concat('2024-01-', p_size), cast(p_size % 3 as varchar),
        case when p_size % 4 = 0 then 'undef (0/0)' else cast(p_size % 4 as varchar) end, cast(p_size % 2 as varchar),
        cast(p_size * 2 as varchar), p_type, p_type]) as value from part""",
    "product_tags": """select asset_id, grp,
        case when tag in ('ISO','FocalLength','FNumber','ExposureTime') and asset_id % 3 = 0 then concat('Legacy', tag) else tag end tag,
        case when tag = 'GPSLatitude' and asset_id % 5 = 0 then cast(cast(value as int) + 1 as varchar) else value end as value
        from tags union all select p_partkey, 'XMP', 'Tool', p_name from part""",
    "ledger": """select asset_id, grp, tag, value, case when grp='GPS' then 'position' when grp='XMP' then 'text'
        when tag='ISO' then 'exposure' else 'identity' end cls,
        case asset_id%4 when 0 then 'carry_verified' when 1 then 'carry_gap' when 2 then 'policy_discarded' else 'unaudited' end disposition,
        case asset_id%3 when 0 then 'verified' when 1 then 'source_inferred' else 'pending' end as level from tags""",
    "jobs": """select event_id, item_id, ts, value, k, cast(item_id % 3 as int) batch,
        case event_type when 'signup' then 'pending' when 'view' then 'processing' when 'click' then concat('processing ', k, '%')
        when 'purchase' then case when k % 10 = 0 then 'completed (degraded)' else 'completed' end
        else case k % 10 when 1 then 'stopped' when 2 then 'deleted' else concat('failed: ', k) end end status,
        case event_type when 'purchase' then case when k % 10 = 5 then 1 else 0 end when 'error' then k else null end exit_code
        from (select event_id, user_id item_id, ts, event_type, value, cast(json_extract_string(props, '$.k') as int) k from events)""",
    "terminal": """select * from jobs where starts_with(status,'completed') or starts_with(status,'failed') or status in ('stopped','deleted')""",
    "first_ends": """select * from (select *, row_number() over (partition by item_id order by ts, event_id) rn from terminal) where rn = 1""",
    "latest": """select * from (select *, row_number() over (partition by item_id order by ts desc, event_id desc) rn from jobs) where rn = 1""",
    "progress": """select event_id, item_id, ts, case event_id % 3 when 0 then concat('frame=', k) when 1 then concat('stream_0_0_q=', k)
        else concat('Input #', k, ' = file') end line, event_id % 3 line_kind from jobs""",
    "docs": """select event_id, concat('n:1 SSIM Y:0.9 All:0.91 (10.1)', chr(10), 'SSIM All:0.', 100 + k, ' (', k, '.5)', chr(10),
        'PSNR y:1.0 average:', case when k % 10 = 0 then 'inf' else concat(k, '.25') end, ' min:1.5 max:99.0') txt,
        concat(k * 10000, '/', case when k % 7 = 0 then 0 else 10000 end) rat, cast(k as bigint) * k * k * k * 100 bytes, k from jobs""",
    "bench": """select l_partkey case_id, l_linenumber arm_id, l_orderkey * 100000 + l_suppkey run_id,
        cast(1000 + l_quantity * 10 as bigint) baseline_bytes, cast(900 + (l_partkey * 7 + l_suppkey * 13) % 300 as bigint) output_bytes,
        case (l_partkey + l_suppkey) % 11 when 0 then 'timeout' when 1 then 'fail' when 2 then 'skip' else 'ok' end status,
        (l_partkey + l_suppkey) % 17 <> 3 pixel_equal, l_suppkey % 13 = 5 chunk_loss, l_orderkey % 19 <> 7 decode_ok,
        (l_partkey * 31 + l_suppkey + l_orderkey) % 500 + 1 time_ms, cast(l_quantity as bigint) * 4096 pixels from lineitem""",
    "boxes": """select asset_id, seq, type, size, cast(sum(size) over (partition by asset_id order by seq) as bigint) - size
        + case when asset_id % 10 = 3 and seq = 2 then 1 else 0 end off
        from (select conv_id asset_id, turn seq, role as type, length(text) + 8 size from conversations)""",
    "box_lengths": """select conv_id asset_id, cast(sum(length(text) + 8) as bigint) + case when conv_id % 7 = 4 then 5 else 0 end file_len
        from conversations group by conv_id""",
    "png_chunks": """select conv_id asset_id, turn seq,
        case when turn = 0 and conv_id % 13 <> 0 then 'IHDR' when turn > 2 and length(text) % 3 = 0 then 'IEND' else 'IDAT' end as type,
        case when turn = 0 then 13 + case when conv_id % 5 = 1 then 1 else 0 end
        when turn > 2 and length(text) % 3 = 0 then 0 else length(text) end length,
        case conv_id % 3 when 0 then 8 when 1 then 16 else 4 end bit_depth,
        case conv_id % 4 when 0 then 2 when 1 then 3 else 6 end color_type from conversations""",
    "options": """select o_custkey as owner, cast(o_orderkey % 5 + 1 as int) priority, concat('key', o_orderkey % 4) k,
        case when o_orderkey % 3 = 0 then null else o_orderpriority end v, o_orderkey ord from orders""",
    "strip_options": """select c_custkey as owner, c_custkey % 2 = 0 gps, c_custkey % 3 = 0 "time", c_custkey % 5 = 0 camera,
        c_custkey % 7 = 0 exif, c_custkey % 11 < 5 xmp, case c_custkey % 4 when 0 then 'StripAll' else 'Keep' end as mode from customer""",
    "cases": """select p_partkey case_id, unnest(['brand','type','size']) axis, unnest([p_brand, p_type, cast(p_size as varchar)]) val from part""",
    "cases_wide": "select p_partkey case_id, p_brand brand, p_type as type, cast(p_size as varchar) size from part",
    "cache": """select case when page_id % 4 = 1 then concat(url, '.old') else url end path,
        page_id % 50 + case when page_id % 6 = 0 then 1 else 0 end mtime, html json,
        timestamp '2024-01-03 00:00:00' - to_hours(cast(page_id % 40 as int)) * 24 probed_at from pages""",
    "probe_inputs": "select page_id asset_id, url path, page_id % 50 mtime from pages",
}


def with_views(body: str) -> str:
    """Prefix a query with the views it names, dependencies first."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, sql in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit_one(name, sql)

    def visit_one(name: str, sql: str) -> None:
        for other, inner in VIEWS.items():
            if other != name and other not in needed and re.search(rf"\b{other}\b", sql):
                visit_one(other, inner)
        if name not in needed:
            needed.append(name)

    visit(body)
    if not needed:
        return body
    ctes = ", ".join(f"{n} as ({VIEWS[n]})" for n in needed)
    if re.match(r"\s*with\s", body, re.I):
        return f"with {ctes}, " + re.sub(r"^\s*with\s+", "", body, flags=re.I)
    return f"with {ctes} {body}"
