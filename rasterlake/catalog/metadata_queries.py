"""Tags, ledgers and their sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.catalog.registry import query
from rasterlake.functions import text
from rasterlake.operators import audit, metadata
from rasterlake.session import work_dir
from rasterlake.sources import readers, writers

col = F.col
_CAMERA = "('Make','Model','ISO','FocalLength','FNumber','ExposureTime')"


@query("s03_read_tag_dump", "select concat('/in/', asset_id, '.jpg') file, grp, tag, value from tags")
def _(t):
    dumps = metadata.long_to_map(t.tags).select(F.to_json(F.array(F.map_concat(
        "tags", F.create_map(F.lit("SourceFile"), F.concat(F.lit("/in/"), "asset_id", F.lit(".jpg")))))).alias("js"))
    return readers.tag_dump_rows(dumps, "js")


@query("f09_strip_tags", f"""select asset_id, grp, tag, value from tags where grp <> 'GPS' and tag <> 'DateTimeOriginal' and tag not in {_CAMERA}""")
def _(t):
    return metadata.strip_tags(t.tags, gps=True, time=True, camera=True)


@query("f09_strip_groups", "select asset_id, grp, tag, value from tags where grp = 'ICC_Profile'")
def _(t):
    return metadata.strip_tags(t.tags, exif=True, xmp=True)


@query("f10_strip_descriptive", "select asset_id, grp, tag, value from tags where grp not in ('IFD0','ExifIFD','GPS','XMP')")
def _(t):
    return metadata.strip_descriptive(t.tags)


@query("f11_can_absorb_strip", 'select owner, (gps or xmp) and not "time" and not camera and not exif absorb from strip_options')
def _(t):
    return t.strip_options.select("owner", metadata.can_absorb_strip(*[col(c) for c in ("gps", "time", "camera", "exif", "xmp")]).alias("absorb"))


@query("j12_carry_tags", """select coalesce(s.asset_id, d.asset_id) asset_id, coalesce(s.grp, d.grp) grp, coalesce(s.tag, d.tag) tag,
    coalesce(s.value, d.value) as value, case when s.tag is not null then 'source' else 'product' end origin
    from (select * from tags where grp <> 'GPS') s full join product_tags d on s.asset_id = d.asset_id and s.grp = d.grp and s.tag = d.tag""")
def _(t):
    return metadata.carry_tags(t.tags, t.product_tags, exclude_groups=("GPS",))


@query("j13_backfill_capture_tags", """select coalesce(s.asset_id, d.asset_id) asset_id, coalesce(s.grp, d.grp) grp, coalesce(s.tag, d.tag) tag,
    coalesce(s.value, d.value) as value, case when s.tag is not null then 'source' else 'product' end origin
    from (select * from tags where tag in ('DateTimeOriginal') or grp = 'GPS') s full join product_tags d on s.asset_id = d.asset_id and s.grp = d.grp and s.tag = d.tag""")
def _(t):
    return metadata.backfill_capture_tags(t.tags, t.product_tags, camera=True, xmp=True)


@query("j15_tag_coverage_diff", """select *, case when status = 'differs' then round(abs(try_cast(src_value as double)-try_cast(dst_value as double))/greatest(abs(try_cast(src_value as double)),1e-9), 6) end rel_dev
    from (select coalesce(s.asset_id, d.asset_id) asset_id, coalesce(s.grp, d.grp) grp, coalesce(s.tag, d.tag) tag, s.value src_value, d.value dst_value,
    case when s.value is null then 'extra' when s.value = d.value then 'present' when d.value is not null then 'differs'
    when s.tag = 'FocalLength' and s.value = '0' or s.tag = 'FNumber' and s.value = 'undef (0/0)' then 'empty_skipped' when s.tag = 'ISO' then 'waived' else 'missing' end status
    from tags s full join product_tags d on s.asset_id = d.asset_id and s.grp = d.grp and s.tag = d.tag)""")
def _(t):
    out = metadata.tag_coverage_diff(t.tags, t.product_tags, waived=("ISO",))
    return out.withColumn("rel_dev", F.round("rel_dev", 6))


_BYTE_TAG = "case when tag = 'Model' and asset_id % 4 = 0 then 'BitsPerSample' when tag = 'Model' and asset_id % 4 = 1 then 'Software' else tag end"


@query("j15_standard_scope", f"""with s as (select asset_id, grp, {_BYTE_TAG} tag, value from tags)
    select status, count(*) n, count(distinct asset_id) assets from (
    select coalesce(s.asset_id, d.asset_id) asset_id, case when s.value is null then 'extra'
    when not (s.grp in ('ExifIFD', 'GPS', 'InteropIFD') or s.grp = 'IFD0' and s.tag in ('Make', 'Model', 'Software')) then 'not_standard'
    when s.value = d.value then 'present' when d.value is not null then 'differs'
    when s.tag = 'FocalLength' and s.value = '0' or s.tag = 'FNumber' and s.value = 'undef (0/0)' then 'empty_skipped' when s.tag = 'ISO' then 'waived' else 'missing' end status
    from s full join product_tags d on s.asset_id = d.asset_id and s.grp = d.grp and s.tag = d.tag) group by status""")
def _(t):
    """Profiles, descriptions of vendors and byte layout leave the denominator."""
    src = t.tags.withColumn("tag", F.expr(_BYTE_TAG))
    out = metadata.tag_coverage_diff(src, t.product_tags, waived=("ISO",), standard=True)
    per = out.groupBy("status", "asset_id").agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy("status").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("assets"))


_RULES = [
    ("M1", "^(Make|Model)$", "^Brand#1", "identity", "carry_verified", "verified"),
    ("M2", "^(Make|Model)$", None, "identity", "carry_indirect", "source_inferred"),
    ("E1", "^(ISO|FocalLength|Date.*)$", None, "exposure", "carry_verified", "verified"),
    ("G1", "^gps", None, "position", "policy_discarded", "source_inferred"),
]


@query("j20_first_rule", """with m as (select asset_id, max(case when tag = 'Make' then value end) make from tags group by asset_id)
    select asset_id, grp, tag, value, make, rule, case rule when 'M1' then 'identity' when 'M2' then 'identity' when 'E1' then 'exposure' when 'G1' then 'position' else 'unknown' end cls,
    case rule when 'M1' then 'carry_verified' when 'M2' then 'carry_indirect' when 'E1' then 'carry_verified' when 'G1' then 'policy_discarded' else 'unaudited' end disposition,
    case rule when 'M1' then 'verified' when 'M2' then 'source_inferred' when 'E1' then 'verified' when 'G1' then 'source_inferred' else 'pending' end as level
    from (select tags.*, make, case when tag in ('Make','Model') and make like 'Brand#1%' then 'M1' when tag in ('Make','Model') then 'M2'
    when tag in ('ISO','FocalLength') or tag like 'Date%' then 'E1' when lower(tag) like 'gps%' then 'G1' else 'none' end rule from tags join m using (asset_id))""")
def _(t):
    return _ruled(t)


def _ruled(t):
    return metadata.first_rule(t.tags_with_make, _RULES)


@query("j21_override_rule", """select asset_id, grp, tag, value, cls, case when cls = 'position' and asset_id % 2 = 0 then 'drop_no_carrier' else disposition end disposition,
    case when cls = 'position' and asset_id % 2 = 0 then 'verified' else level end as level, cls = 'position' and asset_id % 2 = 0 overridden from ledger""")
def _(t):
    # Crop evidence per file: an even asset has a reading, an odd one has none.
    evidence = t.part.select(
        col("p_partkey").alias("asset_id"), F.lit("position").alias("cls"),
        F.when(col("p_partkey") % 2 == 0, "drop_no_carrier").alias("new_disposition"),
        F.when(col("p_partkey") % 2 == 0, "verified").alias("new_level"))
    return metadata.override_rule(t.ledger, evidence)


@query("j26_version_diff", """select coalesce(s.asset_id, d.asset_id) asset_id, coalesce(s.grp, d.grp) grp, coalesce(s.tag, d.tag) tag, s.value "before", d.value "after",
    case when s.value is null then 'added' when d.value is null then 'removed' else 'changed' end change
    from tags s full join product_tags d on s.asset_id = d.asset_id and s.grp = d.grp and s.tag = d.tag where s.value is distinct from d.value""")
def _(t):
    return metadata.version_diff(t.tags, t.product_tags)


@query("u05_missing_required", """select asset_id, tag from tags where not (tag = 'FocalLength' and value = '0' or tag = 'FNumber' and value = 'undef (0/0)') and tag <> 'Label'
    except select asset_id, tag from product_tags""")
def _(t):
    return metadata.missing_required(t.tags, t.product_tags, waived=("Label",))


@query("u06_covered_common", "select asset_id, tag from tags intersect select asset_id, tag from product_tags")
def _(t):
    return metadata.covered_common(t.tags, t.product_tags)


@query("r04_tags_long_to_map", """select asset_id, count(*) n, string_agg(concat(grp, ':', tag, '=', value), '|' order by concat(grp, ':', tag)) flat from tags group by asset_id""")
def _(t):
    flat = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return metadata.long_to_map(t.tags).select("asset_id", F.size("tags").cast("long").alias("n"), flat.alias("flat"))


@query("r04_map_to_long", "select asset_id, grp, tag, value from tags")
def _(t):
    return metadata.map_to_long(metadata.long_to_map(t.tags))


# --- ledgers -------------------------------------------------------------------
_SUM = " union all ".join(
    f"select '{d}' dimension, {d} member, count(*) n, round(count(case when disposition <> 'unaudited' then 1 end)::double/count(*), 6) audited_share from {{src}} group by {d}"
    for d in ("disposition", "cls", '"level"', "rule", "make")).replace("'\"level\"'", "'level'")
_RULED_SQL = """r as (select tags.*, m.make, case when tag in ('Make','Model') and m.make like 'Brand#1%' then 'M1' when tag in ('Make','Model') then 'M2'
    when tag in ('ISO','FocalLength') or tag like 'Date%' then 'E1' when lower(tag) like 'gps%' then 'G1' else 'none' end rule
    from tags join (select p_partkey asset_id, p_brand make from part) m using (asset_id)),
    l as (select *, case rule when 'M1' then 'identity' when 'M2' then 'identity' when 'E1' then 'exposure' when 'G1' then 'position' else 'unknown' end cls,
    case rule when 'M1' then 'carry_verified' when 'M2' then 'carry_indirect' when 'E1' then 'carry_verified' when 'G1' then 'policy_discarded' else 'unaudited' end disposition,
    case rule when 'M1' then 'verified' when 'M2' then 'source_inferred' when 'E1' then 'verified' when 'G1' then 'source_inferred' else 'pending' end "level" from r)"""


@query("a16_ledger_summary", f"""with {_RULED_SQL} {_SUM.format(src='l')} union all
    select 'total', null, count(*), round(count(case when disposition <> 'unaudited' then 1 end)::double/count(*), 6) from l""")
def _(t):
    return audit.ledger_summary(_ruled(t)).withColumn("audited_share", F.round("audited_share", 6))


@query("a16_ledger_consistent", "select true consistent, count(*) total from tags")
def _(t):
    return audit.ledger_consistent(audit.ledger_summary(_ruled(t)))


@query("a17_ledger_crosstab", "select disposition, cls, count(*) n from ledger group by 1, 2")
def _(t):
    return audit.ledger_crosstab(t.ledger)


@query("t01_most_common", "select value, count(*) n from ledger group by value order by n desc, value limit 10")
def _(t):
    return audit.most_common(t.ledger, "value", 10)


def _full_ledger(t):
    ruled = _ruled(t)
    have = {
        "file": F.concat(F.lit("/in/"), col("asset_id"), F.lit(".dng")), "make": col("make"), "model": F.lit(""),
        "group": col("grp"), "tag": col("tag"), "value": col("value"), "value_sha8": text.value_digest(col("value")),
        "cls": col("cls"), "disposition": col("disposition"), "level": col("level"), "rule": col("rule"),
    }
    from rasterlake.model import LEDGER_FIELDS
    return ruled.select(*[have.get(f, F.lit(None).cast("string")).alias(f) for f in LEDGER_FIELDS])


@query("s06_read_ledger_csv", f"""with {_RULED_SQL} select concat('/in/', asset_id, '.dng') file, make, tag, value, substr(sha256(value), 1, 8) value_sha8, cls, disposition, "level", rule from l""")
def _(t):
    folder = work_dir(t.spark, "ledger")
    writers.write_ledger(_full_ledger(t), folder)
    return readers.read_ledger_csv(t.spark, f"{folder}/ledger").select(
        "file", "make", "tag", "value", "value_sha8", "cls", "disposition", "level", "rule")


@query("s07_write_ledger", f"""with {_RULED_SQL} {_SUM.format(src='l')} union all
    select 'total', null, count(*), round(count(case when disposition <> 'unaudited' then 1 end)::double/count(*), 6) from l""")
def _(t):
    folder = work_dir(t.spark, "ledger")
    writers.write_ledger(_full_ledger(t), folder)
    summary = t.spark.read.schema("dimension string, member string, n bigint, audited_share double").json(f"{folder}/summary")
    return summary.withColumn("audited_share", F.round("audited_share", 6))
