"""Metadata tags as a long table: asset_id, grp, tag, value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.model import CAMERA_TAGS, CAPTURE_CAMERA_TAGS, CAPTURE_TAGS, CAPTURE_TIME_TAGS
from rasterlake.operators.skew import attach

KEY = ["asset_id", "grp", "tag"]
EXIF_GROUPS = ("IFD0", "IFD1", "ExifIFD", "InteropIFD", "GPS")
DESCRIPTIVE_GROUPS = (*EXIF_GROUPS, "XMP", "IPTC")
# --- fixed values: the only tags that may be absent when empty or zero ---------
OMIT_IF_EMPTY = ("ImageDescription", "FNumber", "FocalLength", "UserComment", "FocalLengthIn35mmFormat")
# --- fixed values: words that say a value is none ------------------------------
EMPTY_WORDS = ("", "(none)", "-", "ASCII", "UNICODE", "JIS", "Undefined", "(0/0)", "undef (0/0)")
# --- fixed values: tags that locate the preview in their own file --------------
LAYOUT_TAGS = ("ThumbnailOffset", "ThumbnailLength")
# --- fixed values: tags that hold byte offsets of their own file --------------
OFFSET_TAGS = ("StripOffsets", "StripByteCounts", "ThumbnailOffset", "ThumbnailLength", "PreviewImageStart")


def _is_empty(value: Column) -> Column:
    """One of the words for none, or a number that is zero, also as a fraction of nothing."""
    bare = F.trim(F.regexp_replace(value, r"\s+", " "))
    above = F.regexp_extract(bare, r"[(]([0-9]+)/[0-9]+[)]$", 1)
    return bare.isin(*EMPTY_WORDS) | (bare.try_cast("double") == 0).eqNullSafe(True) | (above == "0")


def _numbers(value: Column) -> Column:
    """The numbers of a value of numbers alone, else null."""
    parts = F.transform(F.split(F.trim(value), r"[\s,]+"), lambda x: x.try_cast("double"))
    return F.when(~F.exists(parts, lambda x: x.isNull()), parts)


def relative_deviation(a: Column, b: Column) -> Column:
    """The greatest relative deviation of numbers in the same places; null for unlike values."""
    x, y = _numbers(a), _numbers(b)
    return F.when(F.size(x) == F.size(y), F.array_max(F.zip_with(
        x, y, lambda p, q: F.abs(p - q) / F.greatest(F.abs(p), F.lit(1e-9)))))


def _time_tag(tag: Column) -> Column:
    return tag.rlike("(Date|Time)") & ~tag.isin("ExposureTime")


def strip_tags(tags: DataFrame, gps=False, time=False, camera=False, exif=False, xmp=False) -> DataFrame:
    """Privacy clean. The rules are constants, so they are one predicate on the
    scan rather than an anti join."""
    drop = F.lit(False)
    if gps:
        drop = drop | (F.col("grp") == "GPS")
    if time:
        drop = drop | _time_tag(F.col("tag"))
    if camera:
        drop = drop | F.col("tag").isin(*CAMERA_TAGS)
    if exif:
        drop = drop | F.col("grp").isin(*EXIF_GROUPS)
    if xmp:
        drop = drop | (F.col("grp") == "XMP")
    return tags.where(~drop)


def strip_descriptive(tags: DataFrame) -> DataFrame:
    return tags.where(~F.col("grp").isin(*DESCRIPTIVE_GROUPS))


def can_absorb_strip(gps: Column, time: Column, camera: Column, exif: Column, xmp: Column) -> Column:
    return (gps | xmp) & ~time & ~camera & ~exif


#: Parts that the rows of one key are dealt to.
SPREAD = 64


def _dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows over the partitions of a shuffle, those of a repeated key over many of them.

    An aggregate combines in every task before it shuffles, and what it needs there grows with the task's rows. A task
    that reads a file has as many as the file's split expands to; behind a shuffle it has a partition's.
    """
    place = F.monotonically_increasing_id() % SPREAD
    return rows.withColumn("__place", place).repartition(*keys, "__place").drop("__place")


def carry_tags(src: DataFrame, dst: DataFrame, exclude_groups=(), drop_orientation: bool = True) -> DataFrame:
    """Copy source tags into a product; product tags not overwritten stay.

    One aggregation on (asset, group, tag) picks the source value where there
    is one; repeats are combined in each task before it shuffles.
    """
    carried = src.where(~F.col("grp").isin(*exclude_groups) if exclude_groups else F.lit(True))
    if drop_orientation:
        carried = carried.where(F.col("tag") != "Orientation")
    return _overlay(carried, dst)


def _overlay(top: DataFrame, base: DataFrame) -> DataFrame:
    both = top.select(*KEY, F.struct(F.lit(0).alias("rank"), "value").alias("v")).unionByName(
        base.select(*KEY, F.struct(F.lit(1).alias("rank"), "value").alias("v")))
    picked = _dealt(both, KEY).groupBy(*KEY).agg(F.min("v").alias("v"))
    return picked.select(
        *KEY, F.col("v.value").alias("value"),
        F.when(F.col("v.rank") == 0, "source").otherwise("product").alias("origin"))


def capture_whitelist(time=False, camera=False, gps=False, xmp=False) -> Column:
    """Which fields may be restored, given what the caller strips."""
    tags = [*CAPTURE_TAGS]
    if not time:
        tags += CAPTURE_TIME_TAGS
    if not camera:
        tags += CAPTURE_CAMERA_TAGS
    keep = F.col("tag").isin(*tags) & ~F.col("grp").isin("GPS", "XMP")
    if not gps:
        keep = keep | (F.col("grp") == "GPS")
    if not xmp:
        keep = keep | (F.col("grp") == "XMP")
    return keep


def backfill_capture_tags(original: DataFrame, product: DataFrame, **strip: bool) -> DataFrame:
    return _overlay(original.where(capture_whitelist(**strip)), product)


def _side_by_side(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """The full join of two tag tables on their key, as one aggregation.

    A repeated tag counts once per side, as in a dictionary, so repeats are
    combined before the shuffle and never pair up with each other.
    """
    both = left.select(*KEY, F.col("value").alias(a), F.lit(None).cast("string").alias(b)).unionByName(
        right.select(*KEY, F.lit(None).cast("string").alias(a), F.col("value").alias(b)))
    return _dealt(both, KEY).groupBy(*KEY).agg(F.max(a).alias(a), F.max(b).alias(b))


# --- fixed values: groups of the public registry, and what describes the picture in IFD0 ---------
STANDARD_GROUPS = ("IFD0", "ExifIFD", "GPS", "InteropIFD")
IFD0_DESCRIPTIVE = (
    "ImageDescription", "Make", "Model", "Orientation", "XResolution", "YResolution", "ResolutionUnit", "Software", "ModifyDate", "Artist", "Copyright",
)


def is_standard(grp: Column, tag: Column) -> Column:
    """Has the tag a place in the registry that a product must keep? Vendors' groups have none, and other
    IFD0 tags describe how their own file lies in bytes."""
    return F.coalesce(grp.isin(*STANDARD_GROUPS) & ((grp != "IFD0") | tag.isin(*IFD0_DESCRIPTIVE)), F.lit(False))


def tag_coverage_diff(src: DataFrame, dst: DataFrame, waived=(), standard: bool = False) -> DataFrame:
    """Status of each standard tag: present, differs, waived, empty, layout or missing.

    standard: source tags without a place in the registry are `not_standard`, whatever became of them.
    """
    both = _side_by_side(src, dst, "src_value", "dst_value")
    deviation = relative_deviation(F.col("src_value"), F.col("dst_value"))
    empty = F.col("tag").isin(*OMIT_IF_EMPTY) & _is_empty(F.col("src_value"))
    status = (
        F.when(F.col("src_value").isNull(), "extra")
        .when(F.lit(standard) & ~is_standard(F.col("grp"), F.col("tag")), "not_standard")
        .when(F.col("dst_value").isNotNull() & (F.col("src_value") == F.col("dst_value")), "present")
        .when(F.col("dst_value").isNotNull(), "differs")
        .when(empty, "empty_skipped")
        .when(F.col("tag").isin(*LAYOUT_TAGS), "layout")
        .when(F.col("tag").isin(*waived) if waived else F.lit(False), "waived")
        .otherwise("missing")
    )
    return both.withColumn("status", status).withColumn(
        "rel_dev", F.when(F.col("status") == "differs", deviation))


def missing_required(required: DataFrame, present: DataFrame, waived=()) -> DataFrame:
    """Required minus present (asset, tag) pairs, but for waived tags, those that
    locate data in their own file, and empty values of the few tags that may go then."""
    spared = F.col("tag").isin(*LAYOUT_TAGS, *waived) | (F.col("tag").isin(*OMIT_IF_EMPTY) & _is_empty(F.col("value")))
    return _pairs(required.where(~F.coalesce(spared, F.lit(False))), present).where("in_a and not in_b").select("asset_id", "tag")


def covered_common(a: DataFrame, b: DataFrame) -> DataFrame:
    return _pairs(a, b).where("in_a and in_b").select("asset_id", "tag")


def _pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """The distinct (asset, tag) pairs of both tables and where each is.

    One aggregation in place of a join: an expanded table looks small to the optimiser, which would send it whole through the driver.
    """
    keys = ["asset_id", "tag"]
    both = a.select(*keys, F.lit(True).alias("in_a")).unionByName(b.select(*keys, F.lit(False).alias("in_a")))
    return _dealt(both, keys).groupBy(*keys).agg(F.max("in_a").alias("in_a"), (~F.min("in_a")).alias("in_b"))


def version_diff(base: DataFrame, current: DataFrame) -> DataFrame:
    """Tags that changed between two versions; offset tags never count."""
    both = _side_by_side(base, current, "before", "after").where(~F.col("tag").isin(*OFFSET_TAGS))
    changed = both.where(~F.col("before").eqNullSafe(F.col("after")))
    return changed.withColumn(
        "change",
        F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed"))


def long_to_map(tags: DataFrame) -> DataFrame:
    """One map per asset.

    Duplicates of a tag are reduced to one value before the maps are built, so
    a map is bounded by the tag vocabulary, not by the number of rows.
    """
    named = tags.select("asset_id", F.concat_ws(":", "grp", "tag").alias("name"), "value")
    single = _dealt(named, ["asset_id", "name"]).groupBy("asset_id", "name").agg(F.max("value").alias("value"))
    return single.groupBy("asset_id").agg(
        F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("tags"))


def map_to_long(maps: DataFrame) -> DataFrame:
    return maps.select("asset_id", F.explode("tags").alias("name", "value")).select(
        "asset_id", F.substring_index("name", ":", 1).alias("grp"),
        F.regexp_replace("name", "^[^:]*:", "").alias("tag"), "value")


def first_rule(ledger: DataFrame, rules, default="unaudited") -> DataFrame:
    """First matching rule wins; no rule means unaudited.

    rules: (rule, tag pattern, make pattern or None, class, disposition, level)
    in order. The list is code, so matching is one CASE ladder: no row is
    multiplied by the number of rules.
    """

    # Find the rule once, then look its fields up by position.
    position = None
    for i, rule in enumerate(rules):
        hit = F.col("tag").rlike(f"(?i){rule[1]}")
        if rule[2]:
            hit = hit & F.coalesce(F.col("make").rlike(f"(?i){rule[2]}"), F.lit(False))
        position = F.when(hit, i) if position is None else position.when(hit, i)

    def field(index, missing):
        table = F.array(*[F.lit(r[index]) for r in rules])
        return F.coalesce(F.get(table, F.col("__rule")), F.lit(missing))

    return ledger.withColumn("__rule", position).select(
        *ledger.columns, field(0, "none").alias("rule"), field(3, "unknown").alias("cls"),
        field(4, default).alias("disposition"), field(5, "pending").alias("level"))


def override_rule(ledger: DataFrame, evidence: DataFrame) -> DataFrame:
    """Replace dispositions of one class where per-file evidence exists.

    evidence: asset_id, cls, new_disposition, new_level, one row per file.
    """
    joined = attach(ledger, evidence, ["asset_id", "cls"], ["grp", "tag", "value"], "left")
    return joined.withColumn("disposition", F.coalesce("new_disposition", "disposition")).withColumn(
        "level", F.coalesce("new_level", "level")).withColumn(
        "overridden", F.col("new_disposition").isNotNull()).drop("new_disposition", "new_level")
