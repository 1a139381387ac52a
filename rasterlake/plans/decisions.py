"""Conversion decisions, one row per asset and requested target.

Each function adds columns by ordered CASE ladders over fixed dimensions. A
missing fact stays null and leads to Reject, never to a guessed default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.functions import color
from rasterlake.functions.curves import SDR_WHITE_NITS
from rasterlake.functions.media import (
    HDR_TRANSFERS, accepts_cicp, is_hdr, literal_map, norm_primaries, norm_transfer,
)
from rasterlake.model import profile_dim
from rasterlake.operators.colorspace import lookup_caps, lookup_primaries

# --- fixed values: requested target -> (primaries, transfer) it is written with -
TARGETS = {
    "srgb": ("bt709", "iec61966-2-1"),
    "bt709": ("bt709", "bt709"),
    "display-p3": ("smpte432", "iec61966-2-1"),
    "dci-p3": ("bt2020", "bt709"),
    "p3-pq": ("bt2020", "smpte2084"),
    "p3-hlg": ("bt2020", "arib-std-b67"),
    "bt2020-pq": ("bt2020", "smpte2084"),
    "bt2020-hlg": ("bt2020", "arib-std-b67"),
    "bt2020": ("bt2020", "bt709"),
    "adobe-rgb": ("bt2020", "bt709"),
    "prophoto-rgb": ("bt2020", "bt709"),
    "colormatch-rgb": ("bt2020", "bt709"),
}
# --- fixed values: tokens of one curve, and of one set of primaries ------------
SAME_CURVE = {"smpte170m": "bt709", "bt2020-10": "bt709", "bt2020-12": "bt709"}
SAME_PRIMARIES = {"smpte240m": "smpte170m"}
SDR_ONLY_FORMATS = ("tiff", "tif", "jpg", "jpeg", "webp")
HDR_NATIVE_FORMATS = ("avif", "jxl", "jxr")
MAPPABLE_TRANSFERS = (
    "iec61966-2-1", "bt709", "smpte170m", "smpte240m", "bt470m", "bt470bg",
    "linear", "smpte2084", "arib-std-b67",
)
# --- fixed values: (format, matrix token) -> capability -----------------------
OUT_MATRIX = {
    "jpg": {"bt470bg": "Redundant", "smpte170m": "Redundant"},
    "jpeg": {"bt470bg": "Redundant", "smpte170m": "Redundant"},
    "jpegli": {"bt470bg": "Redundant", "smpte170m": "Redundant"},
    "webp": {"bt470bg": "Redundant", "smpte170m": "Redundant"},
    "png": {"rgb": "Redundant"},
    "apng": {"rgb": "Redundant"},
    "tiff": {"rgb": "Redundant"},
    "tif": {"rgb": "Redundant"},
    "bmp": {"rgb": "Redundant"},
    "ppm": {"rgb": "Redundant"},
    "gif": {"rgb": "Redundant"},
    "dng": {"rgb": "Redundant"},
    "jxr": {"rgb": "Redundant"},
    "jxl": {"rgb": "Redundant", "xyb": "Carried"},
}
JPEGLI_MATRIX = {"rgb": "Redundant", "xyb": "Carried"}
AVIF_REJECTED = ("ycgco", "fcc", "xyb")


def with_targets(assets: DataFrame, names=(None, *TARGETS)) -> DataFrame:
    """One row per asset and requested target; None asks for no conversion."""
    wanted = F.array(*[F.lit(n) for n in names])
    return assets.withColumn("target", F.explode(wanted))


def with_descriptors(rows: DataFrame) -> DataFrame:
    """Normalised source and target tokens with matrices and capabilities."""
    prim = literal_map({k: v[0] for k, v in TARGETS.items()})
    trc = literal_map({k: v[1] for k, v in TARGETS.items()})
    named = (
        rows.withColumn("src_prim", norm_primaries(F.col("primaries")))
        .withColumn("src_trc", norm_transfer(F.col("transfer")))
        .withColumn("dst_prim", F.try_element_at(prim, F.col("target")))
        .withColumn("dst_trc", F.try_element_at(trc, F.col("target")))
    )
    return lookup_primaries(lookup_primaries(lookup_caps(named), "src_prim", "s_"), "dst_prim", "d_")


def plan_color(rows: DataFrame, allow_gamut: bool = False, icc_available: Column | None = None) -> DataFrame:
    """The action ladder: no target, unknown source, equivalent, no matrix,
    inexpressible curve, then map."""
    d = with_descriptors(rows)
    curve_ok = F.coalesce(F.col("src_trc").isin(*MAPPABLE_TRANSFERS), F.lit(False))
    known = F.col("s_token").isNotNull() & F.col("src_trc").isNotNull()
    # Tokens that name one matrix or one curve are no difference.
    one = lambda c, table: F.coalesce(F.try_element_at(literal_map(table), F.col(c)), F.col(c))
    same_matrix = one("s_token", SAME_PRIMARIES) == one("d_token", SAME_PRIMARIES)
    same_curve = one("src_trc", SAME_CURVE) == one("dst_trc", SAME_CURVE)
    equivalent = F.coalesce(same_matrix & same_curve, F.lit(False))
    carry = F.coalesce(F.col("can_icc") & (icc_available if icc_available is not None else F.lit(False)), F.lit(False))
    action = (
        F.when(F.col("target").isNull(), "None")
        .when(~known, "Reject")
        .when(equivalent, "None")
        .when(F.col("d_token").isNull(), "Reject")
        .when(~curve_ok & carry, "CarryIcc")
        .when(~curve_ok, "Reject")
        .otherwise("Map")
    )
    reason = (
        F.when(F.col("target").isNull(), "no_target")
        .when(~known, "unknown_source")
        .when(equivalent, "equivalent")
        .when(F.col("d_token").isNull(), "no_matrix")
        .when(~curve_ok, "inexpressible_curve")
        .otherwise("map")
    )
    mapped = F.col("action") == "Map"
    needs_curve = F.coalesce(~same_curve, F.lit(False))
    outside = mapped & ~F.coalesce(color.token_contained(F.col("s_token"), F.col("d_token")), F.lit(False))
    needs_matrix = F.coalesce(~same_matrix, F.lit(False))
    return (
        d.withColumn("action", action)
        .withColumn("reason", reason)
        .withColumn("needs_curve_change", mapped & needs_curve)
        .withColumn("outside_gamut", outside)
        .withColumn("gamut_map", F.lit(allow_gamut) & outside)
        .withColumn("needs_dither", mapped & (F.col("max_bit_depth") <= 8) & (needs_matrix | needs_curve))
    )


def resolve_strategy(rows: DataFrame) -> DataFrame:
    """Declared strategy to the effective one, with the reason for an override.

    rows: declared, gain_map_requested, manual_set, transfer, peak_nits, can_icc.
    """
    hdr = is_hdr(F.col("transfer"), F.col("peak_nits"), SDR_WHITE_NITS)
    gm = F.col("gain_map_requested") & (F.col("declared") != "Recommended")
    carry = F.col("declared") == "CarryIcc"
    effective = F.when(gm, F.when(F.col("manual_set"), "Manual").otherwise("Recommended")).otherwise(F.col("declared"))
    reason = (
        F.when(gm, F.when(effective == F.col("declared"), "None").otherwise("GainMapRequiresBaseMapping"))
        .when(~carry, "None")
        .when(hdr, "HdrNoIccCarryPath")
        .when(~F.col("can_icc"), "ContainerCannotCarryIcc")
        .otherwise("None")
    )
    return rows.withColumn("strategy", F.struct(
        F.col("declared").alias("declared"), effective.alias("effective"), reason.alias("reason")))


def carry_profile_outcome(declared: Column, has_icc: Column, can_icc: Column, both: Column) -> Column:
    return (
        F.when((declared != "CarryIcc") | ~has_icc | ~can_icc, "Skip")
        .when(both, "CarryWithCicp")
        .otherwise("CarryIccOnly")
    )


def out_matrix_capability(fmt: Column, token: Column, backend: Column) -> Column:
    t, f = F.trim(token), F.lower(F.ltrim(F.trim(fmt), F.lit(".")))
    table = literal_map({f"{k}|{m}": v for k, row in OUT_MATRIX.items() for m, v in row.items()})
    jpegli = f.isin("jpg", "jpeg", "jpegli") & (backend == "Cjpegli")
    listed = F.coalesce(F.try_element_at(table, F.concat_ws("|", f, t)), F.lit("Rejected"))
    return (
        F.when(token.isNull() | (t == ""), "NotApplicable")
        .when(jpegli, F.coalesce(F.try_element_at(literal_map(JPEGLI_MATRIX), t), F.lit("Rejected")))
        .when((f == "avif") & ((backend != "Ffmpeg") | t.isin(*AVIF_REJECTED)), "Rejected")
        .when(f == "avif", "Carried")
        .otherwise(listed)
    )


def needs_hdr_to_sdr(fmt: Column, transfer: Column, depth: Column, target_transfer: Column) -> Column:
    """HDR input and no HDR target; HDR-native outlets are exempt only while no
    explicit target is set, PNG only above 8 bit."""
    no_target = target_transfer.isNull()
    exempt = no_target & (fmt.isin(*HDR_NATIVE_FORMATS) | (fmt.isin("png", "apng") & (depth > 8)))
    hdr_target = ~fmt.isin(*SDR_ONLY_FORMATS) & target_transfer.isin(*HDR_TRANSFERS)
    hdr_source = F.coalesce(F.lower(transfer).isin(*HDR_TRANSFERS), F.lit(False))
    return hdr_source & ~F.coalesce(exempt, F.lit(False)) & ~F.coalesce(hdr_target, F.lit(False))


# --- fixed values: formats whose RGB outlet is 8 or 16 bit, and sources inside a wide gain-map base -----
TWO_DEPTH_FORMATS = ("png", "apng", "tiff", "jxl")
WIDE_BASE = "bt2020"
WIDE_BASE_COVERS = ("bt709", "smpte432", "bt2020")


def degradations(plans: DataFrame) -> DataFrame:
    """Codes of what actually happened, in fixed order; none for a reject.

    plans: plan_color output plus target_depth, requested_depth, outlet_depth,
    has_icc, attach_icc, out_primaries, gain_map_wanted, tone_requested,
    labelled. With a column gain_map_base, a gain map on a wide base clips nothing
    of a source that names primaries inside of it.
    """
    mapped = F.col("action") == "Map"
    to_eight = mapped & (F.col("outlet_depth") == 8)
    native = F.col("rgb_native") & (F.col("outlet_depth") != F.col("target_depth")) & (
        F.col("target_depth") >= 8) & (F.col("outlet_depth") <= F.col("max_bit_depth"))
    raised = native & (F.col("outlet_depth") > F.col("target_depth"))
    lowered = native & (F.col("outlet_depth") < F.col("target_depth"))
    capped = ~F.col("rgb_native") & (F.col("requested_depth") > F.col("target_depth")) & ~to_eight
    reduced = (to_eight | lowered | capped) & ~raised
    lost_icc = F.col("has_icc") & ~F.col("attach_icc")
    outside = F.col("outside_gamut")
    if "gain_map_base" in plans.columns:
        wide = F.col("gain_map_wanted") & F.col("gain_map") & (F.lower("gain_map_base") == WIDE_BASE)
        covered = wide & ~F.col("has_icc") & F.col("s_token").isin(*WIDE_BASE_COVERS)
        outside = outside & ~F.coalesce(covered, F.lit(False))
    found = F.array_compact(F.array(
        F.when(reduced, F.lit("BitDepthReduced")),
        F.when(raised, F.lit("BitDepthRaised")),
        F.when(outside, F.when(F.col("gamut_map"), "GamutCompressed").otherwise("GamutClipped")),
        F.when(~F.col("labelled") & F.col("unlabeled_srgb"), F.lit("UnlabeledAssumedSrgb")),
        F.when(lost_icc, F.lit("NoIccCarrier")),
        F.when(lost_icc & ~F.col("can_icc"), F.lit("ContainerCannotCarryIcc")),
        F.when(F.col("gain_map_wanted") & F.col("gain_map") & F.col("tone_requested"),
               F.lit("ToneMapNotAppliedToGainMap")),
    ))
    none = F.array().cast("array<string>")
    return plans.withColumn("degradations", F.when(F.col("action") == "Reject", none).otherwise(found))


def with_outlet(plans: DataFrame) -> DataFrame:
    """Depths and labels that degradations() judges, derived from the plan.

    What is passed through in RGB is known to come out with 8 or 16 bit in four formats alone; elsewhere nothing is claimed.
    """
    target = F.least(F.coalesce(F.col("requested_depth"), F.lit(8)), F.col("max_bit_depth"))
    two_depths = (F.col("action") == "Map") | F.lower("format").isin(*TWO_DEPTH_FORMATS)
    rgb_outlet = F.when(~two_depths, F.col("target_depth")).when(F.col("target_depth") <= 8, 8).otherwise(16)
    return (
        plans.withColumn("target_depth", target)
        .withColumn("outlet_depth", F.when(F.col("rgb_native"), rgb_outlet).otherwise(F.col("target_depth")))
        .withColumn("out_primaries", F.when(accepts_cicp(
            F.lower("format"), F.coalesce("d_token", "s_token"), F.coalesce("dst_trc", "src_trc"),
            F.col("can_cicp")), F.coalesce("d_token", "s_token")))
        .withColumn("attach_icc", F.col("has_icc") & F.col("can_icc") & (F.col("action") != "Map"))
        .withColumn("labelled", F.col("out_primaries").isNotNull() | F.col("attach_icc") | F.col("can_icc_from_cicp"))
    )


def verdict(action: Column, codes: Column) -> Column:
    return F.when(action == "Reject", "Reject").when(F.size(codes) > 0, "ProceedWithDegradation").otherwise("Proceed")


def bit_depth_outcome(cells: DataFrame) -> DataFrame:
    """Audit verdict of one grid cell.

    cells: requested, made, rc, raised, reduced, delivered (null = not measurable).
    """
    wrong_raise = F.col("raised") & F.coalesce(F.col("delivered") < F.col("requested"), F.lit(False))
    wrong_reduce = F.col("reduced") & F.coalesce(F.col("delivered") > F.col("requested"), F.lit(False))
    return cells.withColumn(
        "verdict",
        F.when(~F.col("made") & (F.col("rc") != 0), "refused")
        .when(~F.col("made"), "refuse-unclean")
        .when(~F.col("raised") & ~F.col("reduced"), "silent-mismatch")
        .when((F.col("raised") & F.col("reduced")) | wrong_raise | wrong_reduce, "misannounced")
        .when(F.col("raised"), "raised-announced")
        .otherwise("reduced-announced"),
    )


def profile_semantics(assets: DataFrame, profile: str) -> DataFrame:
    dim = profile_dim(assets.sparkSession).withColumnRenamed("profile", "__profile")
    return assets.join(F.broadcast(dim), F.col(profile) == F.col("__profile"), "left").drop("__profile")


def descriptor_confidence(primaries: Column, transfer: Column, named: Column, metric: Column) -> Column:
    """None < CodecDefault < CicpTag < NamedIcc < IccMetric, as 0..4."""

    def real(c):
        return F.coalesce((F.trim(c) != "") & ~F.lower(c).isin("unknown", "unspecified", "reserved"), F.lit(False))

    return (
        F.when(F.coalesce(metric, F.lit(False)), 4)
        .when(named.isNotNull(), 3)
        .when(real(primaries) & real(transfer), 2)
        .when(real(primaries) | real(transfer), 1)
        .otherwise(0)
    )


def thumbnail_gate(mode: Column, strip_exif: Column) -> Column:
    """Why no thumbnail is embedded; null means it is."""
    return F.when(mode == "StripAll", "metadata mode is StripAll").when(strip_exif, "EXIF is being stripped")


def default_backend(rows: DataFrame, tools: DataFrame, fmt: str = "format") -> DataFrame:
    """Backend by format where its tool is available, else the general one.

    tools: tool, available - one row per known tool, three in all.
    """
    needed = literal_map({"jxl": "Cjxl", "jxr": "Jxr", "dng": "Dng"})
    known = tools.where(F.col("tool").isin("Cjxl", "Jxr", "Dng")).groupBy("tool").agg(
        F.bool_or("available").alias("available"))
    # Three entries at most, so one map value serves every row without a join.
    usable = known.agg(F.map_from_entries(F.collect_list(F.struct("tool", "available")))).scalar()
    tool = F.try_element_at(needed, F.lower(F.col(fmt)))
    return rows.withColumn("backend", F.when(F.try_element_at(usable, tool), tool).otherwise("Ffmpeg"))
