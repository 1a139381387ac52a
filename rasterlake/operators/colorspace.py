"""Colour spaces: lookups, identification, gamut tests and the pixel transform."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.functions import color, matrices
from rasterlake.functions.curves import Curve, clamp, decode_codes, to_linear
from rasterlake.functions.media import accepts_cicp, lower_token
from rasterlake.model import CAPS_FIELDS, PRIMARIES, caps_map, constant_table, primaries_dim

# --- fixed values: identification order and tolerance -------------------------
KNOWN_SPACES = ("bt709", "bt2020", "smpte432", "smpte431", "bt470bg")
#: Named spaces behind them. Others of the names (sRGB, Display P3, BT.2020) have the primaries of a token, which comes first; ColorMatch RGB has none on record.
NAMED_SPACES = {
    "Adobe RGB": ((0.640, 0.330), (0.210, 0.710), (0.150, 0.060), (0.3127, 0.3290)),
    "ProPhoto RGB": ((0.7347, 0.2653), (0.1596, 0.8404), (0.0366, 0.0001), (0.3457, 0.3585)),
}
KNOWN_TOLERANCE = 2e-3
# --- fixed values: superset candidates in order -------------------------------
SDR_SUPERSETS = (
    ("bt709", "iec61966-2-1"), ("smpte432", "iec61966-2-1"), ("bt709", "bt709"),
    ("smpte432", "bt709"), ("bt2020", "bt709"),
)


def lookup_caps(assets: DataFrame, fmt: str = "format") -> DataFrame:
    """Container capabilities; an unknown container gets the most conservative row."""
    token = F.lower(F.ltrim(F.trim(F.col(fmt)), F.lit(".")))
    found = assets.withColumn("__caps", F.try_element_at(caps_map(), token))
    filled = [
        F.coalesce(F.col(f"__caps.{f}"), F.lit(8) if f == "max_bit_depth" else F.lit(False)).alias(f) for f in CAPS_FIELDS]
    return found.select(*assets.columns, F.col("__caps").isNotNull().alias("known_format"), *filled)


def lookup_primaries(assets: DataFrame, token: str, prefix: str = "") -> DataFrame:
    """Chromaticities and matrices of a token or alias; unknown stays null."""
    dim = primaries_dim(assets.sparkSession).select(
        F.col("alias").alias("__alias"),
        *[F.col(c).alias(prefix + c) for c in ("token", "xy", "to_xyz", "d50", "xy_d50")])
    return assets.join(F.broadcast(dim), lower_token(F.col(token)) == F.col("__alias"), "left").drop("__alias")


def known_spaces() -> list[tuple[str, tuple]]:
    """Name and D50 colorants of every space that is recognised, in order."""
    return [(t, matrices.colorants_d50(*PRIMARIES[t])) for t in KNOWN_SPACES] + [(n, matrices.colorants_d50(*p)) for n, p in NAMED_SPACES.items()]


def nearest_known_space(profiles: DataFrame, cells: list[str], tol: float = KNOWN_TOLERANCE) -> DataFrame:
    """Best match of a measured colorant matrix, accepted within the tolerance.

    The handful of known matrices is an array literal, so the comparison is a
    projection: no join at all, and ties go to the earlier space.
    """
    options = []
    for rank, (token, ref) in enumerate(known_spaces()):
        err = F.greatest(*[F.abs(F.col(c) - v) for c, v in zip(cells, ref)])
        options.append(F.struct(err.alias("err"), F.lit(rank).alias("rank"), F.lit(token).alias("token")))
    best = F.array_min(F.array(*options))
    return profiles.withColumn("__best", best).select(
        *profiles.columns, F.col("__best.err").alias("err"),
        F.when(F.col("__best.err") <= tol, F.col("__best.token")).alias("space"),
    )


def gamut_relation(assets: DataFrame, src: str, dst: str) -> DataFrame:
    """Is the source gamut inside the target's? Null when either is unknown."""
    both = lookup_primaries(lookup_primaries(assets, src, "src_"), dst, "dst_")
    at = [F.get("src_xy_d50", F.lit(i)) for i in range(6)], [F.get("dst_xy_d50", F.lit(i)) for i in range(6)]
    return both.withColumn("contained", color.gamut_contains(*at)).select(*assets.columns, "contained")


def narrowest_superset(assets: DataFrame, primaries: str = "primaries", transfer: str = "transfer") -> DataFrame:
    """First candidate the container accepts and that contains the source gamut."""
    known = lookup_primaries(lookup_caps(assets), primaries, "src_")
    hdr = F.col(transfer).isin("smpte2084", "arib-std-b67")

    def fits(token, curve):
        inside = color.token_contained(F.col("src_token"), F.lit(token))
        return F.coalesce(accepts_cicp(F.lower("format"), F.lit(token), curve, F.col("can_cicp")) & inside, F.lit(False))

    def option(token, curve):
        return F.struct(F.lit(token).alias("primaries"), curve.alias("transfer"))

    curve = F.col(transfer)
    choice = F.when(hdr & fits("bt2020", curve), option("bt2020", curve))
    for token, name in SDR_SUPERSETS:
        choice = choice.when(~hdr & fits(token, F.lit(name)), option(token, F.lit(name)))
    known = known.withColumn("__pick", F.when(F.col(transfer).isNotNull(), choice))
    return known.select(
        *assets.columns, F.col("__pick.primaries").alias("superset_primaries"),
        F.col("__pick.transfer").alias("superset_transfer"))


def conversion_matrices(assets: DataFrame, src: str, dst: str) -> DataFrame:
    """Linear matrix between two primaries per row, null when either is unknown
    or both are the same space.

    Both tokens come from a fixed table, so the matrices of all pairs are a
    constant dimension too (81 rows) and a row costs two small broadcast joins.
    """
    spark = assets.sparkSession
    pairs = constant_table(
        spark, [(a, b, *matrices.between(PRIMARIES[a], PRIMARIES[b])) for a in PRIMARIES for b in PRIMARIES if a != b],
        ("__s", "__d", *[f"m{i // 3}{i % 3}" for i in range(9)]))
    both = lookup_primaries(lookup_primaries(assets, src, "src_"), dst, "dst_")
    return both.join(
        F.broadcast(pairs), (F.col("src_token") == F.col("__s")) & (F.col("dst_token") == F.col("__d")), "left",
    ).select(*assets.columns, *[f"m{i // 3}{i % 3}" for i in range(9)])


def matrix_row_sum_check(mats: DataFrame, cells: list[str], tol: float = 5e-3) -> DataFrame:
    """Largest deviation of the row sums from one."""
    dev = F.greatest(*[
        F.abs(F.col(cells[3 * i]) + F.col(cells[3 * i + 1]) + F.col(cells[3 * i + 2]) - 1.0) for i in range(3)])
    return mats.withColumn("max_dev", dev).withColumn("ok", F.col("max_dev") <= tol)


@dataclass(frozen=True)
class Transform:
    """One lowered plan: everything is a literal, so each plan compiles to one
    fused projection with the unused steps folded away."""

    src: Curve
    dst: Curve
    matrix: tuple | None = None
    linear_scale: float = 1.0
    encode_scale: float = 1.0
    tone: str | None = None
    peak_nits: float = 1000.0
    gamut_keep: float | None = None
    luminances: tuple = color.LUMA_709
    src_scene_peak: float | None = None
    dst_scene_peak: float | None = None
    dither: bool = False


def transform_pixels(px: DataFrame, plan: Transform, code_max: float = 255.0) -> DataFrame:
    """Decode, scene to display, scale, tone, matrix, gamut, encode scale,
    display to scene, clamp, encode and dither, in that order."""
    keep = [c for c in px.columns if c not in "rgb"]
    let = color.Stages(px)
    by_table = code_max == 255.0 and plan.src.kind not in ("linear", "table")
    rgb = let.triple("lin", [
        decode_codes(F.col(c), plan.src) if by_table else to_linear(F.col(c) / code_max, plan.src, let) for c in "rgb"])
    if plan.src_scene_peak:
        rgb = let.triple("disp", [v / plan.src_scene_peak for v in color.ootf(rgb, plan.src_scene_peak, let)])
    if plan.linear_scale != 1.0:
        rgb = let.triple("scaled", [v * plan.linear_scale for v in rgb])
    if plan.tone:
        rgb = let.triple("tone", color.tone_map(rgb, plan.tone, plan.peak_nits, plan.dst, let=let))
    if plan.matrix:
        rgb = let.triple("mat", color.apply_matrix(rgb, plan.matrix))
    if plan.gamut_keep is not None:
        rgb = let.triple("gam", color.gamut_compress(rgb, plan.luminances, plan.gamut_keep, let))
    if plan.encode_scale != 1.0:
        rgb = let.triple("enc", [v * plan.encode_scale for v in rgb])
    if plan.dst_scene_peak:
        nits = [v * plan.dst_scene_peak for v in rgb]
        rgb = let.triple("scene", color.ootf_inverse(nits, plan.dst_scene_peak, let))
    offset = color.dither_offset(F.col("x"), F.col("y")) if plan.dither else 0.0
    codes = [color.encode16(v, plan.dst, let).cast("double") for v in rgb]
    out = [color.quantize8(v, offset).alias(c) for v, c in zip(codes, "rgb")]
    return let.df.select(*keep, *out)
