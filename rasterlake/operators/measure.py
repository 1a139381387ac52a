"""Content measurements: peaks, gamut fit, gain ranges, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.functions import matrices
from rasterlake.functions.color import LUMA_2020, LUMA_709, M_2020_TO_709, apply_matrix, luma
from rasterlake.functions.curves import Curve, SDR_WHITE_NITS, clamp, to_linear
from rasterlake.operators.ordered import hist_quantile
from rasterlake.operators.skew import attach

# --- fixed values: gamut-fit thresholds ---------------------------------------
FIT_SHARE = 0.001
FIT_WORST = -0.005
FIT_FLOOR = 0.25
FIT_EPS = 1e-4
# --- fixed values: gain histogram ---------------------------------------------
GAIN_LOW, GAIN_HIGH = -16.0, 16.0
GAIN_LIMIT = 10.0
GAIN_MIN_SAMPLES = 100


def linear_rgb(code_max: float, curve: Curve):
    return tuple(to_linear(F.col(c) / code_max, curve) for c in "rgb")


def max_nits(px: DataFrame, code_max: float, curve: Curve, white: float = SDR_WHITE_NITS) -> DataFrame:
    peak = F.greatest(*linear_rgb(code_max, curve)) * white
    return px.groupBy("asset_id").agg(F.max(peak).alias("max_nits"))


def content_peak_nits(px: DataFrame, code_max: float, curve: Curve, nominal: float,
                      scale: float = 1.0, white: float = SDR_WHITE_NITS) -> DataFrame:
    """Measured peak clamped to [white, nominal]; unusable readings keep nominal."""
    top = F.greatest(*linear_rgb(code_max, curve)) * scale
    measured = px.groupBy("asset_id").agg((F.max(top) * max(1.0, white)).alias("measured"))
    usable = F.col("measured").isNotNull() & ~F.isnan("measured") & (F.col("measured") > 0.0) & (
        F.col("measured") != float("inf"))
    return measured.withColumn(
        "applied", F.when(usable, clamp(F.col("measured"), white, max(white, nominal))).otherwise(F.lit(nominal)))


def gamut_fit(px: DataFrame, code_max: float = 65535.0) -> DataFrame:
    """Does linear BT.2020 content fit BT.709? Three answers: fits, exceeds or
    not measurable.

    Pass 1 finds the 99.9 % luminance quantile, never the maximum itself, and
    from it the floor below which pixels do not count. Pass 2 measures the
    share and depth of negative BT.709 components above that floor.
    """
    rgb = tuple(F.col(c) / code_max for c in "rgb")
    y = luma(rgb, LUMA_2020)
    ybin = F.least(F.greatest(F.floor(y * 65535.0 + 0.5), F.lit(0)), F.lit(65535)).cast("int")
    total = F.col("total")
    need = F.greatest(F.least(F.ceil(total * 0.999), total - 1), F.lit(1))
    floors = hist_quantile(px.select("asset_id", ybin.alias("ybin")), ["asset_id"], "ybin", need, out="q").select(
        "asset_id", "total", F.greatest(F.lit(1.0 / 65535.0), F.col("q") / 65535.0 * FIT_FLOOR).alias("floor"))
    seen = attach(px, floors, ["asset_id"], ["y", "x"], count="total")
    low = F.least(*apply_matrix(rgb, M_2020_TO_709))
    above = y >= F.col("floor")
    outside = above & (low < -FIT_EPS)
    stats = seen.groupBy("asset_id").agg(
        F.max("total").alias("samples"),
        F.max("floor").alias("floor"),
        F.count_if(above).alias("above"),
        F.count_if(outside).alias("outside"),
        F.coalesce(F.min(F.when(outside, low)), F.lit(0.0)).alias("worst"),
    )
    share = F.try_divide(F.col("outside"), F.col("above"))
    return stats.withColumn("share", share).withColumn(
        "status",
        F.when(F.col("above") == 0, "unmeasurable")
        .when((share < FIT_SHARE) & (F.col("worst") > FIT_WORST), "fits")
        .otherwise("exceeds"),
    )


def gain_bin(gain: Column, bins: int) -> Column:
    raw = (gain - GAIN_LOW) / (GAIN_HIGH - GAIN_LOW) * bins
    return F.greatest(F.least(raw.cast("int"), F.lit(bins - 1)), F.lit(0))


def keep_finite_gain(gains: DataFrame, gain: str = "g") -> DataFrame:
    return gains.where((F.col(gain) > -GAIN_LIMIT) & (F.col(gain) < GAIN_LIMIT))


def gain_range(gains: DataFrame) -> DataFrame:
    """Low and high log2-gain bounds per image, by histogram quantiles.

    One histogram of 8192 bins serves both ends: the 4096-bin index is half the
    fine one, and the count from the top is the total minus the count below.
    The window therefore holds at most 8192 rows of one image.
    """
    fine = gain_bin(F.col("g"), 8192).alias("bin")
    hist = keep_finite_gain(gains).groupBy("asset_id", fine).agg(
        F.count(F.lit(1)).alias("k"), F.min("g").alias("mn"), F.max("g").alias("mx"))
    return gain_bounds(hist, ["asset_id"])


def gain_bounds(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Bounds from histograms of 8192 bins: one row per key and bin, with its count k and its extremes mn and mx."""
    rising = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    run, total = F.col("run"), F.col("total")
    ends = hist.withColumn("run", F.sum("k").over(rising)).withColumn("total", F.sum("k").over(whole)).groupBy(
        *keys).agg(
        F.max("total").alias("n"),
        F.min(F.when(run >= F.floor(total / 100), F.col("bin"))).alias("lo"),
        F.max(F.when(total - run + F.col("k") >= F.greatest(F.floor(total / 10000), F.lit(1)), F.col("bin"))).alias("hi"),
        F.least(F.min("mn"), F.lit(0.0)).alias("abs_min"),
        F.greatest(F.max("mx"), F.lit(0.0)).alias("abs_max"))
    span = GAIN_HIGH - GAIN_LOW
    measured = F.col("n") >= GAIN_MIN_SAMPLES
    at_low = (F.floor(F.col("lo") / 2) + 0.5) * span / 4096 + GAIN_LOW
    at_high = (F.col("hi") + 0.5) * span / 8192 + GAIN_LOW
    return ends.select(
        *keys, "n", measured.alias("measured"),
        F.when(measured, F.least(at_low, F.lit(0.0))).otherwise(F.lit(0.0)).alias("low"),
        F.when(measured, F.greatest(at_high, F.lit(0.0))).otherwise(F.lit(0.0)).alias("high"),
        "abs_min", "abs_max",
    )


def gain_base_class(gray: DataFrame, value: str = "code") -> DataFrame:
    """Zero-based or 128-based gain plane, from its 0.5 % percentile."""
    at = hist_quantile(
        gray, ["asset_id"], value, F.greatest(F.ceil(F.col("total") * 0.005), F.lit(1)), out="p05")
    return at.withColumn(
        "base_class",
        F.when(F.col("p05") <= 8, "zero_based").when(F.col("p05") >= 16, "mid_based").otherwise("undetermined"))


def has_distinct_channels(px: DataFrame, code_max: float = 255.0) -> DataFrame:
    r, g, b = (F.col(c) / code_max for c in "rgb")
    spread = (F.abs(r - g) > 1e-4) | (F.abs(g - b) > 1e-4)
    return px.groupBy("asset_id").agg(F.bool_or(spread).alias("distinct_channels"))


def round_trip_drift(px: DataFrame, m, code_max: float = 255.0) -> DataFrame:
    """Drift of a matrix round trip A to B to A, per image."""
    rgb = tuple(F.col(c) / code_max for c in "rgb")
    back = apply_matrix(apply_matrix(rgb, m), matrices.invert(list(m)))
    drift = F.greatest(*[F.abs(p - q) for p, q in zip(back, rgb)])
    return px.select("asset_id", drift.alias("drift")).groupBy("asset_id").agg(
        F.max("drift").alias("max_drift"), F.avg("drift").alias("mean_drift"))


def luma_of(px: DataFrame, code_max: float = 255.0) -> DataFrame:
    rgb = tuple(F.col(c) / code_max for c in "rgb")
    return px.select("asset_id", "y", "x", luma(rgb, LUMA_709).alias("y709"), luma(rgb, LUMA_2020).alias("y2020"))


def argmin_per_group(rows: DataFrame, keys: list[str], err: str, rank: str) -> DataFrame:
    """Best candidate per group, ties by rank; a min aggregate, not a sort."""
    rest = [c for c in rows.columns if c not in (*keys, err, rank)]
    best = F.min(F.struct(err, rank, *rest)).alias("s")
    return rows.groupBy(*keys).agg(best).select(*keys, f"s.{err}", f"s.{rank}", *[f"s.{c}" for c in rest])
