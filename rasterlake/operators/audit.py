"""Audits: ledgers, compressor benchmarks, fits, chunk chains."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.operators import ordered
from rasterlake.operators.skew import attach

# --- fixed values: fit acceptance ---------------------------------------------
FIT_MIN_SAMPLES = 5
FIT_MAX_RESIDUAL = 0.02
MEMORY_BASE_MB = 70.0
MEMORY_PER_MPIX_MB = 99.0
# --- fixed values: colour type -> legal bit depths ----------------------------
PNG_DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}


# --- ledgers -------------------------------------------------------------------
def ledger_summary(ledger: DataFrame, dims=("disposition", "cls", "level", "rule", "make")) -> DataFrame:
    """Counts by each dimension and in total, from one scan and one shuffle.

    Grouping sets combine map-side, so a hot class costs one row per task.
    """
    sets = [[F.col(d)] for d in dims] + [[]]
    grouped = ledger.groupingSets(sets, *dims).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("disposition") != "unaudited").alias("audited"),
        F.grouping_id().alias("gid"))
    every = (1 << len(dims)) - 1
    which = F.lit("total")
    value = F.lit(None).cast("string")
    for i, d in enumerate(dims):
        mine = F.col("gid") == every - (1 << (len(dims) - 1 - i))
        which = F.when(mine, d).otherwise(which)
        value = F.when(mine, F.col(d)).otherwise(value)
    return grouped.select(
        which.alias("dimension"), value.alias("member"), "n",
        (F.col("audited") / F.col("n")).alias("audited_share"))


def ledger_consistent(summary: DataFrame) -> DataFrame:
    """Every dimension must sum to the total."""
    sums = summary.groupBy("dimension").agg(F.sum("n").alias("n"))
    return sums.agg((F.min("n") == F.max("n")).alias("consistent"), F.max("n").alias("total"))


def ledger_crosstab(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("disposition", "cls").agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.col("n").desc(), "disposition", "cls")


def most_common(df: DataFrame, col: str, k: int) -> DataFrame:
    """The k most frequent values; order and limit become one top-k step."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col(col).asc()).limit(k)


# --- compressor benchmarks -----------------------------------------------------
def _valid() -> Column:
    return (F.col("status") == "ok") & F.col("pixel_equal")


def bench_arm_summary(rows: DataFrame) -> DataFrame:
    ratio = F.col("output_bytes") / F.col("baseline_bytes")
    good = _valid() & (ratio > 0.0)
    return rows.groupBy("arm_id").agg(
        F.count_if(_valid()).alias("valid"),
        F.exp(F.avg(F.when(good, F.ln(ratio)))).alias("geo_ratio"),
        ((F.lit(1.0) - F.try_divide(F.sum(F.when(_valid(), F.col("output_bytes"))),
                                    F.sum(F.when(_valid(), F.col("baseline_bytes"))))) * 100.0).alias("saved_pct"),
        F.count_if(~F.col("pixel_equal")).alias("violations"),
        F.count_if(F.col("chunk_loss")).alias("chunk_losses"),
        F.count_if(~F.col("decode_ok")).alias("decode_failures"),
        F.count_if(F.col("status") == "timeout").alias("timeouts"),
        F.sum("time_ms").alias("total_ms"),
    )


def bench_matrix(rows: DataFrame, arms: list) -> DataFrame:
    """case x arm matrix of percent saved with status marks.

    The arms are given, so no pass over the data has to discover them; a cell
    with several runs shows the earliest.
    """
    saved = (F.lit(1.0) - F.col("output_bytes") / F.col("baseline_bytes")) * 100.0
    mark = (
        F.when(~F.col("pixel_equal"), "loss")
        .when(F.col("status") != "ok", F.col("status"))
        .otherwise(F.format_string("%.2f%%", saved))
    )
    cell = F.min_by(mark, F.struct("run_id", "output_bytes", "status", "pixel_equal"))
    return rows.groupBy("case_id").pivot("arm_id", arms).agg(cell)


def bench_conservation(rows: DataFrame) -> DataFrame:
    """pass + fail + skip + timeout must equal the number of cells."""
    s = F.col("status")
    counts = rows.groupBy("arm_id").agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(_valid()).alias("passed"),
        F.count_if((s == "fail") | ((s == "ok") & ~F.col("pixel_equal"))).alias("failed"),
        F.count_if(s == "skip").alias("skipped"),
        F.count_if(s == "timeout").alias("timed_out"),
    )
    return counts.withColumn(
        "conserved",
        F.col("passed") + F.col("failed") + F.col("skipped") + F.col("timed_out") == F.col("cells"))


def throughput_best_of(runs: DataFrame, baseline_arm) -> DataFrame:
    """Best time per (case, arm), MPix/s, spread, and gain over the baseline arm."""
    best = runs.groupBy("case_id", "arm_id").agg(
        F.min("time_ms").alias("best_ms"), F.max("time_ms").alias("worst_ms"), F.max("pixels").alias("pixels"))
    rated = best.withColumn(
        "mpix_s", F.col("pixels") / 1e6 / F.greatest(F.col("best_ms") / 1000.0, F.lit(1e-6))).withColumn(
        "spread", F.col("worst_ms") - F.col("best_ms"))
    base = rated.where(F.col("arm_id") == baseline_arm).select("case_id", F.col("mpix_s").alias("base_mpix_s"))
    return rated.join(base, "case_id", "left").withColumn("gain", F.try_divide("mpix_s", "base_mpix_s"))


# --- fits ----------------------------------------------------------------------
def _moments(samples: DataFrame, keys: list[str], x: Column, y: Column) -> DataFrame:
    # Partial variances of one x merge to a rounding error other than 0, so the x themselves say whether they vary.
    paired = F.when(y.isNotNull(), x)
    varies = F.min(paired) < F.max(paired)
    return samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(varies, F.regr_slope(y, x)).alias("slope"), F.when(varies, F.regr_intercept(y, x)).alias("intercept"),
        (F.max(y) - F.min(y)).alias("span"), F.max(F.abs(y)).alias("top"))


def linear_fit(samples: DataFrame, key: str, x: str, y: str, spread: list[str]) -> DataFrame:
    """Slope, intercept and largest residual per field, with reject reasons."""
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    fit = _moments(samples, [key], xs, ys)
    seen = attach(samples.select(key, x, y, *[c for c in spread if c not in (key, x, y)]), fit.select(
        key, "slope", "intercept", "n"), [key], spread, count="n")
    worst = seen.groupBy(key).agg(
        F.max(F.abs(ys - (xs * F.col("slope") + F.col("intercept")))).alias("max_resid"))
    scale = F.when(F.col("span") > 0, F.col("span")).when(F.col("top") > 0, F.col("top")).otherwise(F.lit(1.0))
    rel = F.col("max_resid") / scale
    return fit.join(worst, key).select(
        key, "n", "slope", "intercept", "max_resid", rel.alias("rel_resid"),
        F.when(F.col("n") < FIT_MIN_SAMPLES, "too_few")
        .when(F.col("slope").isNull(), "no_x_variance")
        .when(rel > FIT_MAX_RESIDUAL, "residual")
        .alias("reject_reason"))


def power_basis_fit(samples: DataFrame, x: str, y: str, powers: list[int]) -> DataFrame:
    """Least squares on chosen powers.

    Spark sums the normal equations in one pass; only those m(m+3)/2 numbers
    (m <= 8) reach the driver for the solve. A second pass takes the residual.
    """
    if not 0 < len(powers) <= 8:
        raise ValueError("between one and eight powers")
    spark = samples.sparkSession
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    exps = sorted({p + q for p in powers for q in powers})
    row = samples.agg(
        F.count(xs).alias("n"),
        *[F.sum(F.pow(xs, F.lit(float(e)))).alias(f"s{e}") for e in exps],
        *[F.sum(F.pow(xs, F.lit(float(p))) * ys).alias(f"t{p}") for p in powers],
    ).first()
    schema = "power int, coef double, max_resid double"
    if row["n"] < len(powers):
        return spark.createDataFrame([], schema)
    a = np.array([[row[f"s{p + q}"] for q in powers] for p in powers])
    b = np.array([row[f"t{p}"] for p in powers])
    # Column scaling keeps the pivots comparable across very different powers.
    norm = 1.0 / np.sqrt(np.diag(a))
    scaled = a * norm[:, None] * norm[None, :]
    if np.linalg.matrix_rank(scaled, tol=1e-12) < len(powers):
        return spark.createDataFrame([], schema)
    coef = np.linalg.solve(scaled, b * norm) * norm
    predicted = sum((F.pow(xs, F.lit(float(p))) * float(c) for p, c in zip(powers, coef)), F.lit(0.0))
    table = F.array(*[
        F.struct(F.lit(p).alias("power"), F.lit(float(c)).alias("coef")) for p, c in zip(powers, coef)])
    return samples.agg(F.max(F.abs(ys - predicted)).alias("max_resid")).select(
        F.inline(table), "max_resid").select("power", "coef", "max_resid")


def memory_demand(assets: DataFrame, batch: str) -> DataFrame:
    pixels = F.greatest(F.col("width").cast("long") * F.col("height"), F.lit(1))
    mb = F.lit(MEMORY_BASE_MB) + F.lit(MEMORY_PER_MPIX_MB) * (pixels / 1e6)
    return assets.groupBy(batch).agg(
        F.count(F.lit(1)).alias("assets"), F.sum(pixels).alias("pixels"), F.max(mb).alias("max_mb")).withColumn(
        "total_mb", F.col("assets") * MEMORY_BASE_MB + F.col("pixels") / 1e6 * MEMORY_PER_MPIX_MB)


# --- chunk chains --------------------------------------------------------------
def chunk_chain_check(boxes: DataFrame, lengths: DataFrame, header: int = 8, width: int = 1_000_000) -> DataFrame:
    """Does every box begin where the previous one ended, up to the file's end?"""
    end = F.col("off") + F.col("size")
    linked = ordered.lag(boxes, ["asset_id"], ["seq"], ordered.block("seq", width), end, "prev_end")
    starts = F.col("off") == F.coalesce("prev_end", F.lit(0))
    chains = linked.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("boxes"),
        F.bool_and(starts).alias("contiguous"),
        F.bool_and(F.col("size") >= header).alias("sizes_ok"),
        F.max(F.struct("seq", end.alias("end")))["end"].alias("last_end"),
    )
    return chains.join(lengths, "asset_id").select(
        "asset_id", "boxes", "contiguous", "sizes_ok",
        (F.col("contiguous") & F.col("sizes_ok") & (F.col("last_end") == F.col("file_len"))).alias("complete"))


def png_structure(chunks: DataFrame) -> DataFrame:
    """Header first with length 13, end chunk last, empty and only once, legal
    depth and colour type; the first violated rule is named.

    First and last chunk are min/max aggregates over seq, so no window sorts a
    file with very many chunks.
    """
    file = chunks.groupBy("asset_id").agg(
        F.min(F.struct("seq", "type", "length", "bit_depth", "color_type")).alias("first"),
        F.max(F.struct("seq", "type", "length")).alias("last"),
        F.count_if(F.col("type") == "IEND").alias("ends"),
        F.count(F.lit(1)).alias("chunks"),
    )
    legal = F.lit(False)
    for kind, depths in PNG_DEPTHS.items():
        legal = legal | ((F.col("first.color_type") == kind) & F.col("first.bit_depth").isin(*depths))
    error = (
        F.when(F.col("first.type") != "IHDR", "first_not_header")
        .when(F.col("first.length") != 13, "header_length")
        .when(~legal, "depth_color_pair")
        .when(F.col("ends") == 0, "end_missing")
        .when((F.col("last.type") != "IEND") | (F.col("ends") > 1), "data_after_end")
        .when(F.col("last.length") != 0, "end_length")
    )
    return file.select("asset_id", "chunks", error.alias("error"), error.isNull().alias("ok"))


def reconcile_size(assets: DataFrame, decoded: DataFrame) -> DataFrame:
    """Declared against decoded size: Match, Scaled, or one of two rejects.

    assets: asset_id, width, height, crop_declared. decoded: asset_id, pixels.
    """
    rows = assets.join(decoded, "asset_id")
    w, h, n = F.col("width").cast("long"), F.col("height").cast("long"), F.col("pixels")
    ks = F.sequence(F.lit(2), F.lit(16))
    down = F.array_min(F.filter(ks, lambda k: (w % k == 0) & (h % k == 0) & (w * h == n * k * k)))
    up = F.array_min(F.filter(ks, lambda k: w * h * k * k == n))
    unknown = (w <= 0) | (h <= 0) | (n <= 0)
    verdict = (
        F.when(unknown | (w * h == n), "Match")
        .when(~F.col("crop_declared"), "RejectUndeclared")
        .when(down.isNotNull() | up.isNotNull(), "Scaled")
        .otherwise("RejectNonUniform")
    )
    scaled = verdict == "Scaled"
    return rows.select(
        "asset_id", verdict.alias("verdict"),
        F.when(scaled & down.isNotNull(), F.floor(w / down)).when(scaled, w * up).otherwise(w).alias("actual_w"),
        F.when(scaled & down.isNotNull(), F.floor(h / down)).when(scaled, h * up).otherwise(h).alias("actual_h"))
