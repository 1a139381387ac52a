"""Quality of an encoded rendition against its reference."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlake.functions.color import Stages, delta_e76
from rasterlake.functions.matrices import colorants_d50
from rasterlake.llm.textkit import slices
from rasterlake.model import PRIMARIES
from rasterlake.operators.pixels import align_pixels

#: Samples that buffers are compared by.
STRIP = 1 << 20


def psnr_of(sse: Column, samples: Column, peak: float) -> Column:
    """Squared error to dB; a lossless pair is +infinity, not a cap."""
    mse = sse / samples
    return F.when(mse <= 0.0, F.lit(float("inf"))).otherwise(F.log10(F.lit(peak * peak) / mse) * 10.0)


def squared_error(a: Column, b: Column) -> Column:
    d = a.cast("long") - b.cast("long")
    return d * d


def paired(ref: DataFrame, enc: DataFrame) -> DataFrame:
    """Both renditions side by side. A sample that one side lacks stays, with a null on that side."""
    return align_pixels(ref, enc.withColumnRenamed("code", "code2"), how="full")


def _unmatched(a="code", b="code2") -> Column:
    return F.count_if(F.col(a).isNull() | F.col(b).isNull())


def _whole(scores: DataFrame, *columns: str) -> DataFrame:
    """No score for a pair that does not match sample for sample, and a status that says so."""
    unlike = F.col("unmatched") > 0
    return scores.withColumns({c: F.when(~unlike, F.col(c)) for c in columns}).withColumn(
        "status", F.when(unlike, "length_mismatch").otherwise("ok")).drop("unmatched")


def frame_errors(pairs: DataFrame) -> DataFrame:
    """Squared error per (asset, frame): whole numbers, so order never matters."""
    return pairs.groupBy("asset_id", "frame").agg(
        F.sum(squared_error(F.col("code"), F.col("code2"))).alias("sse"),
        F.count(F.lit(1)).alias("n"), _unmatched().alias("unmatched"),
    )


def psnr(ref: DataFrame, enc: DataFrame, bits: int = 8) -> DataFrame:
    peak = float(2**bits - 1)
    both = paired(ref, enc).groupBy("asset_id").agg(
        F.sum(squared_error(F.col("code"), F.col("code2"))).alias("sse"),
        F.count(F.lit(1)).alias("n"), _unmatched().alias("unmatched"),
    ).withColumn("psnr", psnr_of(F.col("sse"), F.col("n"), peak))
    return _whole(both, "sse", "psnr")


def psnr_tiles(ref: DataFrame, enc: DataFrame, keys=("asset_id", "tile"), bits: int = 8) -> DataFrame:
    """PSNR over the tile form: tiles are joined, samples exploded afterwards."""
    both = ref.withColumnRenamed("samples", "a").join(enc.withColumnRenamed("samples", "b"), list(keys), "full")
    px = both.select("asset_id", F.inline(F.arrays_zip(
        *(F.coalesce(F.col(c), F.array().cast(both.schema[c].dataType)).alias(c) for c in "ab"))))
    scores = px.groupBy("asset_id").agg(
        F.sum(squared_error(F.col("a"), F.col("b"))).alias("sse"), F.count(F.lit(1)).alias("n"), _unmatched("a", "b").alias("unmatched"),
    ).withColumn("psnr", psnr_of(F.col("sse"), F.col("n"), float(2**bits - 1)))
    return _whole(scores, "sse", "psnr")


def _buffer_errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sse, n and unmatched samples of each pair of buffers; a few MB of pairs at once, in strips of `STRIP` samples."""
    for batch in (piece for whole in batches for piece in slices(whole, "a")):
        size = [pc.binary_length(batch.column(c)).to_numpy().astype(np.int64) for c in "ab"]
        same = size[0] == size[1]
        n = np.where(same, size[0], 0)
        a, b = (_flat(batch.column(c).filter(pa.array(same))) for c in "ab")
        end, total, before = np.cumsum(n), np.zeros(len(n), np.int64), 0
        for s in range(0, len(a), STRIP):
            d = np.subtract(a[s : s + STRIP], b[s : s + STRIP], dtype=np.int32)
            error = np.cumsum(d * d, dtype=np.int64)
            here = slice(*np.searchsorted(end, [s, s + STRIP], side="right"))
            total[here] = before + error[end[here] - s - 1]
            before += error[-1]
        kept = [k for k in batch.schema.names if k not in "ab"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in kept), pa.array(np.diff(total, prepend=0)), pa.array(n), pa.array(np.where(same, 0, np.maximum(*size)))],
            names=[*kept, "sse", "n", "unmatched"])


def _flat(column: pa.Array) -> np.ndarray:
    """The bytes of all rows on end, without copies."""
    _, at, raw = column.buffers()
    if not len(column) or raw is None:
        return np.zeros(0, np.uint8)
    at = np.frombuffer(at, np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    return np.frombuffer(raw, np.uint8)[at[column.offset] : at[column.offset + len(column)]]


def psnr_buffers(ref: DataFrame, enc: DataFrame, keys=("asset_id", "part"), bits: int = 8) -> DataFrame:
    """PSNR over raw 8-bit buffers: asset_id, part, buf on both sides.

    One row per buffer is joined; the samples of many pairs are compared at once
    where the pair lies. A part is a bounded stretch of an image, so a huge
    image is many rows. Buffers without a partner or of another length leave
    their image without a score. An image without a sample on either side (a null
    buffer is empty) has no row, as it has none in the long form.
    """
    empty = F.lit(bytearray())
    both = ref.withColumnRenamed("buf", "a").join(enc.withColumnRenamed("buf", "b"), list(keys), "full").select(
        "asset_id", *(F.coalesce(F.col(c), empty).alias(c) for c in "ab"))
    schema = T.StructType([both.schema["asset_id"], *(T.StructField(c, T.LongType()) for c in ("sse", "n", "unmatched"))])
    sums = both.mapInArrow(_buffer_errors, schema).groupBy("asset_id").agg(
        *(F.sum(c).alias(c) for c in ("sse", "n", "unmatched"))).where(F.col("n") + F.col("unmatched") > 0)
    scores = sums.withColumn("psnr", psnr_of(F.col("sse"), F.nullif(F.col("n"), F.lit(0)), float(2**bits - 1)))
    return _whole(scores, "sse", "psnr")


def psnr16(ref: DataFrame, enc: DataFrame) -> DataFrame:
    """Full scale 65535: integer error sum first, one division at the end."""
    return psnr(ref, enc, bits=16)


def psnr_multiframe(ref: DataFrame, enc: DataFrame, bits: int = 8) -> DataFrame:
    """Average from the global error; extremes over frames, short tail included."""
    peak = float(2**bits - 1)
    frames = frame_errors(paired(ref, enc)).withColumn("db", psnr_of(F.col("sse"), F.col("n"), peak))
    scores = frames.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("frames"),
        psnr_of(F.sum("sse"), F.sum("n"), peak).alias("avg_db"),
        F.min("db").alias("min_db"),
        F.max("db").alias("max_db"),
        F.sum("unmatched").alias("unmatched"),
    )
    return _whole(scores, "avg_db", "min_db", "max_db")


def ssim_blocks(ref: DataFrame, enc: DataFrame, win: int = 8, peak: float = 255.0) -> DataFrame:
    """Mean structural similarity over win x win blocks, and its dB form.

    Block moments come from five integer sums, so they do not depend on the
    order in which partitions are merged.
    """
    a, b = F.col("code").cast("long"), F.col("code2").cast("long")
    blocks = paired(ref, enc).groupBy(
        "asset_id", "frame",
        F.floor(F.col("y") / win).alias("by"), F.floor(F.col("x") / win).alias("bx"),
    ).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(a).alias("sa"), F.sum(b).alias("sb"),
        F.sum(a * a).alias("saa"), F.sum(b * b).alias("sbb"), F.sum(a * b).alias("sab"), _unmatched().alias("unmatched"),
    )
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    n, ma, mb = F.col("n"), F.col("sa") / F.col("n"), F.col("sb") / F.col("n")
    va, vb = F.col("saa") / n - ma * ma, F.col("sbb") / n - mb * mb
    cov = F.col("sab") / n - ma * mb
    value = ((ma * mb * 2.0 + c1) * (cov * 2.0 + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
    scores = (
        blocks.withColumn("ssim", value)
        .groupBy("asset_id")
        .agg(F.count(F.lit(1)).alias("blocks"), F.avg("ssim").alias("ssim"), F.sum("unmatched").alias("unmatched"))
        .withColumn("ssim_db", F.when(F.col("ssim") >= 1.0, F.lit(float("inf"))).otherwise(
            F.log10(F.lit(1.0) - F.col("ssim")) * -10.0))
    )
    return _whole(scores, "ssim", "ssim_db")


def max_abs_diff(ref: DataFrame, enc: DataFrame) -> DataFrame:
    return _whole(paired(ref, enc).groupBy("asset_id").agg(
        F.max(F.abs(F.col("code") - F.col("code2"))).alias("max_abs"), _unmatched().alias("unmatched")), "max_abs")


def delta_e_stats(ref: DataFrame, enc: DataFrame) -> DataFrame:
    """Mean and worst CIE76 difference of 8-bit sRGB pixels."""
    other = enc.select("asset_id", "y", "x", *[F.col(c).alias(f"{c}2") for c in "rgb"])
    pairs = ref.join(other, ["asset_id", "y", "x"], "full")
    let = Stages(pairs)
    de = let("de", delta_e76(
        tuple(F.col(c) for c in "rgb"), tuple(F.col(f"{c}2") for c in "rgb"), colorants_d50(*PRIMARIES["bt709"]), let))
    # A difference is null where a side is.
    return _whole(let.df.select("asset_id", de.alias("de")).groupBy("asset_id").agg(
        F.avg("de").alias("mean_de"), F.max("de").alias("max_de"), F.count_if(F.col("de").isNull()).alias("unmatched")), "mean_de", "max_de")


def worst_frames(frames: DataFrame, k: int) -> DataFrame:
    """The k lowest-PSNR frames of each asset.

    Ranking by an aggregate of at most k candidates lets every task keep only
    its own k worst before the shuffle, however many frames one asset has.
    """
    order = [F.col("db").asc(), F.col("frame").asc()]
    spread = F.pmod(F.xxhash64("frame"), F.lit(64))
    local = Window.partitionBy("asset_id", "__part").orderBy(*order)
    whole = Window.partitionBy("asset_id").orderBy(*order)
    return (
        frames.withColumn("__part", spread)
        .withColumn("rk", F.row_number().over(local)).where(F.col("rk") <= k)
        .withColumn("rk", F.row_number().over(whole)).where(F.col("rk") <= k)
        .drop("__part")
    )


def resolution_match(pairs: DataFrame) -> DataFrame:
    """Pairs with a reason when display sizes differ; unknown sizes pass."""
    known = F.least("src_w", "src_h", "enc_w", "enc_h") > 0
    differs = (F.col("src_w") != F.col("enc_w")) | (F.col("src_h") != F.col("enc_h"))
    reason = F.when(known & differs, F.format_string("%dx%d vs %dx%d", "src_w", "src_h", "enc_w", "enc_h"))
    return pairs.withColumn("reason", reason).withColumn("ok", reason.isNull())
