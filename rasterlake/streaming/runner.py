"""Running a stream over what is there now and reading the result back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.session import work_dir


def run_append(stream: DataFrame, purpose: str) -> DataFrame:
    """Drain the source into a parquet sink; only closed results are emitted."""
    spark = stream.sparkSession
    base = work_dir(spark, purpose)
    # Sessions of one task merge before the shuffle, so a busy item does not
    # send each of its events to one reducer.
    name = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        query = (
            stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
            .option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_update(stream: DataFrame, keys: list[str], purpose: str) -> DataFrame:
    """Drain an updating aggregate; the newest epoch of each key is its state.

    Each epoch has its own folder, overwritten when a batch is retried.
    """
    spark = stream.sparkSession
    base = work_dir(spark, purpose)

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

    query = (
        stream.writeStream.outputMode("update").trigger(availableNow=True)
        .option("checkpointLocation", f"{base}/checkpoint").foreachBatch(save).start()
    )
    query.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    saved = spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out")
    newest = saved.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("s"))
    return newest.select(*keys, *[F.col(f"s.{c}").alias(c) for c in rest])
