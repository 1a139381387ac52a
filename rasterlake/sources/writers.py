"""Writers: ledgers and guarded output."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.operators.audit import ledger_summary


def write_ledger(df: DataFrame, folder: str, dims=("disposition", "cls", "level", "rule", "make")) -> None:
    """Ledger CSV and its summary as JSON lines, each written in parallel."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/ledger")
    ledger_summary(df, dims).write.mode("overwrite").json(f"{folder}/summary")


def write_guarded(df: DataFrame, path: str, allow_overwrite: bool = True) -> str:
    """Overwrite by default; with the guard an existing target is refused."""
    try:
        df.write.mode("overwrite" if allow_overwrite else "errorifexists").parquet(path)
    except AnalysisException as err:
        if not allow_overwrite and "ALREADY_EXISTS" in (err.getCondition() or ""):
            return "failed: exists"
        raise
    return "completed"


def write_tiles(px: DataFrame, table: str, buckets: int, tile: int = 64) -> None:
    """Pixels to the tile form, bucketed so that renditions join without a shuffle.

    A tile holds at most tile*tile samples of one frame, so a huge image is many rows.
    """
    frame = ["frame"] if "frame" in px.columns else []
    key = [F.floor(F.col("y") / tile).cast("int").alias("ty"), F.floor(F.col("x") / tile).cast("int").alias("tx")]
    cell = F.struct("y", "x", "code")
    tiles = px.groupBy("asset_id", *frame, *key).agg(F.array_sort(F.collect_list(cell)).alias("cells")).select(
        "asset_id", *frame, "ty", "tx", F.transform("cells", lambda c: c["code"]).alias("samples"))
    tiles.write.mode("overwrite").bucketBy(buckets, "asset_id", *frame, "ty", "tx").sortBy("asset_id", *frame, "ty", "tx").saveAsTable(table)
