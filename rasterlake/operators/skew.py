"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT_ROWS = 1_000_000
MAX_PARTS = 100_000


def attach(rows: DataFrame, per_key: DataFrame, keys: list[str], spread: list[str], how: str = "inner",
           count: str | None = None, unit: int = UNIT_ROWS) -> DataFrame:
    """Join a one-row-per-key table back to its many rows.

    A key with more rows than the unit is cut into parts of about one unit by
    a hash of columns that vary within the key, and its single row is repeated
    once per part; every other key joins as it is. The unit is at least a
    hundred-thousandth of all rows, so fewer than 100,000 keys are ever cut:
    that bounds the table of cut keys, which is why it may be broadcast.
    `count` names the rows-per-key column of per_key where it has one, which
    saves the counting pass. Whether per_key itself is broadcast is left to the
    size check of the optimiser.
    """
    if count:
        sizes = per_key.select(*keys, F.col(count).alias("__n"))
    else:
        sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = sizes.agg(F.sum("__n")).scalar()
    share = F.greatest(total / MAX_PARTS, F.lit(float(unit)))
    cut = sizes.where(F.col("__n") > share).select(*keys, F.ceil(F.col("__n") / share).cast("int").alias("__parts"))
    cut = F.broadcast(cut)
    part = F.pmod(F.xxhash64(*spread), F.col("__parts")).cast("int")
    salted = rows.join(cut, keys, "left").withColumn("__part", F.coalesce(part, F.lit(0))).drop("__parts")
    last = F.coalesce(F.col("__parts"), F.lit(1)) - 1
    repeated = per_key.join(cut, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), last))).drop("__parts")
    return salted.join(repeated, [*keys, "__part"], how).drop("__part")
