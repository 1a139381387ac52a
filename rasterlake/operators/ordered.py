"""Order-dependent helpers that never put one key's whole history in one task.

A plain window over a key sorts all rows of that key in one task, which fails
when a single key holds a third of the table. Here the rows of a key are first
cut into consecutive buckets of the ordering column (an hour of a timestamp, a
block of an integer). The window runs inside (key, bucket); what must cross a
bucket border is carried by one summary row per bucket, and only those
summaries are windowed per key. `range_ranks` numbers a whole table without any
bucket: over range partitions, whose sizes alone are added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.session import work_dir


def time_bucket(ts: str, unit: str = "hour") -> Column:
    return F.date_trunc(unit, F.col(ts))


def block(col: str, width: int = 1_000_000) -> Column:
    return F.floor(F.col(col) / width)


def _null_safe(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """Left join on the named columns, keeping rows whose key is null."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in names else F.col(c) for c in right.columns])
    cond = None
    for name in names:
        part = left[name].eqNullSafe(renamed[f"__r_{name}"])
        cond = part if cond is None else cond & part
    return left.join(renamed, cond, "left").drop(*[f"__r_{n}" for n in names])


def _bucket_windows(keys: list[str], order: list[Column]):
    inner = Window.partitionBy(*keys, "__b").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy("__b")
    return inner, outer


def row_numbers(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, out: str = "rn") -> DataFrame:
    """1-based position of each row among its key, in the given order."""
    df = df.withColumn("__b", bucket)
    inner, outer = _bucket_windows(keys, order)
    counts = df.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn(
        "__before",
        F.coalesce(F.sum("__n").over(outer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).drop("__n")
    ranked = df.withColumn("__i", F.row_number().over(inner))
    return (
        _null_safe(ranked, before, [*keys, "__b"])
        .withColumn(out, (F.col("__i") + F.col("__before")).cast("long"))
        .drop("__b", "__i", "__before")
    )


def running_sum(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, value: Column, out: str) -> DataFrame:
    """Sum of value over the row and all rows before it in the key."""
    df = df.withColumn("__b", bucket).withColumn("__v", value)
    inner, outer = _bucket_windows(keys, order)
    sums = df.groupBy(*keys, "__b").agg(F.sum("__v").alias("__s"))
    before = sums.withColumn(
        "__before",
        F.coalesce(F.sum("__s").over(outer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).drop("__s")
    local = df.withColumn("__i", F.sum("__v").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        _null_safe(local, before, [*keys, "__b"])
        .withColumn(out, F.col("__i") + F.col("__before"))
        .drop("__b", "__v", "__i", "__before")
    )


def neighbour(df: DataFrame, keys: list[str], order_cols: list[str], bucket: Column, value: Column,
              out: str, ahead: bool) -> DataFrame:
    """lead (ahead) or lag of value; order_cols must order rows uniquely per key."""
    # The value travels inside a struct, so a null neighbour differs from none.
    df = df.withColumn("__b", bucket).withColumn("__v", F.struct(value.alias("v")))
    inner, outer = _bucket_windows(keys, [F.col(c) for c in order_cols])
    edge = F.struct(*order_cols, "__v")
    pick = F.min if ahead else F.max
    shift = F.lead if ahead else F.lag
    edges = df.groupBy(*keys, "__b").agg(pick(edge).alias("__e"))
    edges = edges.select(*keys, "__b", shift(F.col("__e.__v")).over(outer).alias("__over"))
    local = df.withColumn("__in", shift("__v").over(inner))
    return (
        _null_safe(local, edges, [*keys, "__b"])
        .withColumn(out, F.coalesce("__in", "__over")["v"])
        .drop("__b", "__v", "__in", "__over")
    )


def lead(df, keys, order_cols, bucket, value, out):
    return neighbour(df, keys, order_cols, bucket, value, out, ahead=True)


def lag(df, keys, order_cols, bucket, value, out):
    return neighbour(df, keys, order_cols, bucket, value, out, ahead=False)


def hist_quantile(df: DataFrame, keys: list[str], bin_col: str, target: Column, from_top: bool = False,
                  out: str = "bin") -> DataFrame:
    """First histogram bin whose running count reaches target, per key.

    target may use the column total. Rows are counted per (key, bin) before the
    shuffle, so a window holds at most the bins of one key, never its pixels.
    """
    hist = df.groupBy(*keys, bin_col).agg(F.count(F.lit(1)).alias("__n"))
    return binned_quantile(hist, keys, bin_col, "__n", target, from_top, out)


def binned_quantile(hist: DataFrame, keys: list[str], bin_col: str, n: str, target: Column, from_top: bool = False,
                    out: str = "bin") -> DataFrame:
    """hist_quantile of a histogram: one row per key and bin, its count in n."""
    rank = F.col(bin_col).desc() if from_top else F.col(bin_col).asc()
    run = Window.partitionBy(*keys).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    hist = hist.select(
        *keys, bin_col, F.sum(n).over(run).alias("__run"), F.sum(n).over(whole).alias("total"))
    pick = F.max if from_top else F.min
    return hist.groupBy(*keys).agg(
        F.max("total").alias("total"),
        pick(F.when(F.col("__run") >= target, F.col(bin_col))).alias(out),
    )


def range_ranks(df: DataFrame, order: list[Column], out: str = "rn") -> DataFrame:
    """1-based place of every row in the whole order, which must be unique.

    Rows are dealt to range partitions from a sample of the order, so a busy
    hour or sparse ids spread as evenly as any other. They are numbered inside
    their partition and written; what a partition's numbers begin with is the
    count of the rows before it, a table of one row per partition.
    """
    spark = df.sparkSession
    path = work_dir(spark, "ranks")
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.withColumn("__id", F.monotonically_increasing_id()).write.parquet(path)
    numbered = spark.read.parquet(path).withColumn("__part", F.shiftright("__id", 33))
    before = numbered.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).withColumn(
        "__before", F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
    place = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + F.coalesce("__before", F.lit(0)) + 1
    return numbered.join(F.broadcast(before.drop("__n")), "__part").withColumn(out, place).drop("__id", "__part", "__before")
