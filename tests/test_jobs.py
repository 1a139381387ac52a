"""Target naming against the sequential rule, and other job operators."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterlake.operators import audit, jobs


def sequential(stems):
    """Names in input order: first asker keeps, others take the first free _n."""
    seen, out = set(), []
    for stem in stems:
        name = stem
        if name.lower() in seen:
            n = 1
            while f"{stem}_{n}".lower() in seen:
                n += 1
            name = f"{stem}_{n}"
        seen.add(name.lower())
        out.append(name)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_assign_output_names(spark, seed):
    rng = random.Random(seed)
    pool = ["a", "A", "a_1", "a_2", "a_1_1", "a_3", "b", "b_1", "b_1_1", "b_1_2", "b_1_1_1", "b_01", "c_2", "a_10"]
    stems = [rng.choice(pool) for _ in range(rng.choice([12, 40, 90]))]
    df = spark.createDataFrame(pd.DataFrame({"ord": range(len(stems)), "stem": stems})).select(
        "ord", F.lit("/out").alias("folder"), "stem", F.lit("png").alias("ext"))
    got = jobs.assign_output_names(df, width=7).orderBy("ord").toPandas()
    assert got.out_stem.tolist() == sequential(stems)
    assert got.out_stem.str.lower().is_unique


def test_names_differ_by_folder_and_extension(spark):
    df = spark.createDataFrame([(0, "/x", "a", "png"), (1, "/y", "a", "png"), (2, "/x", "a", "jpg"), (3, "/x", "a", "png")],
                               "ord int, folder string, stem string, ext string")
    got = jobs.assign_output_names(df).orderBy("ord").toPandas()
    assert got.out_stem.tolist() == ["a", "a", "a", "a_1"]


def test_status_prefix_and_exact(spark):
    df = spark.createDataFrame([("completed (degraded)",), ("failed: 3",), ("stopped",), ("stopped early",), ("processing",), (None,)], "status string")
    got = [r.status_class for r in jobs.status_class(df).collect()]
    assert got == ["success", "failure", "stopped", "other", "processing", "other"]


def test_odd_input_has_no_partner(spark):
    df = spark.range(5).select("id", F.concat(F.lit("p"), "id").alias("p"))
    got = {r.pair_id: (r.sdr, r.hdr) for r in jobs.pair_sequential(df, "id", "p", width=2).collect()}
    assert got == {0: ("p0", "p1"), 1: ("p2", "p3"), 2: ("p4", None)}


def test_stall_needs_three_windows(spark):
    df = spark.createDataFrame([(1, 0), (2, 1799), (3, 3599)], "event_id int, s int").select(
        "event_id", F.timestamp_seconds("s").alias("ts"), F.lit("completed").alias("status"))
    assert [r.event_id for r in jobs.stall_gaps(df).collect()] == [2]


def test_one_x_in_many_partitions_has_no_slope(spark):
    """The fit's partial sums differ by rounding alone; a field whose x vary beside a null y only has no slope either."""
    rows = spark.range(0, 30_000, 1, 8).selectExpr("pmod(hash(id), 97) field", "7D x", "cast(id % 31 as double) y", "id")
    more = spark.sql("select 100 field, cast(id as double) x, if(id = 0, 1D, null) y, id from range(9)")
    got = audit.linear_fit(rows.unionByName(more), "field", "x", "y", ["id"]).collect()
    assert len(got) == 98 and {(r.slope, r.intercept, r.max_resid, r.reject_reason) for r in got} == {(None, None, None, "no_x_variance")}
