"""Bucketed order helpers against plain pandas, with a hot key, ties and nulls."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterlake.operators import ordered


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    n = 3000
    key = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 40, n)).astype(float)
    key[rng.random(n) < 0.05] = np.nan
    pdf = pd.DataFrame({"key": key, "at": rng.integers(0, 500, n), "id": np.arange(n), "v": rng.integers(0, 100, n)})
    return pdf, spark.createDataFrame(pdf).withColumn("key", F.when(~F.isnan("key"), F.col("key"))).cache()


def _sorted(pdf):
    return pdf.assign(key=pdf.key.fillna(-1)).sort_values(["key", "at", "id"])


@pytest.mark.parametrize("width", [1, 50, 10_000])
def test_row_numbers(rows, width):
    pdf, df = rows
    got = ordered.row_numbers(df, ["key"], [F.col("at"), F.col("id")], ordered.block("at", width)).toPandas()
    want = _sorted(pdf)
    want["rn"] = want.groupby("key").cumcount() + 1
    assert got.set_index("id").rn.sort_index().tolist() == want.set_index("id").rn.sort_index().tolist()


@pytest.mark.parametrize("width", [1, 50, 10_000])
def test_running_sum(rows, width):
    pdf, df = rows
    got = ordered.running_sum(df, ["key"], [F.col("at"), F.col("id")], ordered.block("at", width), F.col("v"), "s").toPandas()
    want = _sorted(pdf)
    want["s"] = want.groupby("key").v.cumsum()
    assert got.set_index("id").s.sort_index().tolist() == want.set_index("id").s.sort_index().tolist()


@pytest.mark.parametrize("width", [1, 50, 10_000])
@pytest.mark.parametrize("ahead", [True, False])
def test_neighbour(rows, width, ahead):
    pdf, df = rows
    got = ordered.neighbour(df, ["key"], ["at", "id"], ordered.block("at", width), F.col("v"), "nb", ahead).toPandas()
    want = _sorted(pdf)
    want["nb"] = want.groupby("key").v.shift(-1 if ahead else 1)
    a, b = got.set_index("id").nb.sort_index(), want.set_index("id").nb.sort_index()
    assert a.fillna(-1).tolist() == b.fillna(-1).tolist()


def test_no_key(rows):
    pdf, df = rows
    got = ordered.row_numbers(df, [], [F.col("at"), F.col("id")], ordered.block("at", 10)).toPandas()
    want = pdf.sort_values(["at", "id"])
    assert got.sort_values("rn").id.tolist() == want.id.tolist()


def test_hot_key_is_split(rows):
    """The window over raw rows is partitioned by key and bucket."""
    _, df = rows
    out = ordered.row_numbers(df, ["key"], [F.col("at"), F.col("id")], ordered.block("at", 50))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(key" in plan
    assert all("__b" in line for line in plan.splitlines() if "row_number() windowspecdefinition" in line)


def test_range_ranks_of_any_order(spark):
    """One busy hour and sparse ids: places in the whole order, nulls included, spread over all tasks."""
    rows = [(i * i * 7919 % 100_003, i % 3 or None) for i in range(5000)]
    df = spark.createDataFrame(rows, "v long, g int").repartition(6)
    order = [F.col("g").asc_nulls_last(), F.col("v").desc()]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ranked = ordered.range_ranks(df.distinct(), order, "place")
        got = ranked.collect()
        per_task = [r["n"] for r in ranked.groupBy(F.floor(F.col("place") / 625)).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = sorted(set(rows), key=lambda r: (r[1] is None, r[1] or 0, -r[0]))
    assert {(r["v"], r["g"]): r["place"] for r in got} == {r: i for i, r in enumerate(want, 1)}
    assert sum(per_task) == len(want)
    assert ordered.range_ranks(df.where("false"), order, "place").collect() == []
