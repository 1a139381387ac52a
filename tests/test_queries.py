"""Every registered query against its SQL counterpart, and rules for all plans."""

import re

import duckdb
import pytest

import __spark_entry__ as contract
from rasterlake.catalog import all_queries
from rasterlake.catalog.compare import compare
from rasterlake.catalog.tables import BASE

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = all_queries().QUERIES, all_queries().ORACLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(name, spark, duck):
    got = QUERIES[name](spark, FOLDER).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert len(want) > 0
    assert compare(got, want) == ""


def test_scores_of_events_without_k(spark, tmp_path):
    """Props that are null, lack k or hold one that leaves no number: no score, in the SQL as in the query."""
    con = duckdb.connect()
    con.execute(f"""copy (select event_id, ts, user_id, event_type, value, case event_id % 9 when 0 then null when 1 then '{{}}' when 2 then '{{"k": -130}}'
        when 3 then '{{"k": -7}}' when 4 then '{{"k": 4000}}' else props end props from '{FOLDER}/events.parquet') to '{tmp_path}/events.parquet' (format parquet)""")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    got, want = QUERIES["c08_parse_scores"](spark, str(tmp_path)).toPandas(), con.execute(ORACLES["c08_parse_scores"]).df()
    assert len(got) == 1000 and got[got.event_id % 9 < 2].drop(columns="event_id").isna().all(axis=None)
    assert compare(got, want) == ""


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


def test_contract_holds_all_queries():
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", ["a01_psnr_buffers"])
def test_buffer_plan_has_one_kernel(name, spark):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "CartesianProduct" not in plan and "BatchEvalPython" not in plan


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(("x", "s")) and not n.endswith("_buffers")])
def test_plan_has_no_cross_join_and_no_python(name, spark):
    """Only the buffer forms run a kernel over Arrow batches; no query has a row-wise function."""
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert not re.search(r"(Python|Pandas)", plan)


def test_inventory_is_covered():
    """Every row of the inventory has a query."""
    ids = {re.match(r"([a-z])0?(\d+)_", n).groups() for n in QUERIES}
    sizes = {"s": 10, "f": 16, "j": 26, "a": 29, "w": 10, "t": 6, "u": 6, "c": 41, "p": 13, "r": 8, "x": 10}
    want = {(k, str(i)) for k, n in sizes.items() for i in range(1, n + 1)}
    assert want - ids == set()


def test_entry(spark):
    out = contract.entry(spark)
    assert out.columns == ["asset_id", "sse", "n", "psnr", "status"]
    assert out.count() == 500
