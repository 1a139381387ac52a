"""The pipeline's stages against the operators they call and brute force."""

from collections import Counter

import corpus_pipeline as pipeline
import pytest

from rasterlake.llm import decontaminate, ngram_join, quality, secrets

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, FOLDER).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def ids(frame):
    return Counter(r["doc_id"] for r in frame.select("doc_id").collect())


def test_order_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "near_copies", "benchmark_copies", "secret_scan", "best_fit_packing"]
    for name, (before, after) in stages.items():
        if name != "best_fit_packing":
            assert after.schema == before.schema


def test_rejected_documents_go(spark, stages):
    before, after = stages["quality_rules"]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    assert ids(after) == ids(quality.score(before, labels).where("kept"))
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    failed = {r["doc_id"] for r in quality.base_rules(before).where("base_failed").collect()}
    assert (good & set(ids(before))) - failed <= set(ids(after))


def test_one_of_each_class_stays(stages):
    before, after = stages["near_copies"]
    classes = ngram_join.join(before).toPandas()
    assert set(ids(after)) == set(classes.groupby("class_id")["doc_id"].min()) and max(ids(after).values()) == 1


def test_benchmark_copies_go(spark, stages):
    before, after = stages["benchmark_copies"]
    found = {r["doc_id"] for r in decontaminate.find(before, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
    assert found and set(ids(after)) == set(ids(before)) - found


def test_secrets_are_gone(stages):
    before, after = stages["secret_scan"]
    assert ids(after) == ids(before)
    assert secrets.digest(after).where("n_access + n_hex > 0").count() == 0
    held = secrets.digest(before).where("spans <> ''").select("doc_id")
    same = before.join(held, "doc_id", "left_anti").select("doc_id", "text", "n_chars")
    assert same.exceptAll(after.select("doc_id", "text", "n_chars")).count() == 0
    assert after.where("n_chars <> length(text)").count() == 0


def test_packing_holds_every_document(stages):
    before, after = stages["best_fit_packing"]
    assert set(ids(after)) == set(ids(before))
    by = after.groupBy("sequence_id").sum("length").toPandas()
    assert by["sum(length)"].max() <= 2048


def test_run(spark, stages):
    rows = pipeline.run(spark, FOLDER)
    assert rows.count() == stages["best_fit_packing"][1].count()
    assert pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_stages_on_odd_rows(spark, docs, none, kind, tmp_path):
    """Nulls in every column, repeated ids and rows, long and blank texts, clashing columns; an empty table."""
    rows = docs if kind == "odd" else none
    for name, stage in pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, rows, FOLDER).write.parquet(path)
        after = spark.read.parquet(path)
        if name != "best_fit_packing":
            assert after.columns == rows.columns
        assert after.isEmpty() == (kind == "empty")
        rows = after
