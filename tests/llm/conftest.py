import pytest

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
#: Rows that try every operator: nulls, blanks, repeated rows and ids, a long text, accents, spaces of all kinds.
ODD = [
    (None, "one two three four five six seven eight nine ten eleven", "en", "src0", 10),
    (900_001, None, None, None, None),
    (900_002, "", "en", "src1", 0),
    (900_003, " \t\n\x0b\x0c\r ", "en", "src1", 7),
    (900_004, "word " * 3, "en", "src1", 15),
    (900_005, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu\n" * 3, "en", "src1", 9),
    (900_005, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu\n" * 3, "en", "src1", 9),
    (900_006, "Ünïcödé wörds 'tis <|endoftext|> á J̌ Σ \U0001f600 end.", "de", "src2", 3),
    (900_007, " ".join(f"w{i % 977}x{i % 31}" for i in range(6_000)), "en", "src3", 1),
    (900_008, "same id, first text of that id with more than ten words in it, so that it stays", "en", "src3", 1),
    (900_008, "same id, other text of that id with more than ten words in it, so that it stays", "en", "src4", 1),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    """The small table and the odd rows, with columns whose names operators might use themselves."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").union(spark.createDataFrame(ODD, SCHEMA)).repartition(3)
    clash = ("node", "n", "bands", "start", "end", "length", "score", "kept", "found", "kinds", "word", "row", "key", "good", "t", "w", "_id", "_hit_id", "least", "root")
    return rows.withColumns({c: F.lit("x") for c in clash}).persist()


@pytest.fixture(scope="session")
def plain(spark):
    """The small table and the odd rows with a known id each, no id twice."""
    rows = [r for i, r in enumerate(ODD) if r[0] is not None and r[0] not in [q[0] for q in ODD[:i]]]
    return spark.read.parquet(f"{SF}/documents.parquet").union(spark.createDataFrame(rows, SCHEMA)).repartition(4).persist()


@pytest.fixture(scope="session")
def texts(plain):
    return {r["doc_id"]: r["text"] or "" for r in plain.collect()}


@pytest.fixture(scope="session")
def labels(spark):
    rows = spark.read.parquet(f"{SF}/labels.parquet")
    return rows.union(spark.createDataFrame([(None, 1, 1), (900_005, None, None), (900_005, 1, 0), (7_777_777, 0, 1)], rows.schema))


@pytest.fixture(scope="session")
def benchmark(spark):
    rows = spark.read.parquet(f"{SF}/benchmark.parquet")
    return rows.union(spark.createDataFrame([(9001, None), (9002, ""), (9003, "alpha beta gamma"), (9004, "same item"), (9004, "same item"), (None, "no id at all here")], rows.schema))


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
