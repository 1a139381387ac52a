"""Readers and writers over small generated files."""

import json

import pytest
from pyspark.sql import functions as F

from rasterlake.operators import metadata
from rasterlake.sources import readers, writers

HEADS = {
    "a.png": bytes.fromhex("89504E470D0A1A0A0000000D"), "b.jpg": bytes.fromhex("FFD8FFE000104A4649460001"),
    "c.webp": b"RIFF\x00\x00\x00\x00WEBP", "d.avif": b"\x00\x00\x00\x1cftypavif", "e.jxl": bytes.fromhex("FF0A0000"),
    "f.jxl": b"\x00\x00\x00\x0cJXL \r\n\x87\n", "g.tif": b"II*\x00\x08\x00\x00\x00", "h.heic": b"\x00\x00\x00\x1cftypheic",
    "wrong.png": bytes.fromhex("FFD8FFE000104A4649460001"), "k.gif": b"GIF89a\x00\x00", "n.txt": b"hello world!",
}


@pytest.fixture()
def tree(tmp_path):
    for i, (name, head) in enumerate(HEADS.items()):
        folder = tmp_path / ("out" if name == "e.jxl" else "sub" if i % 2 else ".")
        folder.mkdir(exist_ok=True)
        (folder / name).write_bytes(head + bytes(20))
    (tmp_path / "outer").mkdir()
    (tmp_path / "outer" / "z.PNG").write_bytes(HEADS["a.png"])
    return tmp_path


def test_scan_assets_skips_output_subtree(spark, tree):
    files = readers.scan_assets(spark, str(tree), ("png", "jpg", "jxl"), f"file:{tree}/out")
    names = {r.path.rsplit("/", 1)[1] for r in files.collect()}
    assert names == {"a.png", "b.jpg", "f.jxl", "wrong.png", "z.PNG"}
    plan = files._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: ")[1].split("\n")[0] if "ReadSchema" in plan else ""
    assert "content" not in schema


def test_named_files_are_always_accepted(spark, tree):
    files = readers.scan_assets(spark, str(tree), ("png",), f"file:{tree}/out", files=[f"{tree}/out/e.jxl", f"{tree}/a.png"])
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.collect()) == ["a.png", "e.jxl", "wrong.png", "z.PNG"]


def test_magic(spark, tree):
    got = {r.path.rsplit("/", 1)[1]: (r.magic, r.mismatch) for r in readers.sniff_formats(spark, str(tree)).collect()}
    assert got["wrong.png"] == ("jpg", True)
    assert got["n.txt"] == (None, False)
    assert {k: v[0] for k, v in got.items() if k in "a.png b.jpg c.webp d.avif f.jxl g.tif h.heic k.gif".split()} == {
        "a.png": "png", "b.jpg": "jpg", "c.webp": "webp", "d.avif": "avif", "f.jxl": "jxl", "g.tif": "tiff", "h.heic": "heif", "k.gif": "gif"}
    assert sum(v[1] for v in got.values()) == 1


def test_matrix_csv(spark, tmp_path):
    head = "src,dst,status,maxRowSumDev," + ",".join(f"m{r}{c}" for r in range(3) for c in range(3))
    (tmp_path / "m.csv").write_text(head + "\nbt709,bt2020,ok,1.5E-08,0.627,0.329,0.043,0.069,0.919,0.011,0.016,0.088,0.895\n")
    row = readers.read_matrix_csv(spark, str(tmp_path)).first()
    assert (row.src, row.max_row_sum_dev, row.m22) == ("bt709", 1.5e-8, 0.895)


def test_tag_dump_keeps_numbers_as_text(spark, tmp_path):
    dump = [{"SourceFile": "/in/a.jpg", "IFD0:Make": "X", "ExifIFD:ISO": 200, "GPS:On": True, "Plain": 1.5}]
    (tmp_path / "d.json").write_text(json.dumps(dump))
    got = {(r.grp, r.tag): r.value for r in readers.read_tag_dump(spark, str(tmp_path)).collect()}
    assert got == {("IFD0", "Make"): "X", ("ExifIFD", "ISO"): "200", ("GPS", "On"): "true", (None, "Plain"): "1.5"}


@pytest.mark.parametrize("style", ["lines", "crlf", "indented", "minified"])
def test_tag_dump_of_several_splits_equals_the_whole(spark, tmp_path, style):
    """Records that byte ranges cut, values that look like borders, nested values, one record, none."""
    dump = [{"SourceFile": f"/in/{i}.jpg", "IFD0:Make": f"m{i} }},{{ é", "XMP:Regions": [{"a": i}, {"b": "},\n{"}], "ExifIFD:ISO": i, "GPS:On": None if i % 5 else "[x]"} for i in range(400)]
    texts = {"lines": lambda d: "[" + ",\n".join(json.dumps(r, ensure_ascii=False) for r in d) + "]\n", "minified": lambda d: json.dumps(d)}
    texts["crlf"] = lambda d: texts["lines"](d).replace("\n", "\r\n")
    texts["indented"] = lambda d: json.dumps(d, indent=2)
    for name, rows in (("many", dump), ("one", dump[:1]), ("none", [])):
        (tmp_path / f"{name}.json").write_bytes(texts[style](rows).encode())
    border = "},\n  {" if style == "indented" else readers.RECORD_BORDERS[style == "crlf"]
    whole = {(r["SourceFile"], k.split(":")[-1]) for r in dump for k, v in r.items() if k != "SourceFile"}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = readers.read_tag_dump(spark, str(tmp_path), border)
        tasks, got = rows.rdd.getNumPartitions(), rows.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == sum(len(r) - 1 for r in dump) + len(dump[0]) - 1
    assert {(r.file, r.tag) for r in got} == whole and (tasks > 5 or style == "minified")
    by = {(r.file, r.tag): r.value for r in got}
    for r in dump[::37] + dump[-1:]:
        assert by[r["SourceFile"], "Make"] == r["IFD0:Make"] and by[r["SourceFile"], "ISO"] == str(r["ExifIFD:ISO"])
        assert json.loads(by[r["SourceFile"], "Regions"]) == r["XMP:Regions"] and by[r["SourceFile"], "On"] == r["GPS:On"]


def test_bench_json_and_tsv(spark, tmp_path):
    rows = [{"case_id": "c", "arm_id": "a", "output_bytes": 10, "baseline_l9_bytes": 20, "pixel_equal": True, "status": "ok", "time_ms": 5}]
    (tmp_path / "bench.json").write_text(json.dumps(rows))
    assert readers.read_bench_rows(spark, str(tmp_path / "bench.json")).first().output_bytes == 10


def test_progress_key_shape(spark, tmp_path):
    (tmp_path / "p.txt").write_text("frame=12\nstream_0_0_q=-1.0\nFrame=3\nInput #0, x = y\n=5\nout_time= 00:01\n")
    got = {(r.key, r.val) for r in readers.read_progress(spark, str(tmp_path)).collect()}
    assert got == {("frame", "12"), ("stream_0_0_q", "-1.0"), ("out_time", "00:01")}


def test_write_guard(spark, tmp_path):
    df, path = spark.range(3), str(tmp_path / "t")
    assert writers.write_guarded(df, path, allow_overwrite=False) == "completed"
    assert writers.write_guarded(spark.range(9), path, allow_overwrite=False) == "failed: exists"
    assert spark.read.parquet(path).count() == 3
    assert writers.write_guarded(spark.range(9), path) == "completed"
    assert spark.read.parquet(path).count() == 9


def test_ledger_with_awkward_values(spark, tmp_path):
    from rasterlake.model import LEDGER_SCHEMA
    values = ['plain', 'a,b', 'say "hi"', 'back\\slash']
    rows = [[v if f == "value" else "unaudited" if f == "disposition" else "x" for f in LEDGER_SCHEMA.names] for v in values]
    writers.write_ledger(spark.createDataFrame(rows, LEDGER_SCHEMA), str(tmp_path))
    back = readers.read_ledger_csv(spark, str(tmp_path / "ledger"))
    assert sorted(r.value for r in back.collect()) == sorted(values)


def test_bucketed_tiles_join_without_shuffle(spark):
    px = spark.range(64 * 4).selectExpr("id div 64 asset_id", "cast(id % 64 div 8 as int) y", "cast(id % 8 as int) x", "cast(id as int) code")
    for name in ("tiles_ref", "tiles_enc"):
        spark.sql(f"drop table if exists {name}")
        writers.write_tiles(px, name, buckets=4, tile=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ref, enc = spark.table("tiles_ref"), spark.table("tiles_enc").withColumnRenamed("samples", "b")
        both = ref.join(enc, ["asset_id", "ty", "tx"])
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
        assert both.count() == 16
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("tiles_ref", "tiles_enc"):
            spark.sql(f"drop table if exists {name}")


def test_first_rule_is_ordered(spark):
    df = spark.createDataFrame([("Make", "ACME"), ("Make", None), ("makeup", "ACME"), ("Zoom", "x")], "tag string, make string")
    rules = [("R1", "^make$", "^acme", "c1", "d1", "verified"), ("R2", "^make", None, "c2", "d2", "pending")]
    got = [(r.rule, r.disposition) for r in metadata.first_rule(df, rules).collect()]
    assert got == [("R1", "d1"), ("R2", "d2"), ("R2", "d2"), ("none", "unaudited")]


def test_coverage_statuses(spark):
    src = spark.createDataFrame([(1, "E", "ISO", "100"), (1, "E", "UserComment", ""), (1, "E", "Lens", "L"), (1, "E", "F", "2.0"), (1, "E", "W", "1")],
                                "asset_id int, grp string, tag string, value string")
    dst = spark.createDataFrame([(1, "E", "ISO", "100"), (1, "E", "F", "2.2"), (1, "E", "New", "1")], src.schema)
    got = {r.tag: r.status for r in metadata.tag_coverage_diff(src, dst, waived=("W",)).collect()}
    assert got == {"ISO": "present", "UserComment": "empty_skipped", "Lens": "missing", "F": "differs", "W": "waived", "New": "extra"}
    assert [r.tag for r in metadata.missing_required(src, dst, waived=("W",)).collect()] == ["Lens"]


PAIRS = "asset_id int, grp string, tag string, value string"


def _twice(spark):
    """Two tag tables with repeats and nulls."""
    a = spark.createDataFrame([(1, "E", "ISO", "1"), (1, "G", "ISO", "2"), (2, "E", "Lens", "x"), (None, "E", "ISO", "1"), (3, "E", None, "1"), (4, "E", "W", "1")], PAIRS)
    b = spark.createDataFrame([(1, "E", "ISO", "9"), (1, "E", "ISO", "8"), (None, "X", "ISO", "1"), (3, "E", None, None), (5, "E", "W", "1")], PAIRS)
    return a, b


def test_missing_pairs_need_no_join(spark):
    """A join would send the expanded side through the driver, as the optimiser takes it for small."""
    a, b = _twice(spark)
    got = metadata.missing_required(a, b)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, a.select("asset_id", "tag").subtract(b.select("asset_id", "tag")).collect()))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_common_pairs_need_no_join(spark):
    a, b = _twice(spark)
    got = metadata.covered_common(a, b)
    assert sorted(map(str, got.collect())) == sorted(map(str, a.select("asset_id", "tag").intersect(b.select("asset_id", "tag")).collect()))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def _sorts_no_file_split(df):
    """Below the first shuffle, where a task has a file split's rows, nothing is held to be combined."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    last = max(i for i, x in enumerate(lines) if "Exchange hashpartitioning" in x)
    return not any("Aggregate" in x or " Sort " in x for x in lines[last:])


def test_overlays_combine_behind_a_shuffle(spark):
    a, b = _twice(spark)
    got = metadata.carry_tags(a, b)
    assert _sorts_no_file_split(got)
    assert {(r.asset_id, r.grp, r.tag, r.value, r.origin) for r in got.where("asset_id < 3").collect()} == {
        (1, "E", "ISO", "1", "source"), (1, "G", "ISO", "2", "source"), (2, "E", "Lens", "x", "source")}
    assert _sorts_no_file_split(metadata.backfill_capture_tags(a, b))


def test_differences_combine_behind_a_shuffle(spark):
    a, b = _twice(spark)
    assert _sorts_no_file_split(metadata.tag_coverage_diff(a, b)) and _sorts_no_file_split(metadata.version_diff(a, b))
    assert {(r.asset_id, r.tag, r.before, r.after) for r in metadata.version_diff(a, b).where("asset_id in (1, 2)").collect()} == {
        (1, "ISO", "1", "9"), (1, "ISO", "2", None), (2, "Lens", "x", None)}


def test_maps_combine_behind_a_shuffle(spark):
    _, b = _twice(spark)
    got = metadata.long_to_map(b.where("tag is not null"))
    assert _sorts_no_file_split(got)
    assert {r.asset_id: r.tags for r in got.collect()} == {1: {"E:ISO": "9"}, None: {"X:ISO": "1"}, 5: {"E:W": "1"}}


def test_sql_functions_equal_the_columns(spark):
    from rasterlake.functions import curves, gain, media, text
    from rasterlake.functions.registered import register_functions
    register_functions(spark)
    toks = spark.createDataFrame([("sRGB", "yuva420p", "3/2"), (" PQ ", "rgbaf16le", "x"), ("", "gray", "4"), ("p3", None, "1/0"), (None, "ya8", "-2.5")],
                                 "tok string, pf string, rat string")
    pairs = [("rl_norm_transfer(tok)", media.norm_transfer(F.col("tok"))), ("rl_norm_primaries(tok)", media.norm_primaries(F.col("tok"))),
             ("rl_has_alpha(pf)", media.has_alpha(F.col("pf"))), ("rl_is_float(pf)", media.is_float(F.col("pf"))),
             ("rl_rational(rat)", media.rational(F.col("rat"))), ("rl_value_digest(tok)", text.value_digest(F.col("tok")))]
    for sql, column in pairs:
        assert all(r[0] == r[1] for r in toks.select(F.expr(sql), column).collect()), sql
    nums = spark.range(0, 20).select((F.col("id") / 19).alias("v"), (F.col("id") * 997 * F.col("id") ** 5).cast("long").alias("n"))
    pairs = [("rl_srgb_to_linear(v)", curves.to_linear(F.col("v"), curves.named_curve("iec61966-2-1"))),
             ("rl_pq_to_linear(v)", curves.pq_to_linear(F.col("v"))), ("rl_hlg_to_linear(v)", curves.hlg_to_linear(F.col("v"))),
             ("rl_log2_gain(v, 0.1D)", gain.log2_gain(F.col("v"), F.lit(0.1)))]
    for sql, column in pairs:
        assert nums.where(F.abs(F.expr(sql) - column) > 1e-12).count() == 0, sql
    assert all(r[0] == r[1] for r in nums.select(F.expr("rl_format_size(n)"), text.format_size(F.col("n"))).collect())
    plan = nums.select(F.expr("rl_pq_to_linear(v)"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
