"""Monitors over several micro-batches: late rows, duplicates, restarts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rasterlake.catalog import all_queries
from rasterlake.session import work_dir
from rasterlake.streaming import monitors, runner

SCHEMA = "event_id long, item_id long, ts timestamp, status string"


def at(minutes, seconds=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes, seconds=seconds)


@pytest.fixture()
def feed(spark, tmp_path):
    """Writes each batch as its own file; one file is read per micro-batch."""
    n = [0]

    def put(*rows):
        n[0] += 1
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/b{n[0]}")

    def stream():
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")

    put.stream = stream
    return put


def drain(stream, base):
    q = (stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
         .option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp").start())
    q.awaitTermination()
    return q


def test_counts_drop_rows_beyond_the_watermark(spark, feed, tmp_path):
    base = str(tmp_path / "counts")
    feed((1, 1, at(1), "completed"), (2, 2, at(2), "failed: 1"))
    drain(monitors.job_status_counts(feed.stream()), base)
    feed((3, 3, at(40), "completed (degraded)"))
    drain(monitors.job_status_counts(feed.stream()), base)
    feed((4, 4, at(3), "completed"))  # far older than the watermark: dropped
    feed((5, 5, at(90), "pending"))
    drain(monitors.job_status_counts(feed.stream()), base)
    got = {r.win_start: (r.completed, r.failed, r.degraded) for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {at(0): (1, 1, 0), at(40): (1, 0, 1), at(90) - dt.timedelta(0): (0, 0, 0)} or got == {at(0): (1, 1, 0), at(40): (1, 0, 1)}


def test_restart_neither_loses_nor_repeats(spark, feed, tmp_path):
    base = str(tmp_path / "dedup")
    feed((1, 7, at(1), "completed"), (2, 8, at(1), "processing"))
    drain(monitors.terminal_dedup(feed.stream()), base)
    feed((3, 7, at(2), "failed: 2"), (4, 8, at(3), "stopped"))
    drain(monitors.terminal_dedup(feed.stream()), base)
    drain(monitors.terminal_dedup(feed.stream()), base)
    assert sorted(r.item_id for r in spark.read.parquet(f"{base}/out").collect()) == [7, 8]


def test_first_terminal_event_with_its_payload(spark, feed, tmp_path):
    """Over micro-batches and a restart: the earliest of those that came in together, later ones change nothing, state ends with the retention."""
    base = str(tmp_path / "first")
    feed((1, 7, at(5), "stopped"), (2, 7, at(4), "failed: 1"), (3, 8, at(1), "processing"), (4, 9, at(2), "completed"), (5, 9, at(2), "stopped"))
    drain(monitors.terminal_first(feed.stream()), base)
    feed((6, 7, at(1), "completed"), (7, 8, at(9), "completed"))
    drain(monitors.terminal_first(feed.stream()), base)
    drain(monitors.terminal_first(feed.stream()), base)
    got = sorted((r.item_id, r.ts, r.event_id, r.status) for r in spark.read.parquet(f"{base}/out").collect())
    assert got == [(7, at(4), 2, "failed: 1"), (8, at(9), 7, "completed"), (9, at(2), 4, "completed")]
    feed((8, 10, at(60 * 24 * 40), "stopped"))
    drain(monitors.terminal_first(feed.stream()), base)
    feed((9, 7, at(60 * 24 * 41), "completed"))
    drain(monitors.terminal_first(feed.stream()), base)
    assert [r.status for r in spark.read.parquet(f"{base}/out").where("item_id = 7").orderBy("ts").collect()] == ["failed: 1", "completed"]


def test_heartbeat_alerts(spark, feed):
    feed((1, 1, at(0), "processing"), (2, 1, at(1), "processing 5%"), (3, 2, at(0), "processing"), (4, 2, at(1), "completed"),
         (5, 3, at(0), "processing"), (6, 3, at(5), "processing 9%"), (7, 9, at(60), "pending"))
    got = {(r.item_id, r.last_seen, r.alert_at) for r in runner.run_append(monitors.heartbeat_alerts(feed.stream(), 120), "t").collect()}
    assert got == {(1, at(1), at(3)), (3, at(0), at(2)), (3, at(5), at(7))}


def test_sessions_and_stalls(spark, feed):
    feed((1, 1, at(0), "completed"), (2, 1, at(29), "stopped"), (3, 1, at(65), "completed"), (4, 1, at(200), "completed"))
    stream = feed.stream().withColumn("batch", F.lit(0))
    got = {(r.last_done, r.stalled_at, r.done) for r in runner.run_append(monitors.queue_stall(stream), "t").collect()}
    assert got == {(at(29), at(59), 2), (at(65), at(95), 1)}


def test_update_keeps_the_newest_state(spark, feed):
    feed((1, 1, at(0), "10"))
    feed((2, 1, at(5), "50"), (3, 2, at(1), "7"))
    feed((4, 1, at(3), "30"))  # older than what is known
    stream = feed.stream().selectExpr("event_id", "item_id", "ts", "'frame' key", "status val")
    got = {(r.item_id, r.val) for r in runner.run_update(monitors.progress_latest(stream), ["item_id", "key"], "t").collect()}
    assert got == {(1, "50"), (2, "7")}


def test_routing_twice_writes_once(spark, tmp_path):
    batch = spark.createDataFrame([("error",), ("info",), ("trace",)], "level string")
    sinks = {"error": str(tmp_path / "e"), "info": str(tmp_path / "i")}
    for _ in range(2):
        monitors.route_levels(batch, sinks, epoch=4)
    assert spark.read.parquet(sinks["error"]).count() == 1
    assert spark.read.parquet(sinks["info"]).count() == 2


class _Fake:
    """A session that reports the given settings."""

    def __init__(self, folder, checkpoint, master):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = self
        self.master, self.applicationId = master, f"app-{folder}-{checkpoint}-{master}"
        self.getCheckpointDir = lambda: checkpoint


def test_work_dir():
    assert work_dir(_Fake("/shared/a", None, "yarn"), "x").startswith("/shared/a/x-")
    assert work_dir(_Fake(None, "hdfs://h/cp", "yarn"), "x").startswith("hdfs://h/cp/x-")
    assert work_dir(_Fake(None, None, "local[2]"), "x").startswith("/tmp/spark-")
    with pytest.raises(ValueError):
        work_dir(_Fake(None, None, "yarn"), "x")


def test_items_are_remembered_beyond_the_hour(spark, feed):
    """One item with terminal events hours apart, each in a micro-batch of its own."""
    for i, minute in enumerate((1, 60, 120, 180)):
        feed((i, 7, at(minute), "completed"), (100 + i, 1000 + i, at(minute), "completed"))
    got = sorted(r.item_id for r in runner.run_append(monitors.terminal_dedup(feed.stream()), "hours").collect())
    assert got == [7, 1000, 1001, 1002, 1003]
    lines = feed.stream().selectExpr("item_id", "cast(1 as int) line_no", "ts", "false failed", "'frame 1' line")
    assert runner.run_append(monitors.log_tail(lines), "lines").where("item_id = 7").count() == 1
    files = feed.stream().selectExpr("cast(item_id as string) path", "timestamp'2024-01-01' mtime")
    assert runner.run_append(monitors.asset_intake(files), "files").where("path = '7'").count() == 1


def test_finished_batch_raises_no_stall(spark, feed):
    """A batch whose last item is done is silent, but not stalled."""
    feed((1, 1, at(1), "completed"), (2, 2, at(1), "completed"))
    feed((3, 1, at(2), "completed"), (4, 2, at(2), "completed"))
    feed((5, 9, at(600), "completed"))
    left = F.when(F.col("event_id") == 3, 0).when(F.col("event_id") == 4, 5).otherwise(1)
    alerts = monitors.queue_stall(feed.stream(), 60, 3, "1 minute", batch="item_id", remaining=left)
    assert [r.item_id for r in runner.run_append(alerts, "stall").collect()] == [2]


def test_streams_take_tables_of_several_files(spark, tmp_path):
    """A table may be one file or a folder of them."""
    for name in ("events", "pages"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("x05_terminal_dedup", "x08_asset_intake"):
        got, want = (sorted(map(str, all_queries().QUERIES[name](spark, at).collect())) for at in (str(tmp_path), "/root/testdata/sf0.001"))
        assert got == want != []
