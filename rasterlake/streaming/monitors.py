"""Structured Streaming forms of the queue monitors.

Every function maps a streaming DataFrame of job events (event_id, item_id,
ts, status, ...) to another; all state is native to Spark, keyed and bounded by
a watermark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.operators.jobs import LEVELS, is_degraded, is_failure, is_success, is_terminal, line_level


#: How long, in event time, what was seen is remembered.
RETENTION = "30 days"


def _flat(df: DataFrame, window: str = "window") -> DataFrame:
    rest = [c for c in df.columns if c != window]
    return df.select(F.col(f"{window}.start").alias("win_start"), F.col(f"{window}.end").alias("win_end"), *rest)


def _dedup(stream: DataFrame, keys: list[str], parts: int = 64) -> DataFrame:
    """Drop repeats within the watermark in two steps.

    The first step works on (key, input split), so the repeats of one busy key
    are removed by many tasks; at most `parts` rows of it reach the second. The
    columns kept by the callers are the keys, so it does not matter which
    repeat survives.
    """
    split = stream.withColumn("__part", F.spark_partition_id() % parts)
    first = split.dropDuplicatesWithinWatermark([*keys, "__part"])
    return first.drop("__part").dropDuplicatesWithinWatermark(keys)


def job_status_counts(stream: DataFrame, size: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    s = F.col("status")
    return _flat(stream.withWatermark("ts", delay).groupBy(F.window("ts", size)).agg(
        F.count_if(is_success(s)).alias("completed"),
        F.count_if(is_failure(s)).alias("failed"),
        F.count_if(is_degraded(s)).alias("degraded"),
    ))


def job_rate(stream: DataFrame, size: str = "10 minutes", slide: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Rolling completions over overlapping windows; counts combine before the
    shuffle, so a window costs one row per task however busy it is."""
    done = stream.where(is_terminal(F.col("status"))).withWatermark("ts", delay)
    return _flat(done.groupBy(F.window("ts", size, slide)).agg(F.count(F.lit(1)).alias("done")))


def activity_sessions(stream: DataFrame, gap: str = "120 seconds", delay: str = "10 minutes") -> DataFrame:
    """An item silent for the heartbeat timeout closes its session."""
    return _flat(stream.withWatermark("ts", delay).groupBy("item_id", F.session_window("ts", gap)).agg(
        F.count(F.lit(1)).alias("events")), "session_window")


def heartbeat_alerts(stream: DataFrame, timeout_seconds: int = 120, delay: str = "10 minutes",
                     applies: Column | None = None) -> DataFrame:
    """One alert per silence: the item's session ended and nothing followed for
    the timeout. A terminal event ends the item, so no alert follows it."""
    limit = min(max(timeout_seconds, 1), 3600)
    seen = stream if applies is None else stream.where(applies)
    sessions = seen.withWatermark("ts", delay).groupBy("item_id", F.session_window("ts", f"{limit} seconds")).agg(
        F.max(F.struct("ts", "event_id", "status")).alias("last"))
    return sessions.where(~is_terminal(F.col("last.status"))).select(
        "item_id", F.col("last.ts").alias("last_seen"), F.col("session_window.end").alias("alert_at"))


def terminal_dedup(stream: DataFrame, retention: str = RETENTION) -> DataFrame:
    """Each item once, when its first terminal event comes in. An item is remembered
    for the retention, in event time, so it must outlive the queue."""
    ends = stream.where(is_terminal(F.col("status"))).withWatermark("ts", retention)
    return _dedup(ends, ["item_id"]).select("item_id")


def terminal_first(stream: DataFrame, retention: str = RETENTION) -> DataFrame:
    """The first terminal event of each item with its payload: item_id, ts, event_id, status.

    Of the events that come in together the earliest counts; one that comes in later
    changes nothing. An item's state is one mark, dropped when its event is older than the
    retention, in event time; events older than that are not taken in either.
    """
    ends = stream.where(is_terminal(F.col("status"))).withWatermark("ts", retention).select("item_id", "ts", "event_id", "status")

    def first(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        best = None
        for frame in frames:
            if frame.empty:
                continue
            row = frame.sort_values(["ts", "event_id"]).iloc[[0]]
            if best is None or (row["ts"].iloc[0], row["event_id"].iloc[0]) < (best["ts"].iloc[0], best["event_id"].iloc[0]):
                best = row
        if best is not None and not state.exists:
            state.update((True,))
            state.setTimeoutTimestamp(max(int(best["ts"].iloc[0].timestamp() * 1000), state.getCurrentWatermarkMs()) + 1)
            yield best[["item_id", "ts", "event_id", "status"]]

    return ends.groupBy("item_id").applyInPandasWithState(first, ends.schema, "seen boolean", "append", "EventTimeTimeout")


def queue_stall(stream: DataFrame, window_seconds: int = 600, windows: int = 3, delay: str = "10 minutes",
                batch: str = "batch", remaining: Column | None = None) -> DataFrame:
    """An unfinished batch without a terminal event for several windows in a row.

    Terminal events closer together than windows*window_seconds form one
    session; a closed session means the queue stalled after it. `remaining`
    says with each event how many items of its batch are not done: after the
    last one of a finished batch, none, and so no stall. Without it, every
    batch counts as unfinished.
    """
    gap = window_seconds * windows
    ends = stream.where(is_terminal(F.col("status"))).withWatermark("ts", delay)
    sessions = ends.groupBy(batch, F.session_window("ts", f"{gap} seconds")).agg(
        F.count(F.lit(1)).alias("done"), F.max("ts").alias("last_done"),
        F.max(F.struct("ts", "event_id", (F.lit(1) if remaining is None else remaining).alias("left"))).alias("last"))
    return sessions.where(F.col("last.left") > 0).select(batch, "last_done", F.col("session_window.end").alias("stalled_at"), "done")


def log_tail(lines: DataFrame, retention: str = RETENTION) -> DataFrame:
    """Log lines not forwarded within the retention: item_id, line_no, ts, line, failed."""
    kept = lines.withWatermark("ts", retention).where(F.trim("line") != "")
    levelled = kept.select("ts", "item_id", "line_no", "line", line_level(F.col("line"), F.col("failed")).alias("level"))
    return _dedup(levelled, ["item_id", "line_no", "line", "level"]).drop("ts")


def asset_intake(files: DataFrame, retention: str = RETENTION) -> DataFrame:
    """Each (path, mtime) once within the retention."""
    return _dedup(files.withWatermark("mtime", retention), ["path", "mtime"])


def progress_latest(progress: DataFrame) -> DataFrame:
    """Latest value of each metric of each item, for update or complete mode."""
    return progress.groupBy("item_id", "key").agg(
        F.max(F.struct("ts", "event_id", "val")).alias("s")).select(
        "item_id", "key", F.col("s.val").alias("val"), F.col("s.ts").alias("ts"), F.col("s.event_id").alias("event_id"))


def route_levels(batch: DataFrame, sinks: dict[str, str], epoch: int, level: str = "level") -> None:
    """Write one micro-batch to several sinks, each with its severity filter.

    A sink's epoch folder is overwritten, so a retried batch is not doubled.
    """
    batch.persist()
    try:
        for threshold, path in sinks.items():
            kept = [n for n, rank in LEVELS.items() if rank <= LEVELS[threshold]]
            batch.where(F.col(level).isin(*kept)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    finally:
        batch.unpersist()


def level_route(stream: DataFrame, sinks: dict[str, str], checkpoint: str, level: str = "level"):
    """Start the routing query; sinks maps a severity threshold to a folder."""
    return (
        stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
        .foreachBatch(lambda df, epoch: route_levels(df, sinks, epoch, level)).start()
    )
