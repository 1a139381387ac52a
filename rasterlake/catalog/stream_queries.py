"""Streaming monitors, each drained over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.catalog.registry import query
from rasterlake.catalog.tables import progress_lines
from rasterlake.operators import jobs
from rasterlake.session import work_dir
from rasterlake.sources import readers
from rasterlake.streaming import monitors, runner

col = F.col
_SUCCESS = "starts_with(status, 'completed')"
_FAIL = "starts_with(status, 'failed')"
_CLOSED = "win_end <= (select max(ts) - interval '10 minutes' from {src})"


def _plain(df, *names):
    return df.withColumns({n: col(n).cast("timestamp_ntz") for n in names})


@query("x01_job_status_counts", f"""select * from (select win_start, win_start + interval '10 minutes' win_end, count(case when {_SUCCESS} then 1 end) completed,
    count(case when {_FAIL} then 1 end) failed, count(case when status = 'completed (degraded)' then 1 end) degraded
    from (select *, time_bucket(interval '10 minutes', ts) win_start from jobs) group by win_start) where {_CLOSED.format(src='jobs')}""")
def _(t):
    return _plain(runner.run_append(monitors.job_status_counts(t.event_stream), "x01"), "win_start", "win_end")


@query("x02_job_rate", f"""select * from (select win_start, win_start + interval '10 minutes' win_end, count(*) done
    from (select date_trunc('minute', ts) - to_minutes(i) win_start from terminal, range(10) r(i)) group by win_start) where {_CLOSED.format(src='terminal')}""")
def _(t):
    return _plain(runner.run_append(monitors.job_rate(t.event_stream), "x02"), "win_start", "win_end")


_SESSIONS = """s as (select *, sum(fresh) over (partition by {key} order by ts, event_id) sid from (select *,
    case when epoch_us(ts) - epoch_us(lag(ts) over (partition by {key} order by ts, event_id)) < {gap} * 1000000::bigint then 0 else 1 end fresh from {src}))"""


@query("x03_activity_sessions", f"""with {_SESSIONS.format(key='item_id', gap=3600, src='jobs')} select * from (select item_id, min(ts) win_start, max(ts) + interval '3600 seconds' win_end, count(*) events
    from s group by item_id, sid) where {_CLOSED.format(src='jobs')}""")
def _(t):
    return _plain(runner.run_append(monitors.activity_sessions(t.event_stream, "3600 seconds"), "x03"), "win_start", "win_end")


@query("x04_heartbeat_alerts", f"""with {_SESSIONS.format(key='item_id', gap=1800, src='jobs')} select item_id, last_seen, win_end alert_at from (select item_id, max(ts) last_seen, max(ts) + interval '1800 seconds' win_end,
    max_by(status, (ts, event_id)) last_status from s group by item_id, sid) where {_CLOSED.format(src='jobs')}
    and not (starts_with(last_status, 'completed') or starts_with(last_status, 'failed') or last_status in ('stopped', 'deleted'))""")
def _(t):
    return _plain(runner.run_append(monitors.heartbeat_alerts(t.event_stream, 1800), "x04"), "last_seen", "alert_at")


@query("x05_terminal_dedup", "select distinct item_id from terminal")
def _(t):
    return runner.run_append(monitors.terminal_dedup(t.event_stream), "x05")


@query("x05_terminal_first", "select item_id, ts, event_id, status from (select *, row_number() over (partition by item_id order by ts, event_id) rn from terminal) where rn = 1")
def _(t):
    return _plain(runner.run_append(monitors.terminal_first(t.event_stream), "x05-first"), "ts")


@query("x06_queue_stall", f"""with {_SESSIONS.format(key='batch', gap=1800, src='terminal')} select batch, last_done, win_end stalled_at, done from (select batch, max(ts) last_done,
    max(ts) + interval '1800 seconds' win_end, count(*) done, max_by(k % 4, (ts, event_id)) remaining from s group by batch, sid) where remaining > 0 and {_CLOSED.format(src='terminal')}""")
def _(t):
    return _plain(runner.run_append(monitors.queue_stall(t.event_stream, remaining=F.col("k") % 4), "x06"), "last_done", "stalled_at")


@query("x07_log_tail", """select distinct item_id, k line_no, case k % 4 when 0 then concat('frame ', k) when 1 then '❌ broken' else '⚠ odd' end line,
    case when k % 10 = 5 then 'error' when k % 4 = 0 then 'debug' when k % 4 = 1 then 'error' else 'warn' end as level from jobs where k % 4 <> 3""")
def _(t):
    lines = t.event_stream.selectExpr(
        "item_id", "k line_no", "ts", "k % 10 = 5 failed",
        "case k % 4 when 0 then concat('frame ', k) when 1 then '❌ broken' when 2 then '⚠ odd' else '  ' end line")
    return runner.run_append(monitors.log_tail(lines), "x07")


@query("x08_asset_intake", """select distinct regexp_extract(url, '^https?://[^/]+') path, timestamp '2024-01-01 00:00:00' + to_hours(cast(page_id % 24 as int)) mtime from pages""")
def _(t):
    files = t.page_stream.selectExpr(
        "regexp_extract(url, '^https?://[^/]+', 0) path",
        "cast(timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(page_id % 24 as int)) as timestamp) mtime")
    return _plain(runner.run_append(monitors.asset_intake(files), "x08"), "mtime")


@query("x09_progress_latest", """select item_id, split_part(line, '=', 1) "key", max_by(split_part(line, '=', 2), (ts, event_id)) val, max(ts) ts, max_by(event_id, (ts, event_id)) event_id
    from progress where line_kind < 2 group by 1, 2""")
def _(t):
    pairs = readers.progress_pairs(progress_lines(t.event_stream))
    return _plain(runner.run_update(monitors.progress_latest(pairs), ["item_id", "key"], "x09"), "ts")


@query("x10_level_route", """select 'error' sink, ['error','warn','info','debug','trace'][k % 5 + 1] as level, count(*) n from jobs where k % 5 = 0 group by 1, 2
    union all select 'info', ['error','warn','info','debug','trace'][k % 5 + 1], count(*) from jobs where k % 5 <= 2 group by 1, 2""")
def _(t):
    base = work_dir(t.spark, "x10")
    level = F.element_at(F.array(*[F.lit(x) for x in jobs.LEVELS]), (col("k") % 5 + 1).cast("int"))
    sinks = {name: f"{base}/{name}" for name in ("error", "info")}
    monitors.level_route(t.event_stream.withColumn("level", level), sinks, f"{base}/checkpoint").awaitTermination()
    parts = [t.spark.read.parquet(path).select(F.lit(name).alias("sink"), "level") for name, path in sinks.items()]
    return parts[0].unionByName(parts[1]).groupBy("sink", "level").agg(F.count(F.lit(1)).alias("n"))


@query("s04_stream_job_log", "select ['error','warn','info','debug','trace'][k % 5 + 1] l, count(*) n from jobs group by 1")
def _(t):
    from rasterlake.catalog.job_queries import _log_lines
    folder = work_dir(t.spark, "log")
    _log_lines(t).select("js").write.text(folder)
    stream = readers.stream_job_log(t.spark, folder)
    counts = stream.groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    return runner.run_update(counts, ["l"], "s04")
