"""Jobs: inputs, target names, settings, queue state, telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.catalog.registry import query
from rasterlake.model import IMAGE_EXTENSIONS, VIDEO_EXTENSIONS, extension_dim
from rasterlake.operators import axes, jobs, ordered
from rasterlake.session import work_dir
from rasterlake.sources import readers, writers

col = F.col
_ENABLED = ("PNG", "JPEG", "AVIF", "JPEG XL", "MP4")
_SUCCESS = "starts_with(status, 'completed')"
_FAIL = "starts_with(status, 'failed')"


def _ts(name="ts"):
    return col(name).cast("timestamp_ntz").alias(name)


# --- sources and sinks ---------------------------------------------------------
@query("s01_scan_assets", """select path, ext, size from paths where ext in ('png','jpg','avif') and
    not (starts_with(lower(path), concat(lower(regexp_extract(path, '^/[^/]+/en')), '/')) and regexp_extract(path, '^/[^/]+/en') <> '')""")
def _(t):
    # Files on disk are scanned in the tests; here the same selection runs over
    # the inventory of the pages table, with each host's /en tree as output.
    kept = readers.select_assets(t.paths, ("png", "jpg", "avif"))
    from rasterlake.functions.text import under_prefix
    out = F.nullif(F.regexp_extract("path", "^/[^/]+/en", 0), F.lit(""))
    return kept.where(~under_prefix(col("path"), out)).select("path", "ext", "size")


_LOG = "date_trunc('second', ts)"


def _log_lines(t):
    level = F.element_at(F.array(*[F.lit(x) for x in jobs.LEVELS]), (col("k") % 5 + 1).cast("int"))
    return t.jobs.select("event_id", F.to_json(F.struct(
        F.date_trunc("second", "ts").alias("t"), level.alias("l"), F.lit("progress").alias("c"), col("status").alias("m"),
        col("k").alias("p"), F.when(col("k") % 2 == 0, col("value")).alias("dur"), col("exit_code").alias("code"))).alias("js"))


@query("s04_read_job_log", f"""select {_LOG} t, ['error','warn','info','debug','trace'][k % 5 + 1] l, 'progress' c, status m, null::varchar f, k p, null::int tot,
    case when k % 2 = 0 then value end dur, exit_code code from jobs""")
def _(t):
    folder = work_dir(t.spark, "log")
    _log_lines(t).select("js").write.text(folder)
    return readers.read_job_log(t.spark, folder).withColumn("t", _ts("t"))


@query("s05_read_progress", "select split_part(line, '=', 1) \"key\", split_part(line, '=', 2) val, count(*) n from progress where line_kind < 2 group by 1, 2")
def _(t):
    folder = work_dir(t.spark, "progress")
    t.progress.select("line").write.text(folder)
    return readers.read_progress(t.spark, folder).groupBy("key", "val").agg(F.count(F.lit(1)).alias("n"))


@query("s08_write_guarded", "select 'completed' first_write, 'failed: exists' second_write, count(*) kept from paths")
def _(t):
    folder = work_dir(t.spark, "guarded")
    first = writers.write_guarded(t.paths, folder, allow_overwrite=False)
    second = writers.write_guarded(t.paths, folder, allow_overwrite=False)
    return t.spark.read.parquet(folder).agg(
        F.lit(first).alias("first_write"), F.lit(second).alias("second_write"), F.count(F.lit(1)).alias("kept"))


# --- filters -------------------------------------------------------------------
@query("f01_filter_enabled_formats", "select asset_id, path, ext from paths where ext in ('png','jpg','avif','jxl','mp4')")
def _(t):
    return jobs.filter_enabled_formats(t.paths, _ENABLED).select("asset_id", "path", "ext")


@query("f02_reject_decode_only", "select asset_id, ext from paths where ext <> 'heic'")
def _(t):
    dotted = t.paths.withColumn("target", F.concat(F.lit(" ."), F.upper("ext")))
    return jobs.reject_decode_only(dotted, "target").select("asset_id", "ext")


@query("f03_status_class", f"""select event_id, case when {_SUCCESS} then 'success' when {_FAIL} then 'failure'
    when status in ('stopped','deleted','pending','processing') then status else 'other' end status_class,
    {_SUCCESS} or {_FAIL} or status in ('stopped','deleted') terminal from jobs""")
def _(t):
    return jobs.status_class(t.jobs).select("event_id", "status_class", "terminal")


@query("f04_errors_only", f"select event_id, status from jobs where {_FAIL} or not ({_SUCCESS} and coalesce(exit_code = 0, false))")
def _(t):
    return jobs.errors_only(t.jobs).select("event_id", "status")


@query("f05_level_threshold", "select event_id, k % 5 lvl from jobs where k % 5 <= 2")
def _(t):
    level = F.element_at(F.array(*[F.lit(x) for x in jobs.LEVELS]), (col("k") % 5 + 1).cast("int"))
    return jobs.level_threshold(t.jobs.withColumn("level", level), "info").select("event_id", (col("k") % 5).alias("lvl"))


@query("f06_classify_log_line", """select event_id, case when exit_code > 0 then 'error' when event_id % 4 = 1 then 'error' when event_id % 4 = 2 then 'warn' else 'debug' end as level
    from jobs where event_id % 4 <> 3""")
def _(t):
    line = F.expr("case event_id % 4 when 0 then concat('frame ', k) when 1 then '❌ broken' when 2 then '⚠ odd' else '   ' end")
    lines = t.jobs.select("event_id", line.alias("line"), F.coalesce(col("exit_code") > 0, F.lit(False)).alias("failed"))
    return jobs.classify_log_line(lines).select("event_id", "level")


# --- inputs and names ----------------------------------------------------------
@query("j02_align_frames", """with a as (select item_id, event_id, row_number() over (partition by item_id order by ts, event_id) ordinal from jobs where status = 'processing'),
    b as (select item_id, event_id, row_number() over (partition by item_id order by ts, event_id) ordinal from jobs where starts_with(status, 'processing '))
    select item_id, ordinal, a.event_id a_event_id, b.event_id b_event_id from a join b using (item_id, ordinal)""")
def _(t):
    a = t.jobs.where("status = 'processing'").select("item_id", "ts", "event_id")
    b = t.jobs.where("startswith(status, 'processing ')").select("item_id", "ts", "event_id")
    return jobs.align_frames_by_ordinal(a, b, ["item_id"], ["ts", "event_id"], ordered.time_bucket("ts")).select(
        "item_id", "ordinal", "a_event_id", "b_event_id")


@query("j04_pair_sequential", """select (rn - 1) // 2 pair_id, max(case when rn % 2 = 1 then path end) sdr, max(case when rn % 2 = 0 then path end) hdr from (
    select path, row_number() over (order by asset_id) rn from paths) group by 1""")
def _(t):
    return jobs.pair_sequential(t.paths, "asset_id", "path")


@query("j10_apply_preset", """select ord, o.k, coalesce(p.v, o.v) v from (select *, concat('preset', owner % 3) preset from options) o
    left join (select concat('preset', n_nationkey % 3) preset, concat('key', n_nationkey % 4) k, max(n_name) v from nation where n_nationkey % 2 = 0 group by 1, 2) p using (preset, k)""")
def _(t):
    options = t.options.withColumn("preset", F.concat(F.lit("preset"), col("owner") % 3))
    presets = t.nation.selectExpr(
        "concat('preset', n_nationkey % 3) preset", "concat('key', n_nationkey % 4) k",
        "case when n_nationkey % 2 = 0 then n_name end v").groupBy("preset", "k").agg(F.max("v").alias("v"))
    return jobs.apply_preset(options, presets).select("ord", "k", "v")


@query("j11_layer_settings", """select owner, k, v, priority from (select *, row_number() over (partition by owner, k order by priority, ord) rn from options where v is not null) where rn = 1""")
def _(t):
    return jobs.layer_settings(t.options, ["owner", "k"], "ord")


@query("j14_target_conflicts", "select asset_id, path, path in (select path from paths where asset_id % 3 = 0) refused from paths")
def _(t):
    existing = t.paths.selectExpr("case when asset_id % 3 = 0 then path else concat(path, '.bak') end path")
    return jobs.target_conflicts(t.paths.select("asset_id", "path"), existing)


@query("j17_incremental_probe", """select asset_id, path from probe_inputs p where not exists (select 1 from cache c where c.path = p.path and c.mtime = p.mtime
    and c.probed_at >= timestamp '2023-12-20 00:00:00')""")
def _(t):
    now = F.lit("2023-12-21 00:00:00").cast("timestamp")
    cache = t.cache.withColumn("probed_at", col("probed_at").cast("timestamp"))
    return jobs.incremental_probe(t.probe_inputs, cache, now).select("asset_id", "path")


@query("a25_probe_cache_stats", "select count(*) entries, cast(floor(sum(length(path) + coalesce(length(json), 0)) / 1024) as bigint) kib from cache")
def _(t):
    return jobs.probe_cache_stats(t.cache)


@query("w01_assign_output_names", """select asset_id, out_stem, renamed from (select asset_id, case when rn > 1 then concat(stem, '_', rn - 1) else stem end out_stem, rn > 1 renamed from (
    select *, row_number() over (partition by stem, ext order by asset_id) rn from paths))""")
def _(t):
    plans = t.paths.withColumn("folder", F.lit("/out"))
    return jobs.assign_output_names(plans, order="asset_id", width=64).select("asset_id", "out_stem", "renamed")


# --- queue state ---------------------------------------------------------------
@query("w02_completion_counter", "select item_id, event_id, row_number() over (order by ts, event_id) done, count(*) over () total from first_ends")
def _(t):
    return jobs.completion_counter(t.jobs).select("item_id", "event_id", "done", "total")


@query("w03_latest_state", "select item_id, ts, event_id, status, exit_code from latest")
def _(t):
    return jobs.latest_state(t.jobs).withColumn("ts", _ts())


@query("w04_first_terminal", "select item_id, ts, event_id, status, exit_code from first_ends")
def _(t):
    return jobs.first_terminal(t.jobs).withColumn("ts", _ts())


def _gap(sql_from, part, least):
    return f"""select * from (select event_id, ts, lead(ts) over ({part} order by ts, event_id) next_ts,
    (epoch_us(lead(ts) over ({part} order by ts, event_id)) - epoch_us(ts)) / 1e6 gap_sec from {sql_from}) where gap_sec >= {least}"""


@query("w05_stall_gaps", _gap("terminal", "", 1800))
def _(t):
    return jobs.stall_gaps(t.jobs).select("event_id", _ts(), _ts("next_ts"), "gap_sec")


@query("w06_silence_gaps", _gap("jobs", "partition by item_id", 3600))
def _(t):
    return jobs.silence_gaps(t.jobs.select("item_id", "event_id", "ts"), 4000).select("event_id", _ts(), _ts("next_ts"), "gap_sec")


@query("w10_item_duration", f"""select item_id, case when s is not null and e is not null then greatest((e - s) / 1e6, 0e0) end duration_sec from (
    select item_id, min(case when status = 'processing' then epoch_us(ts) end) s, max(case when {_SUCCESS} or {_FAIL} or status in ('stopped','deleted') then epoch_us(ts) end) e
    from jobs group by item_id)""")
def _(t):
    return jobs.item_duration(t.jobs)


@query("a14_queue_snapshot", f"""select count(*) total, count(case when {_SUCCESS} and exit_code = 0 then 1 end) completed,
    count(case when {_FAIL} then 1 end) failed, max_by(item_id, ts) filter (where status = 'processing') as "current" from latest where status <> 'deleted'""")
def _(t):
    return jobs.queue_snapshot(jobs.latest_state(t.jobs))


@query("a15_queue_summary", f"""select *, case when failed + degraded > 0 then 1 else 0 end process_exit from (select count(*) completed,
    count(case when {_FAIL} then 1 end) failed, count(case when status = 'completed (degraded)' then 1 end) degraded from first_ends)""")
def _(t):
    return jobs.queue_summary(jobs.first_terminal(t.jobs))


# --- axes ----------------------------------------------------------------------
_AX = ["brand", "type", "size"]
_PAIRS = " union all ".join(
    f"select '{a}' axis_a, x.{a} val_a, '{b}' axis_b, y.{b} val_b from (select distinct {a} from cases_wide) x, (select distinct {b} from cases_wide) y"
    for a, b in (("brand", "type"), ("brand", "size"), ("type", "size")))
_SEEN = " union ".join(
    f"select '{a}' axis_a, {a} val_a, '{b}' axis_b, {b} val_b from cases_wide" for a, b in (("brand", "type"), ("brand", "size"), ("type", "size")))


@query("a26_axis_summary", "select axis, count(distinct val) n_values, count(*) n_rows from cases group by axis")
def _(t):
    return axes.axis_summary(t.cases)


@query("a27_fold_distinct", """select count(*) cases, count(distinct (brand, type, size)) raw_distinct,
    count(distinct (case when brand in ('Brand#1','Brand#2') then 'Brand#1' else brand end, case when type = 'ECONOMY' then 'STANDARD' else type end, size)) folded_distinct from cases_wide""")
def _(t):
    folds = {"brand": {"Brand#2": "Brand#1"}, "type": {"ECONOMY": "STANDARD"}}
    return axes.fold_distinct(t.cases_wide, _AX, folds)


@query("u01_extension_union", "select distinct ext from paths")
def _(t):
    present = t.paths.select("ext").distinct()
    used = [extension_dim(t.spark, d).join(present, "ext", "left_semi") for d in (IMAGE_EXTENSIONS, VIDEO_EXTENSIONS)]
    return axes.extension_union(*used)


@query("u02_uncovered_pairs", f"select * from ({_PAIRS}) except ({_SEEN})")
def _(t):
    return axes.uncovered_pairs(t.cases, t.cases_wide, _AX)


_DEF = "(select min(brand) b0, min(type) t0, min(size) s0 from cases_wide)"


@query("u03_single_axis_cases", f"""select 'brand' swept, brand, t0 as type, s0 size from (select distinct brand from cases_wide), {_DEF}
    union all select 'type', b0, type, s0 from (select distinct type from cases_wide), {_DEF} union all select 'size', b0, t0, size from (select distinct size from cases_wide), {_DEF}""")
def _(t):
    return axes.single_axis_cases(t.cases, _AX)


@query("u04_cartesian_cases", "select * from (select distinct brand from cases_wide), (select distinct type from cases_wide), (select distinct size from cases_wide)")
def _(t):
    return axes.cartesian_cases(t.cases, _AX)


