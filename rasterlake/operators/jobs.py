"""Batch jobs: input lists, target names, queue state and telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.functions import text
from rasterlake.functions.media import is_decode_only
from rasterlake.model import IMAGE_EXTENSIONS, VIDEO_EXTENSIONS, extension_dim
from rasterlake.operators import ordered
from rasterlake.operators.skew import attach
from rasterlake.plans.decisions import default_backend, plan_color
from rasterlake.session import enable_checkpoints

# --- fixed values: severity order ---------------------------------------------
LEVELS = {"error": 0, "warn": 1, "info": 2, "debug": 3, "trace": 4}
STALL_WINDOW_SECONDS = 600
STALL_WINDOWS = 3
HEARTBEAT_SECONDS = 120


# --- filters -------------------------------------------------------------------
def filter_enabled_formats(assets: DataFrame, enabled, ext: str = "ext") -> DataFrame:
    """Keep assets whose extension belongs to an enabled format name."""
    table = extension_dim(assets.sparkSession, IMAGE_EXTENSIONS | VIDEO_EXTENSIONS)
    allowed = table.where(F.col("format_name").isin(*enabled)).select(F.col("ext").alias("__ext"))
    return assets.join(F.broadcast(allowed), F.lower(F.col(ext)) == F.col("__ext"), "left_semi")


def reject_decode_only(targets: DataFrame, fmt: str = "ext") -> DataFrame:
    return targets.where(~is_decode_only(F.col(fmt)))


def is_success(status: Column) -> Column:
    return F.coalesce(F.startswith(status, F.lit("completed")), F.lit(False))


def is_failure(status: Column) -> Column:
    return F.coalesce(F.startswith(status, F.lit("failed")), F.lit(False))


def is_degraded(status: Column) -> Column:
    return ~is_failure(status) & F.coalesce(status.contains("degraded"), F.lit(False))


def is_terminal(status: Column) -> Column:
    return is_success(status) | is_failure(status) | F.coalesce(status.isin("stopped", "deleted"), F.lit(False))


def status_class(jobs: DataFrame) -> DataFrame:
    """Success and failure match by prefix, the other states exactly."""
    s = F.col("status")
    label = (
        F.when(is_success(s), "success")
        .when(is_failure(s), "failure")
        .when(s.isin("stopped", "deleted", "pending", "processing"), s)
        .otherwise("other")
    )
    return jobs.withColumn("status_class", label).withColumn("terminal", is_terminal(s))


def errors_only(jobs: DataFrame) -> DataFrame:
    """Failed rows and rows not yet completed; a completed row needs exit code 0."""
    done = is_success(F.col("status")) & F.coalesce(F.col("exit_code") == 0, F.lit(False))
    return jobs.where(is_failure(F.col("status")) | ~done)


def level_threshold(events: DataFrame, level: str, col: str = "level") -> DataFrame:
    """Keep events at least as severe as the level."""
    kept = [name for name, rank in LEVELS.items() if rank <= LEVELS[level]]
    return events.where(F.col(col).isin(*kept))


def line_level(line: Column, item_failed: Column) -> Column:
    return (
        F.when(item_failed, "error")
        .when(line.contains("❌"), "error")
        .when(line.contains("⚠"), "warn")
        .otherwise("debug")
    )


def classify_log_line(lines: DataFrame, line: str = "line", failed: str = "failed") -> DataFrame:
    kept = lines.where(F.trim(F.col(line)) != "")
    return kept.withColumn("level", line_level(F.col(line), F.col(failed)))


def compose_admissible(pairs: DataFrame) -> DataFrame:
    """SDR/HDR pair admission with the first failing reason."""
    sdr = F.lower(F.trim(F.coalesce("sdr_transfer", F.lit(""))))
    hdr = F.lower(F.trim(F.coalesce("hdr_transfer", F.lit(""))))
    hdr_set = ("smpte2084", "arib-std-b67")
    reason = (
        F.when(F.least("sdr_w", "sdr_h", "hdr_w", "hdr_h") <= 0, "size_unknown")
        .when((F.col("sdr_w") != F.col("hdr_w")) | (F.col("sdr_h") != F.col("hdr_h")), "size_differs")
        .when(sdr.isin(*hdr_set), "sdr_slot_is_hdr")
        .when(~sdr.isin("iec61966-2-1", "bt709", "srgb", "unknown", ""), "sdr_transfer")
        .when(~hdr.isin(*hdr_set), "hdr_transfer")
    )
    return pairs.withColumn("reject_reason", reason).withColumn("ok", reason.isNull())


# --- inputs and target names ---------------------------------------------------
def _numbered(rows: DataFrame, order: list[Column], bucket: Column | None, out: str) -> DataFrame:
    """Places in the whole order, over range partitions unless there is a bucket."""
    return ordered.range_ranks(rows, order, out) if bucket is None else ordered.row_numbers(rows, [], order, bucket, out)


def pair_sequential(inputs: DataFrame, order: str, value: str, width: int | None = None) -> DataFrame:
    """Inputs 2i and 2i+1 become (sdr, hdr); a trailing odd input gets no partner.

    Inputs are numbered over range partitions, or, where the order is known to be dense, over blocks of that width.
    """
    ranked = _numbered(inputs, [F.col(order)], ordered.block(order, width) if width else None, "rn")
    pair = F.floor((F.col("rn") - 1) / 2).alias("pair_id")
    slot = F.struct("rn", F.col(value).alias("v"))
    return ranked.select(pair, slot.alias("s")).groupBy("pair_id").agg(
        F.min("s")["v"].alias("sdr"),
        F.when(F.count(F.lit(1)) == 2, F.max("s")["v"]).alias("hdr"),
    )


def align_frames_by_ordinal(a: DataFrame, b: DataFrame, keys: list[str], order: list[str], bucket: Column) -> DataFrame:
    """Pair the n-th frame of one track with the n-th of another.

    Both tracks are ranked in one pass and meet in one aggregation on the
    ordinal, so no join is needed and a busy key spreads over its ordinals.
    """
    rest = [c for c in a.columns if c not in keys]
    both = a.withColumn("__track", F.lit(0)).unionByName(b.withColumn("__track", F.lit(1)))
    ranked = ordered.row_numbers(both, [*keys, "__track"], [F.col(c) for c in order], bucket, "ordinal")
    row = F.struct(*rest)
    met = ranked.groupBy(*keys, "ordinal").agg(
        F.max(F.when(F.col("__track") == 0, row)).alias("__a"), F.max(F.when(F.col("__track") == 1, row)).alias("__b"))
    return met.where(F.col("__a").isNotNull() & F.col("__b").isNotNull()).select(
        *keys, "ordinal", *[F.col(f"__a.{c}").alias(f"a_{c}") for c in rest], *[F.col(f"__b.{c}").alias(f"b_{c}") for c in rest])


_SUFFIXED = r"^(.*)_([1-9][0-9]*)$"


def assign_output_names(plans: DataFrame, folder: str = "folder", stem: str = "stem", ext: str = "ext",
                        order: str = "ord", width: int = 1_000_000) -> DataFrame:
    """Distinct target names in input order.

    The first input to ask for a name keeps it; each later one tries _1, _2, ...
    and takes the first name not taken by then. Names compare without case.

    A suffixed name p_n can be taken beforehand only by an input that asked for
    p_n itself, and it matters only whether that happened before the duplicate
    of p came to it. Where no input is named like a suffixed one, a bucketed
    rank is the answer; otherwise `_settle_names` works out who came first.
    """
    name = F.lower(F.concat_ws("\u0001", folder, stem, ext))
    base = plans.withColumn("__name", name)
    firsts = base.groupBy("__name").agg(F.min(order).alias("__first"),
                                        F.lower(F.first(folder)).alias("__f"), F.lower(F.first(stem)).alias("__s"),
                                        F.lower(F.first(ext)).alias("__e"))
    child = (
        firsts.withColumn("__n", F.regexp_extract("__s", _SUFFIXED, 2).try_cast("long"))
        .where(F.col("__n").isNotNull())
        .select(
            F.col("__name").alias("child"), "__first", F.col("__n").alias("n"),
            F.concat_ws("\u0001", "__f", F.regexp_extract("__s", _SUFFIXED, 1), "__e").alias("__name"))
    )
    # A suffixed name matters only if its parent was asked for as well.
    links = attach(child, firsts.select("__name"), ["__name"], ["n"])
    ranked = ordered.row_numbers(base, ["__name"], [F.col(order)], ordered.block(order, width), "__rank")
    if links.isEmpty():
        settled = ranked.withColumn("__suffix", F.col("__rank") - 1)
    else:
        settled = _settle_names(ranked, links, order, width)
    out_stem = F.when(F.col("__suffix") > 0, F.concat(F.col(stem), F.lit("_"), F.col("__suffix").cast("string"))).otherwise(F.col(stem))
    return settled.withColumn("out_stem", out_stem).withColumn("renamed", F.col("__suffix") > 0).drop(
        "__name", "__rank", "__suffix")


def _settle_names(ranked: DataFrame, links: DataFrame, order: str, width: int) -> DataFrame:
    """Suffix numbers where some requested names look like suffixed ones.

    links: one row per existing p_n with its parent p. Duplicate i of p would
    take number i plus the existing numbers skipped before it. An existing p_n
    is skipped if it was asked for before the duplicate that arrives at it; if
    not, that duplicate takes the name, and p_n's own first request becomes a
    duplicate in turn. Which numbers are skipped is found by repeating one
    distributed pass until nothing changes: each pass settles at least the next
    number of every parent whose own first request is settled.
    """
    enable_checkpoints(ranked.sparkSession)
    by_name = ["__name"]
    # How many requests for p came before the first one for p_n.
    asked = attach(ranked, links.select("__name").distinct(), by_name, [order]).select(
        "__name", F.col(order).alias("at"), F.lit(1).alias("ask"))
    marks = links.select("__name", F.col("__first").alias("at"), F.lit(0).alias("ask"), "child", "n")
    line = ordered.running_sum(
        marks.unionByName(asked, allowMissingColumns=True), by_name, [F.col("at")], ordered.block("at", width),
        F.col("ask"), "before")
    marks = line.where(F.col("child").isNotNull()).select(
        "__name", "child", "n", "before", F.lit(True).alias("skip")).checkpoint()
    while True:
        taken = marks.where(~F.col("skip")).select(F.col("child").alias("__name"), F.lit(1).alias("d"))
        state = attach(marks.withColumnRenamed("skip", "was"), taken, by_name, ["n"], "left")
        state = ordered.running_sum(
            state, by_name, [F.col("n")], ordered.block("n", width), F.col("was").cast("int"), "upto")
        arrives = F.col("n") - (F.col("upto") - F.col("was").cast("int"))
        earlier = F.greatest(F.col("before") - 1 + F.coalesce("d", F.lit(0)), F.lit(0))
        state = state.select(
            "__name", "child", "n", "before", "was", arrives.alias("arrives"), (arrives > earlier).alias("skip")).checkpoint()
        marks = state.drop("was")
        if state.where(F.col("skip") != F.col("was")).isEmpty():
            break
    taken = marks.where(~F.col("skip")).select(F.col("child").alias("__name"), F.lit(1).alias("d"))
    rows = attach(ranked, taken, by_name, [order], "left").withColumn(
        "__pos", F.col("__rank") - 1 + F.coalesce("d", F.lit(0))).drop("d")
    # Skipped numbers up to each duplicate's position, rows after marks.
    skips = marks.where("skip").select("__name", F.col("arrives").alias("__pos"), F.lit(1).alias("__skip"))
    mixed = rows.withColumn("__skip", F.lit(0)).unionByName(skips, allowMissingColumns=True)
    counted = ordered.running_sum(
        mixed, by_name, [F.col("__pos"), F.col("__skip").desc()], ordered.block("__pos", width), F.col("__skip"), "__passed")
    return counted.where(F.col("__skip") == 0).withColumn(
        "__suffix", F.when(F.col("__pos") > 0, F.col("__pos") + F.col("__passed")).otherwise(F.lit(0))).drop(
        "__pos", "__skip", "__passed")


def target_conflicts(plans: DataFrame, existing: DataFrame, key: str = "path") -> DataFrame:
    """Each plan with whether its target exists already."""
    there = existing.select(F.col(key)).distinct().withColumn("refused", F.lit(True))
    return attach(plans, there, [key], plans.columns, "left").fillna(False, ["refused"])


def incremental_probe(assets: DataFrame, cache: DataFrame, now: Column, max_age_hours: int = 24) -> DataFrame:
    """Assets whose (path, mtime) has no cache entry younger than the limit."""
    fresh = cache.where(F.col("probed_at") >= now - F.expr(f"interval {max_age_hours} hours"))
    return assets.join(fresh.select("path", "mtime").distinct(), ["path", "mtime"], "left_anti")


def probe_cache_stats(cache: DataFrame) -> DataFrame:
    size = F.length("path") + F.coalesce(F.length("json"), F.lit(0))
    return cache.agg(F.count(F.lit(1)).alias("entries"), F.floor(F.sum(size) / 1024).alias("kib"))


# --- settings ------------------------------------------------------------------
def apply_preset(options: DataFrame, presets: DataFrame) -> DataFrame:
    """Preset values override the base only where they are set.

    options: owner, preset, k, v. presets: preset, k, v, one row per pair.
    """
    over = presets.select("preset", "k", F.col("v").alias("__pv"))
    # Many owners share a preset, so its rows are spread before they meet it.
    joined = attach(options, over, ["preset", "k"], options.columns, "left")
    return joined.withColumn("v", F.coalesce("__pv", "v")).drop("__pv")


def layer_settings(layers: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """Effective value per key: the set value of the strongest layer (1 wins)."""
    strongest = F.min(F.struct("priority", tie, "v"))
    return layers.where(F.col("v").isNotNull()).groupBy(*keys).agg(strongest.alias("s")).select(
        *keys, F.col("s.v").alias("v"), F.col("s.priority").alias("priority"))


# --- queue state ---------------------------------------------------------------
def latest_state(events: DataFrame) -> DataFrame:
    last = F.max(F.struct("ts", "event_id", "status", "exit_code"))
    return events.groupBy("item_id").agg(last.alias("s")).select("item_id", "s.*")


def first_terminal(events: DataFrame) -> DataFrame:
    first = F.min(F.struct("ts", "event_id", "status", "exit_code"))
    return events.where(is_terminal(F.col("status"))).groupBy("item_id").agg(first.alias("s")).select("item_id", "s.*")


def queue_snapshot(states: DataFrame) -> DataFrame:
    """Totals over the latest state of each item, and the item now processing."""
    s = F.col("status")
    live = states.where(s != "deleted")
    done = is_success(s) & (F.col("exit_code") == 0)
    return live.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(done).alias("completed"),
        F.count_if(~done & is_failure(s)).alias("failed"),
        F.max_by(F.when(s == "processing", F.col("item_id")),
                 F.when(s == "processing", F.struct("ts", "item_id"))).alias("current"),
    )


def queue_summary(terminal: DataFrame) -> DataFrame:
    """Counts over terminal items; degraded items make the exit code non-zero."""
    s = F.col("status")
    counts = terminal.agg(
        F.count(F.lit(1)).alias("completed"),
        F.count_if(is_failure(s)).alias("failed"),
        F.count_if(is_degraded(s)).alias("degraded"),
    )
    return counts.withColumn(
        "process_exit", F.when(F.col("failed") + F.col("degraded") > 0, 1).otherwise(0))


def completion_counter(events: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Running done count in completion order, and the total.

    Items are numbered over range partitions, so a busy hour spreads like any other; a bucket of ts takes their place.
    """
    numbered = _numbered(first_terminal(events), [F.col("ts"), F.col("event_id")], bucket, "done")
    return numbered.withColumn("total", numbered.agg(F.count(F.lit(1))).scalar())


def stall_gaps(events: DataFrame, window: int = STALL_WINDOW_SECONDS, windows: int = STALL_WINDOWS) -> DataFrame:
    """Gaps between terminal events that span at least three whole windows: ts, event_id, next_ts, gap_sec."""
    return _gaps(events.where(is_terminal(F.col("status"))), [], window * windows)


def silence_gaps(progress: DataFrame, seconds: int = HEARTBEAT_SECONDS) -> DataFrame:
    """Stretches in which an item reported nothing for the heartbeat timeout, which is held to 1 to 3600 seconds."""
    return _gaps(progress, ["item_id"], min(max(seconds, 1), 3600))


def _gaps(events: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Neighbours at least so many seconds apart.

    They lie in different buckets of that width, so the first and last event
    of each bucket are enough: one aggregate combined before the shuffle, and
    an order over buckets, of which there are at most the time span by `least`.
    """
    bucket = F.floor(F.unix_micros("ts") / (least * 1_000_000)).alias("__b")
    edges = events.groupBy(*keys, bucket).agg(F.min("ts").alias("__first"), F.max(F.struct("ts", "event_id")).alias("__last"))
    after = F.lead("__first").over(Window.partitionBy(*keys).orderBy("__b"))
    gap = (F.unix_micros("next_ts") - F.unix_micros("ts")) / 1e6
    return (
        edges.select(*keys, F.col("__last.ts").alias("ts"), F.col("__last.event_id").alias("event_id"), after.alias("next_ts"))
        .withColumn("gap_sec", gap).where(F.col("gap_sec") >= least)
    )


def item_duration(events: DataFrame) -> DataFrame:
    """Seconds from first processing to last terminal event, never negative."""
    s = F.col("status")
    span = events.groupBy("item_id").agg(
        F.min(F.when(s == "processing", F.unix_micros("ts"))).alias("started"),
        F.max(F.when(is_terminal(s), F.unix_micros("ts"))).alias("ended"),
    )
    return span.select(
        "item_id", F.when(
            F.col("started").isNotNull() & F.col("ended").isNotNull(),
            F.greatest((F.col("ended") - F.col("started")) / 1e6, F.lit(0.0))).alias("duration_sec"))


def build_jobs(inputs: DataFrame, existing: DataFrame, fmt: str, out_dir: str, enabled, overwrite: bool,
               tools: DataFrame | None = None, compose: bool = False, order: str = "ord", width: int = 1_000_000) -> DataFrame:
    """The whole batch table: enabled inputs, target paths, unique names, the
    overwrite guard, the encoder backend and, where the inputs carry primaries,
    transfer and target, the colour plan.

    With compose, consecutive inputs are an SDR base and its HDR reference, the
    target is named after the base, and a trailing single input fails.
    """
    rows = filter_enabled_formats(inputs, enabled)
    if compose:
        pairs = _numbered(rows, [F.col(order)], None, "rn")
        row = F.struct("rn", *rows.columns)
        pairs = pairs.groupBy(F.floor((F.col("rn") - 1) / 2).alias("__pair")).agg(
            F.min(row).alias("sdr"), F.max(row).alias("hdr"), F.count(F.lit(1)).alias("n"))
        rows = pairs.select(
            *[F.col(f"sdr.{c}").alias(c) for c in rows.columns],
            F.when(F.col("n") == 2, F.col("hdr.path")).alias("reference"))
    target = text.output_path(F.col("path"), F.lit(None).cast("string"), out_dir, fmt, preserve=False)
    stem = F.concat(text.stem(target), F.lit("_gainmap")) if compose else text.stem(target)
    rows = rows.withColumns({"folder": text.directory(target), "stem": stem, "out_ext": F.lit(fmt.lower())})
    named = assign_output_names(rows, "folder", "stem", "out_ext", order, width)
    planned = named.withColumn("output", F.concat(
        F.col("folder"), F.lit("/"), F.col("out_stem"), F.lit("."), F.col("out_ext")))
    jobs = target_conflicts(planned, existing, "output")
    if tools is not None:
        jobs = default_backend(jobs, tools, "out_ext")
    if {"primaries", "transfer", "target"} <= set(inputs.columns):
        jobs = plan_color(jobs.withColumn("format", F.col("out_ext")))
    status = F.when(F.col("refused") & F.lit(not overwrite), "failed: exists")
    if compose:
        status = status.when(F.col("reference").isNull(), "failed: no partner")
    return jobs.withColumn("status", status.otherwise("pending"))
