"""Readers: file inventories, probe JSON, tag dumps, logs, ledgers, benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlake.functions import media, text
from rasterlake.model import BENCH_SCHEMA, JOB_LOG_SCHEMA, LEDGER_SCHEMA, MATRIX_SCHEMA

PROGRESS_LINE = "^[a-z0-9_]+="


def scan_assets(spark: SparkSession, roots, extensions, exclude_prefix: str | None = None, files=()) -> DataFrame:
    """File inventory without reading contents.

    Column pruning keeps `content` out of the scan, so only the listing runs.
    A directory scan keeps known extensions and skips the output subtree; files
    named one by one are always accepted.
    """

    def listing(paths):
        return (
            spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
            .select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size")))

    found = select_assets(listing(roots if isinstance(roots, list) else [roots]), extensions, exclude_prefix) if roots else None
    if not files:
        return found
    named = listing(list(files)).withColumn("ext", _extension("path"))
    return named if found is None else found.union(named).dropDuplicates(["path"])


def _extension(path: str):
    return F.lower(F.regexp_extract(path, "[.]([^./]+)$", 1))


def select_assets(files: DataFrame, extensions, exclude_prefix: str | None = None) -> DataFrame:
    kept = files.withColumn("ext", _extension("path")).where(F.col("ext").isin(*extensions))
    if exclude_prefix:
        kept = kept.where(~text.under_prefix(F.col("path"), F.lit(exclude_prefix)))
    return kept


def sniff_formats(spark: SparkSession, roots) -> DataFrame:
    """Format by content against format by extension."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    ext = _extension("path")
    named = F.when(ext == "jpeg", "jpg").when(ext == "tif", "tiff").when(ext == "heic", "heif").otherwise(ext)
    magic = media.magic_format(F.col("content"))
    return files.select("path", magic.alias("magic"), named.alias("named")).withColumn(
        "mismatch", F.col("magic").isNotNull() & (F.col("magic") != F.col("named")))


def read_probe_json(df: DataFrame, json_col: str) -> DataFrame:
    """Probe text to the media record of the first video stream."""
    probe = media.parse_probe(F.col(json_col))
    parsed = df.withColumn("__p", probe)
    stream = media.first_video(F.col("__p"))
    return parsed.withColumn("__s", stream).select(
        *[c for c in df.columns if c != json_col],
        F.col("__p.format.format_name").alias("format"),
        F.col("__s.width").alias("width"), F.col("__s.height").alias("height"),
        F.col("__s.pix_fmt").alias("pix_fmt"), F.col("__s.nb_frames").alias("nb_frames"),
        F.col("__s.color_primaries").alias("primaries"), F.col("__s.color_transfer").alias("transfer"),
        F.col("__s.color_space").alias("matrix"), F.col("__s.color_range").alias("range"),
    )


def pick_stream(df: DataFrame, json_col: str) -> DataFrame:
    """Index of the video stream with most frames, the lowest index on ties."""
    parsed = df.withColumn("__p", media.parse_probe(F.col(json_col)))
    streams = F.col("__p.streams")
    video = F.filter(F.transform(streams, lambda s, i: F.struct(
        s["nb_frames"].alias("n"), (-F.coalesce(s["index"], i)).alias("neg"), s["codec_type"].alias("t"))),
        lambda s: (s["t"] == "video") & s["n"].isNotNull())
    best = F.array_max(F.transform(video, lambda s: F.struct(s["n"].alias("n"), s["neg"].alias("neg"))))
    return parsed.withColumn("__best", best).withColumn("stream_index", -F.col("__best.neg")).drop("__p", "__best")


def tag_dump_rows(docs: DataFrame, json_col: str) -> DataFrame:
    """Dump text, an array of objects with dynamic keys, to a long tag table."""
    maps = F.from_json(F.col(json_col), "array<map<string,string>>")
    return _tag_rows(docs.select(F.explode(maps).alias("m")))


def _tag_rows(rows: DataFrame) -> DataFrame:
    return (
        rows.select(F.col("m")["SourceFile"].alias("file"), F.explode("m").alias("name", "value"))
        .where(F.col("name") != "SourceFile")
        .select(
            "file",
            F.when(F.col("name").contains(":"), F.substring_index("name", ":", 1)).alias("grp"),
            F.regexp_replace("name", "^[^:]*:", "").alias("tag"), "value")
    )


#: What lies between two records of a dump with a record's end and the next one's start on lines of their own.
RECORD_BORDERS = ("},\n{", "},\r\n{")


def read_tag_dump(spark: SparkSession, path: str, border: str = RECORD_BORDERS[0]) -> DataFrame:
    """A long tag table of dumps: arrays of one object a file.

    The text between two records separates rows for the scan, which finds it in byte
    ranges, so one huge dump is many tasks. No string of a JSON text holds a
    line break, so the border is never inside of a value. It must not stand between nested objects either: of an indented dump,
    pass the border with the indentation of its records. A dump written without line breaks, or with other ones, is one row.
    """
    pieces = spark.read.option("lineSep", border).text(path)
    # The first record of a file has the array's opening before it, the last one its end behind it; the rest lost both braces.
    opened = F.regexp_replace("value", r"^\s*\[?\s*\{", "")
    record = F.from_json(F.concat(F.lit("{"), opened, F.lit("}")), "map<string,string>")
    whole = F.from_json("value", "array<map<string,string>>")
    several = F.when(F.col("value").rlike(r"^\s*\[") & F.col("value").rlike(r"\]\s*$"), whole).otherwise(F.array(record))
    return _tag_rows(pieces.where(F.col("value").rlike(r"\S")).select(F.explode(several).alias("m")))


def read_job_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JOB_LOG_SCHEMA).json(path)


def stream_job_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(JOB_LOG_SCHEMA).json(path)


def parse_log_lines(lines: DataFrame, col: str) -> DataFrame:
    """JSON-lines log text already in a column."""
    return lines.withColumn("__e", F.from_json(col, JOB_LOG_SCHEMA)).select(
        *[c for c in lines.columns if c != col], "__e.*")


def progress_pairs(lines: DataFrame, col: str = "line") -> DataFrame:
    """key=value lines; everything else is ordinary output and is dropped."""
    return lines.where(F.col(col).rlike(PROGRESS_LINE)).select(
        *[c for c in lines.columns if c != col],
        F.substring_index(col, "=", 1).alias("key"),
        F.trim(F.regexp_replace(col, "^[^=]*=", "")).alias("val"))


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    return progress_pairs(spark.read.text(path), "value")


def read_ledger_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').schema(LEDGER_SCHEMA).csv(path)


def read_matrix_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(MATRIX_SCHEMA).csv(path)


def read_bench_rows(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """Benchmark rows from JSON arrays ("json"), JSON lines ("jsonl") or tab-separated summaries ("tsv").

    A JSON array is one document to Spark; JSON lines or TSV split freely and
    are the forms to use at scale. Columns that an older summary lacks are null.
    """
    if form not in ("json", "jsonl", "tsv"):
        raise ValueError(f"form {form!r}: json, jsonl or tsv")
    if form == "tsv":
        rows = spark.read.option("header", True).option("sep", "\t").option("enforceSchema", False).csv(path)

        def cell(f):
            if f.name not in rows.columns:
                return F.lit(None).cast(f.dataType).alias(f.name)
            value = F.when(F.col(f.name) != "null", F.col(f.name))
            return (F.from_json(value, f.dataType) if isinstance(f.dataType, T.ArrayType) else value.cast(f.dataType)).alias(f.name)

        return rows.select(*map(cell, BENCH_SCHEMA.fields))
    return spark.read.option("multiLine", form == "json").schema(BENCH_SCHEMA).json(path)


def bench_cells(rows: DataFrame) -> DataFrame:
    """Benchmark rows as the summaries take them: what a run lost, and whether both decoders read its result."""
    return rows.select(
        "case_id", "arm_id", "output_bytes", F.col("baseline_l9_bytes").alias("baseline_bytes"), "pixel_equal", "status", "time_ms",
        (F.size(F.coalesce("chunk_loss", F.array().cast("array<string>"))) > 0).alias("chunk_loss"),
        (F.coalesce("decode_ffmpeg", F.lit(True)) & F.coalesce("decode_pillow", F.lit(True))).alias("decode_ok"))
