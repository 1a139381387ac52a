"""Token ids in Parquet: ascending documents, controlled row groups, pages and encodings.

`write_tokens` sorts documents by id over range partitions, encodes each text
and writes one row per document: its ids as a list column beside narrow
metadata columns, so that a reader fetches ids, metadata or a range of
documents without the rest (column pruning, row-group statistics, page
indexes). A row also holds its part and its first token's place in that part;
`read_starts` adds the places of all earlier parts.

Cases: a null text is an empty one; an empty text has the end id alone; a null
doc_id comes first; repeated ids and rows are kept, ordered by text; an empty
table writes an empty file set; only the named metadata columns are written,
and any that the table lacks are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlake.llm.textkit import slices
from rasterlake.llm.tokens import encoder

METADATA = ("lang", "source")


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, metadata: tuple[str, ...] = METADATA) -> DataFrame:
    """doc_id, part, part_start, n_tokens, tokens and metadata, sorted by doc_id within range partitions."""
    metadata = tuple(c for c in metadata if c in docs.columns)
    ordered = (
        docs.select("doc_id", "text", *metadata)
        .repartitionByRange(F.col("doc_id"))
        .sortWithinPartitions("doc_id", "text")
    )
    schema = T.StructType([
        docs.schema["doc_id"], *(docs.schema[c] for c in metadata),
        T.StructField("part", T.IntegerType(), False), T.StructField("part_start", T.LongType(), False),
        T.StructField("n_tokens", T.LongType(), False),
        T.StructField("tokens", T.ArrayType(T.IntegerType(), False), False),
    ])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in slices(batch):
                ids, bounds = enc.encode(rows.column("text"))
                # The end id goes behind each document.
                ids = np.insert(ids, bounds[1:], end_id).astype(np.int32)
                bounds = bounds + np.arange(len(bounds))
                n = np.diff(bounds)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), *(rows.column(c) for c in metadata), pa.array(np.full(len(n), part, np.int32)),
                     pa.array(seen + bounds[:-1]), pa.array(n), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))],
                    names=["doc_id", *metadata, "part", "part_start", "n_tokens", "tokens"])
                seen += int(bounds[-1])

    return ordered.mapInArrow(encode, schema)


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, encoding: str = "dictionary",
    row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 1000,
    metadata: tuple[str, ...] = METADATA,
) -> None:
    """encoding: dictionary, or delta (binary packed differences, without a dictionary)."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding {encoding!r}: dictionary or delta")
    ids = "tokens.list.element"
    writer = (
        encode_documents(docs, tokenizer, end_id, metadata).write.mode("overwrite")
        .option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option(f"parquet.enable.dictionary#{ids}", str(encoding == "dictionary").lower())
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(page_bytes))
        .option("parquet.page.row.count.limit", str(page_rows))
    )
    writer.parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "tokens"), low=None, high=None) -> DataFrame:
    """Chosen columns of the documents with low <= doc_id <= high; the scan skips all else."""
    rows = spark.read.parquet(path)
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.where(F.col("doc_id") <= high)
    return rows.select(*columns)


def read_starts(spark: SparkSession, path: str) -> DataFrame:
    """All rows with start: the ids of all documents before one. The broadcast side has one row per part."""
    rows = spark.read.parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    before = parts.select("part", F.coalesce(
        F.sum("in_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("base"))
    return rows.join(F.broadcast(before), "part").withColumn("start", F.col("base") + F.col("part_start")).drop("base")


def ids_crc32(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """columns and ids_crc32, of the ids as little-endian unsigned 32-bit integers."""
    schema = T.StructType([*(rows.schema[c] for c in columns), T.StructField("ids_crc32", T.LongType(), False)])

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            at = lists.offsets.to_numpy()
            raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            got = np.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(got)], names=[*columns, "ids_crc32"])

    return rows.select(*columns, "tokens").mapInArrow(crc, schema)
