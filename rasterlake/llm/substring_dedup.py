"""Substring dedup by content-defined chunks.

A gear hash rolls over the UTF-8 bytes: h = (h << 1) + table[byte], 32 bits, so
it depends on the last 32 bytes alone. A chunk may end where its top `BITS`
bits are zero, at least `LEAST` and at most `MOST` bytes after its start; an
insertion therefore moves the borders near it and no others. Chunks with equal
128-bit digests are equal. A run is one of neighbouring chunks of a document,
each found in another document too; at both ends it goes on, byte by byte, as
far into the cut chunks as another document that holds its last chunk does. A
repeated span is a run so extended, of at least `SPAN` bytes. Spans of one text
may overlap where two runs go on into the same chunk. A passage without one
whole shared chunk has no run, and so no span.

One pass over the texts makes the chunks; one aggregation by digest, combined
before its shuffle, finds those of two documents or more; one join brings that
back to the chunks. A second pass reads the bytes beside the chunks that end a
run, wherever these chunks stand, and sorts them over range partitions: what
agrees longest with a place in another document is its neighbour in that order,
so one walk over the sorted rows finds it, and at the borders of partitions a walk over
their first and last rows. Nothing gathers a digest's chunks, however many they are.

Cases: a null text is an empty one and has no chunks; rows that share an id are
one document, though each text has spans of its own; rows without an id are
compared with the others, but are not documents that make a span repeated; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlake.llm.textexpr import fresh
from rasterlake.llm.textkit import buffers, slices
from rasterlake.session import work_dir

BITS, LEAST, MOST = 5, 16, 256
SPAN = 128
#: Bytes beside a chunk that the first comparison of run ends reads; most cut chunks are shorter.
WIDTH = 64
#: Partitions whose border rows one task walks.
PARTS = 1024
_GEAR = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash behind every byte, by doubling the window: 1, 2, 4, .. 32 bytes."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8, 16):
        shifted = h[:-width] << np.uint32(width)
        h = h.copy()
        h[width:] += shifted
    return h


def cuts(data: np.ndarray, bits: int = BITS, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of one text. The last chunk may be shorter than `least`."""
    size, last, out = len(data), 0, []
    for end in (np.flatnonzero(gear(data) >> np.uint32(32 - bits) == 0) + 1).tolist() + [size]:
        while end - last > most:
            last += most
            out.append(last)
        if end - last >= least or (end == size and end > last):
            out.append(end)
            last = end
    return out


def _text_key(text: Column) -> Column:
    """The first 64 bits of a text's SHA-256."""
    return F.conv(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 16), 16, -10).cast("long")


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (64 bits of the text's digest), at (place in the text), start, end (bytes), d0, d1 (the chunk's digest)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = buffers(part.column("text"))
                raw = memoryview(data)
                doc, at, start, end, digest = [], [], [], [], []
                for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    ends = cuts(data[a:b]) if b > a else []
                    doc.append(np.full(len(ends), k))
                    at.append(np.arange(len(ends)))
                    begins = [0, *ends[:-1]]
                    start.append(begins[: len(ends)])
                    end.append(ends)
                    digest += [hashlib.blake2b(raw[a + x : a + y], digest_size=16).digest() for x, y in zip(begins, ends, strict=False)]
                d = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
                flat = lambda x: pa.array(np.concatenate([np.asarray(y, np.int32) for y in x]) if x else np.zeros(0, np.int32))
                rows = pa.array(np.concatenate(doc))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(rows), part.column("text_key").take(rows), flat(at), flat(start), flat(end), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())],
                    names=["doc_id", "text_key", "at", "start", "end", "d0", "d1"])

    return docs.select("doc_id", _text_key(F.col("text")).alias("text_key"), "text").mapInArrow(split, f"doc_id {kind}, text_key bigint, at int, start int, end int, d0 bigint, d1 bigint")


def _contexts(docs: DataFrame, sites: DataFrame, width: int) -> DataFrame:
    """sites (site, doc_id, text_key, side, pos, edge, tag) with own: the `width` bytes before pos, the nearest first, or behind it."""
    own_key, own_id = fresh([*sites.columns, "text"], "own_key", "own_id")
    kind = docs.schema["doc_id"].dataType

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column("text").to_pylist(), batch.column("sites")
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            own, at = [], 0
            side, pos = flat.field("side").to_pylist(), flat.field("pos").to_pylist()
            for text, n in zip(texts, lengths.tolist(), strict=True):
                raw = text.encode()
                own += [raw[max(p - width, 0) : p][::-1] if d < 0 else raw[p : p + width] for d, p in zip(side[at : at + n], pos[at : at + n], strict=True)]
                at += n
            rows = pa.array(np.repeat(np.arange(batch.num_rows), lengths))
            yield pa.RecordBatch.from_arrays(
                [flat.field("site"), batch.column("doc_id").take(rows), batch.column("text_key").take(rows), *(flat.field(c) for c in ("side", "pos", "edge", "tag")), pa.array(own, pa.binary())],
                names=["site", "doc_id", "text_key", "side", "pos", "edge", "tag", "own"])

    texts = docs.where("text <> ''").select(F.col("doc_id").alias(own_id), "text", _text_key(F.col("text")).alias(own_key))
    # As many sites as one text holds. Rows that share an id and a text have the same sites.
    sites = sites.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("site", "side", "pos", "edge", "tag")).alias("sites"))
    schema = T.StructType([
        T.StructField("site", T.LongType()), T.StructField("doc_id", kind), T.StructField("text_key", T.LongType()), T.StructField("side", T.IntegerType()),
        T.StructField("pos", T.IntegerType()), T.StructField("edge", T.BooleanType()), T.StructField("tag", T.BinaryType()), T.StructField("own", T.BinaryType())])
    joined = texts.join(sites, texts[own_id].eqNullSafe(sites["doc_id"]) & (texts[own_key] == sites["text_key"]))
    return joined.select("doc_id", "text_key", "text", "sites").mapInArrow(around, schema)


def _common(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted partition (tag, own, doc_id): site, got of the edge sites, and the rows at its borders (site null).

    Consecutive rows of one tag and document are a run; the row before it and the one behind it are the nearest of
    other documents. What lies beyond the partition is left open: the agreement with the partition's own first (last)
    row, which holds up to what that row has beyond it. Of a border row, got says what it is: 0 the first row, 1 the last,
    2 the first of the second run or the last of the last but one, which are the nearest where a run goes on into the next partition.
    """
    out: list[tuple] = []
    run, before, first, heads, tails = [], None, None, [], []
    part = tag = doc = last = None
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def close(behind) -> None:
        """The run ends at the row behind it, None at the partition's end."""
        for site, own in run:
            got = max(_common(own, before[2]) if before and before[0] == tag else 0, _common(own, behind[2]) if behind and behind[0] == tag else 0)
            out.append((site, got, _common(own, first[2]) if before is None else None, _common(own, last) if behind is None else None, part, None, None, None))
        tails.append((tag, doc, last))
        del tails[:-2]

    def batch_of(rows) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 8
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c, t) for c, t in zip(columns, kinds, strict=False)), pa.array(columns[7], doc_type)],
            names=["site", "got", "open_left", "open_right", "part", "tag", "own", "doc_id"])

    doc_type = None
    for batch in batches:
        doc_type = batch.column("doc_id").type
        columns = [batch.column(c).to_pylist() for c in ("tag", "doc_id", "own", "site", "edge", "part")]
        for t, d, own, site, edge, part in zip(*columns, strict=True):
            if t != tag or d != doc:
                if tag is None:
                    first = (t, d, own)
                else:
                    close((t, d, own))
                    before = (tag, doc, last)
                if len(heads) < 2:
                    heads.append((t, d, own))
                tag, doc, run = t, d, []
            last = own
            if edge:
                run.append((site, own))
        if len(out) > 10_000:
            yield batch_of(out)
            out = []
    if tag is not None:
        close(None)
        rows = [(0, heads[0]), (1, tails[-1]), *((2, r) for r in heads[1:] + tails[:-1])]
        out += [(None, what, None, None, part, t, own, d) for what, (t, d, own) in rows]
        yield batch_of(out)


def _nearest(contexts: DataFrame, dealt: int | None = None) -> DataFrame:
    """site, got (the most bytes of own that the same tag has in another document too) of the sites at ends of runs, in documents with an id.

    The border rows of the partitions, four each, are a table of the same kind, which is walked in turn over an
    eighth of the partitions, until one task can do it. dealt: how many partitions to walk.
    """
    spark = contexts.sparkSession
    order = ["tag", "own", "doc_id"]
    rows = contexts.where("doc_id is not null").select(*order, "site", "edge")
    rows = rows.repartitionByRange(*order) if dealt is None else rows.coalesce(1) if dealt == 1 else rows.repartitionByRange(dealt, *order)
    ints = [T.StructField(c, T.IntegerType()) for c in ("got", "open_left", "open_right", "part")]
    schema = T.StructType([T.StructField("site", T.LongType()), *ints, T.StructField("tag", T.BinaryType()), T.StructField("own", T.BinaryType()), contexts.schema["doc_id"]])
    path = work_dir(spark, "nearest")
    rows.sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).mapInArrow(_walk, schema).write.parquet(path)
    walked = spark.read.parquet(path)
    found, borders = walked.where("site is not null"), walked.where("site is null")
    if dealt == 1:
        return found.select("site", "got")
    parts = borders.agg(F.countDistinct("part")).first()[0]
    sites = borders.select(*order, (F.col("part") * 2 + F.col("got")).cast("long").alias("site"), (F.col("got") < 2).alias("edge"))
    ends = _nearest(sites, 1 if parts <= PARTS else max(1, parts // 8))
    beyond = ends.groupBy(F.floor(F.col("site") / 2).cast("int").alias("part")).agg(
        F.max(F.when(F.col("site") % 2 == 0, F.col("got"))).alias("left"), F.max(F.when(F.col("site") % 2 == 1, F.col("got"))).alias("right"))
    open_ = lambda side: F.when(F.col(f"open_{side}").isNotNull(), F.least(f"open_{side}", side))
    # Two numbers a partition.
    return found.join(F.broadcast(beyond), "part").select("site", F.greatest("got", open_("left"), open_("right")).alias("got"))


def _least(contexts: DataFrame, best: DataFrame) -> DataFrame:
    """best with least: the least doc_id that has those bytes. As many digests a context as its tag has different lengths."""
    rung = lambda k: F.unhex(F.md5(F.concat("tag", F.col("own").substr(F.lit(1), k))))
    own = contexts.join(best.where("got > 0"), "site").select("site", "got", "tag", rung(F.col("got")).alias("rung"))
    held = (
        contexts.where("doc_id is not null").join(own.select("tag", "got").distinct(), "tag").where(F.length("own") >= F.col("got"))
        .groupBy(rung(F.col("got")).alias("rung")).agg(F.min("doc_id").alias("least")))
    return best.join(own.join(held, "rung").select("site", "least"), "site", "left")


def _agreed(contexts: DataFrame, width: int) -> DataFrame:
    """site, got (the most bytes of own that the same tag has in another document too), least (the least doc_id that has them)
    and cell (their digest) of the sites at ends of runs.

    A cell is a prefix of own where the search of some such site has come to: all
    sites with that prefix try the longer ones, as each may be that site's best."""
    spark = contexts.sparkSession
    state = contexts.where("edge").select("site", F.lit(0).alias("got"), F.lit(None).cast(contexts.schema["doc_id"].dataType).alias("least"), F.col("tag").alias("cell"))
    cells, step, times = None, width // 4, 4
    while step:
        at = contexts.withColumn("base", F.lit(0)) if cells is None else contexts.join(cells, "site")
        rungs = (
            at.where(F.length("own") >= F.col("base") + step)
            .select("site", "doc_id", "tag", "own", F.explode(F.sequence(F.col("base") + step, F.least(F.length("own"), F.col("base") + times * step), F.lit(step))).alias("k"))
            .select("site", "doc_id", "k", F.unhex(F.md5(F.concat("tag", F.col("own").substr(F.lit(1), F.col("k"))))).alias("rung")))
        held = (
            rungs.groupBy("rung").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
            .where("least <> most").select("rung", "least"))
        path = work_dir(spark, "rungs")
        rungs.join(held, "rung").select("site", "k", "rung", "least").write.parquet(path)
        found = spark.read.parquet(path)
        own = found.select("site", F.col("k").alias("got"), "least", F.col("rung").alias("cell")).join(state.select("site"), "site", "left_semi")
        path = work_dir(spark, "rungs")
        state.unionByName(own).groupBy("site").agg(F.max("got").alias("got"), F.max_by("least", "got").alias("least"), F.max_by("cell", "got").alias("cell")).write.parquet(path)
        state = spark.read.parquet(path)
        before = contexts.select("site", F.lit(0).alias("base"), F.col("tag").alias("cell")) if cells is None else cells.select("site", "base", "cell")
        cells = (
            before.unionByName(found.select("site", F.col("k").alias("base"), F.col("rung").alias("cell")))
            .join(state.select("cell").distinct(), "cell", "left_semi").distinct())
        step, times = step // 4, 3
    return state


def _extended(docs: DataFrame, found: DataFrame, runs: DataFrame, holders: bool) -> DataFrame:
    """site, more (bytes) and, for holders, least: how far the ends of runs go on into the cut chunks, byte by byte.

    A site is a place where a chunk that ends some run stands, in any document.
    Sites of one chunk are compared by the bytes next to it. Where a whole width of
    bytes agrees, the next round goes on behind it, with 16 times the width. The few sites without a
    doc_id need two other documents, which a ladder of digests finds."""
    spark = docs.sparkSession
    ends = F.array(F.struct(F.lit(-1).alias("side"), "d_first.*"), F.struct(F.lit(1).alias("side"), "d_last.*"))
    tags = runs.select(F.explode(ends).alias("e")).select("e.*").distinct()
    both = found.select(
        "doc_id", "text_key", "d0", "d1", F.explode(F.array(F.struct(F.lit(-1).alias("side"), F.col("start").alias("pos")), F.struct(F.lit(1).alias("side"), F.col("end").alias("pos")))).alias("s"),
    ).select("doc_id", "text_key", "d0", "d1", "s.side", "s.pos").where("side > 0 or pos > 0")
    edges = runs.select("doc_id", "text_key", F.explode(F.array(F.struct(F.lit(-1).alias("side"), F.col("start").alias("pos")), F.struct(F.lit(1).alias("side"), F.col("end").alias("pos")))).alias("e"))
    edges = edges.select(F.xxhash64("doc_id", "text_key", "e.side", "e.pos").alias("site")).distinct().withColumn("edge", F.lit(True))
    sites = (
        both.join(tags, ["side", "d0", "d1"], "left_semi").distinct()
        .select(F.xxhash64("doc_id", "text_key", "side", "pos").alias("site"), "doc_id", "text_key", "side", "pos", F.unhex(F.md5(F.concat_ws(" ", "side", "d0", "d1"))).alias("tag"))
        .join(edges, "site", "left").withColumn("edge", F.coalesce("edge", F.lit(False))))
    width, parts = WIDTH, []
    while True:
        path = work_dir(spark, "contexts")
        _contexts(docs, sites.distinct(), width).write.parquet(path)
        contexts = spark.read.parquet(path)
        best = _nearest(contexts)
        nameless = contexts.where("doc_id is null and edge").select("tag").distinct()
        if not nameless.isEmpty():
            best = best.unionByName(_agreed(contexts.join(nameless, "tag", "left_semi"), width).join(
                contexts.where("doc_id is null").select("site"), "site", "left_semi").select("site", "got"))
        best = _least(contexts, best) if holders else best.withColumn("least", F.lit(None).cast(contexts.schema["doc_id"].dataType))
        path = work_dir(spark, "extended")
        best.write.parquet(path)
        best = spark.read.parquet(path)
        parts.append(best)
        whole = contexts.where(F.length("own") == width).withColumn("next", F.unhex(F.md5(F.concat("tag", "own"))))
        on = whole.join(best.where(F.col("got") == width), "site", "left_semi").select("next").distinct()
        if on.isEmpty():
            break
        sites = whole.join(on, "next", "left_semi").select("site", "doc_id", "text_key", "side", (F.col("pos") + F.col("side") * width).alias("pos"), "edge", F.col("next").alias("tag"))
        width *= 16
    got = parts[0]
    for x in parts[1:]:
        got = got.unionByName(x)
    # The least doc_id of the longest part that agrees has the shorter ones too.
    return got.groupBy("site").agg(F.sum("got").cast("int").alias("more"), F.max_by("least", "got").alias("least"))


def _spans(docs: DataFrame, span: int, holders: bool) -> DataFrame:
    """What repeated() gives, and with holders from, to: the bytes that an earlier document holds as well where doc_id is not first_doc."""
    spark = docs.sparkSession
    path = work_dir(spark, "chunks")
    chunks(docs).write.parquet(path)
    every = spark.read.parquet(path)
    held = (
        every.groupBy("d0", "d1").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
        .where("first_doc <> last_doc").select("d0", "d1", "first_doc")
    )
    path = work_dir(spark, "shared-chunks")
    every.join(held, ["d0", "d1"]).write.parquet(path)
    found = spark.read.parquet(path)
    # Neighbours in a text: the place less the rank is the same all along a run.
    rank = F.dense_rank().over(Window.partitionBy("doc_id", "text_key").orderBy("at"))
    path = work_dir(spark, "runs")
    found.withColumn("run", F.col("at") - rank).groupBy("doc_id", "text_key", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.countDistinct("at").alias("n_chunks"), F.min_by("first_doc", "at").alias("first_doc"),
        F.min_by(F.struct("d0", "d1"), "at").alias("d_first"), F.max_by(F.struct("d0", "d1"), "at").alias("d_last"),
    ).drop("run").write.parquet(path)
    runs = spark.read.parquet(path)
    more = _extended(docs, found, runs, holders)
    for side, pos, name in ((-1, "start", "left"), (1, "end", "right")):
        own = more.select("site", F.col("more").alias(name), F.col("least").alias(f"{name}_doc"))
        runs = runs.withColumn("site", F.xxhash64("doc_id", "text_key", F.lit(side), pos)).join(own, "site", "left").drop("site")
    before, behind = F.coalesce("left", F.lit(0)), F.coalesce("right", F.lit(0))
    cut = lambda name, n: F.when(F.col(f"{name}_doc") != F.col("doc_id"), n).otherwise(0)
    return runs.where(F.col("end") - F.col("start") + before + behind >= span).select(
        "doc_id", "text_key", (F.col("start") - before).alias("start"), (F.col("end") + behind).alias("end"), "n_chunks", "first_doc",
        (F.col("start") - cut("left", before)).alias("from"), (F.col("end") + cut("right", behind)).alias("to"),
    )


def repeated(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, text_key, start, end (bytes), n_chunks, first_doc (the least doc_id that holds the span's first whole chunk)
    of every repeated span."""
    return _spans(docs, span, holders=False).drop("from", "to")


def remove_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """docs, all columns, with the repeated spans cut out of every document but the one that holds them first."""
    spans = _spans(docs, span, holders=True).where("doc_id <> first_doc").groupBy("doc_id", "text_key").agg(
        F.sort_array(F.collect_list(F.struct(F.col("from").alias("start"), F.col("to").alias("end")))).alias("spans"))  # as many as one text holds
    kept = docs.schema
    own_key, own_id, own_text, own_spans = fresh(docs.columns, "own_key", "own_id", "own_text", "own_spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column(own_spans).to_pylist(), strict=True):
                if spans:
                    raw, at, parts = text.encode(), 0, []
                    for s in spans:
                        parts.append(raw[at : s["start"]])
                        at = max(at, s["end"])
                    # A border may lie inside of a character, whose rest goes too.
                    text = b"".join([*parts, raw[at:]]).decode(errors="ignore")
                out.append(text)
            columns = [pa.array(out, batch.column("text").type) if n == "text" else batch.column(n) for n in kept.names]
            yield pa.RecordBatch.from_arrays(columns, names=kept.names)

    keyed = docs.withColumn(own_key, _text_key(F.col("text")))
    spans = spans.select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_text), F.col("spans").alias(own_spans))
    return keyed.join(spans, (keyed["doc_id"] == spans[own_id]) & (keyed[own_key] == spans[own_text]), "left").mapInArrow(cut, kept)
