"""Language-model scores by context-tree weighting over bytes, beside a unigram base score.

A text is its UTF-8 bytes with A-Z in lower case and an end sign (0xFF, which no
UTF-8 text holds). Each byte is eight binary decisions; every decision has a
tree of contexts, the 0 to `DEPTH` bytes before it (0xFF before the start).
Each node keeps how often 0 and 1 followed in the training texts, with the
Krichevsky-Trofimov block probability KT of those counts and the weighted
probability W = (KT + product of the children's W) / 2. A decision is predicted
by all depths at once: the node at depth d has the share b / (1 + b) of what
its ancestors leave over, b = KT / product of the children's W, the deepest node
the rest. A node that training never met predicts as its parent does.

Spark counts all (DEPTH + 1)-byte windows (those of scored texts with count 0, so
that every window has a length), builds the tree bottom-up by one aggregation a
depth, and weighs it top-down by one join a depth. A window's code length is then
one number, and a text's score the sum over its windows. The windows go to the
tasks in blocks of at most `TABLE` entries, one pass over the texts a block.

The base score needs the count of every word. Words of at least one in
2**`COMMON` of all (so at most 2**COMMON of them) go to the tasks; each text's
other words are joined with the counts by a shuffle.

Cases: null texts are empty ones, which have the end alone; a null doc_id is
trained on and not held out; repeated ids keep their rows; without training texts
every count is 0 and each decision costs one bit; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlake.llm.textkit import LOWER, buffers, slices, span_hashes, words
from rasterlake.session import work_dir

DEPTH = 5
COMMON = 22
TABLE = 1 << 24
#: Different keys that a counting task holds before it lets them go.
HELD_KEYS = 1_000_000
#: Bytes of text at once; a window takes some fifty bytes while it is made.
SLICE = 1 << 20
_END = 0xFF
_GRAM, _WORD, _DOCS = 0, 1, 2


def windows(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Every byte and the end of every text with the bytes before it, as one number; and where each text's begin."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    to = np.concatenate([[0], np.cumsum(size + depth + 1)])
    padded = np.full(to[-1], _END, np.uint8)
    place = np.arange(len(data)) + np.repeat(to[:-1] + depth - offsets[:-1], size)
    padded[place] = data
    real = np.ones(len(padded), bool)
    for k in range(depth):
        real[to[:-1] + k] = False
    key = np.zeros(len(padded) - depth if n else 0, np.int64)
    for k in range(depth + 1):
        key = (key << 8) | padded[k : len(padded) - depth + k] if n else key
    return key[real[depth:]], np.concatenate([[0], np.cumsum(size + 1)])


class Tally:
    """Sums by key, merged as they grow."""

    def __init__(self):
        self.keys, self.n, self.waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.waiting.append((keys, n))
        if sum(len(k) for k, _ in self.waiting) > HELD_KEYS:
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        n = np.concatenate([self.n, *(c for _, c in self.waiting)])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.n, self.waiting = keys[first], np.add.reduceat(n, first) if len(first) else n, []

    def drain(self, kind: int, least: int = 0) -> Iterator[pa.RecordBatch]:
        self.merge()
        if len(self.keys) > least:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(self.keys), kind, np.int8)), pa.array(self.keys), pa.array(self.n)], names=["kind", "key", "n"])
            self.__init__()


def _held_out(held: int, folds: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(folds)) == held


def counts(docs: DataFrame, held: int, folds: int, depth: int = DEPTH) -> DataFrame:
    """kind, key, n: windows and words of the training texts, windows of all texts, and training texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, terms, texts = Tally(), Tally(), 0
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                data, offsets = buffers(part.column("text"))
                data = LOWER[data]
                learnt = part.column("learnt").to_numpy(zero_copy_only=False).astype(bool)
                key, bounds = windows(data, offsets, depth)
                of_learnt = np.repeat(learnt, np.diff(bounds))
                grams.add(*np.unique(key[of_learnt], return_counts=True))
                rest = np.unique(key[~of_learnt])
                grams.add(rest, np.zeros(len(rest), np.int64))
                w = words(data, offsets)
                h = span_hashes(data, w.starts, w.ends).view(np.int64)
                terms.add(*np.unique(h[np.repeat(learnt, np.diff(w.bounds))], return_counts=True))
                texts += int(learnt.sum())
                yield from grams.drain(_GRAM, HELD_KEYS) if len(grams.keys) > HELD_KEYS else ()
                yield from terms.drain(_WORD, HELD_KEYS) if len(terms.keys) > HELD_KEYS else ()
        yield from grams.drain(_GRAM)
        yield from terms.drain(_WORD)
        yield pa.RecordBatch.from_arrays([pa.array([_DOCS], pa.int8()), pa.array([0], pa.int64()), pa.array([texts], pa.int64())], names=["kind", "key", "n"])

    rows = docs.select((~_held_out(held, folds)).alias("learnt"), "text")
    return rows.mapInArrow(count, "kind tinyint, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _lgamma(x: Column) -> Column:
    """log gamma for x > 0 to about 1e-10: the Stirling series behind a shift by seven."""
    z, shift = x + 7, F.lit(1.0)
    for k in range(7):
        shift = shift * (x + k)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - F.log(shift)


def _kt(a: Column, b: Column) -> Column:
    """log of the Krichevsky-Trofimov probability of a block of a zeros and b ones."""
    return F.when(a + b == 0, 0.0).otherwise(_lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1.0) - math.log(math.pi))


def _steps() -> list[tuple[Column, Column]]:
    """(node, bit) of the eight decisions of a window's last byte; a node is 1 and the bits so far."""
    sym = F.col("key").bitwiseAND(255)
    return [((F.lit(1 << j) + F.shiftright(sym, 8 - j)).cast("int"), F.shiftright(sym, 7 - j).bitwiseAND(1).cast("int")) for j in range(8)]


def code_lengths(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """key, log10p of every window (key, n)."""
    spark = grams.sparkSession
    path = work_dir(spark, "tree")
    steps = F.array(*(F.struct(node.alias("node"), bit.alias("bit")) for node, bit in _steps()))
    bits = grams.select("n", F.shiftright("key", 8).alias("ctx"), F.explode(steps).alias("s")).select("n", "ctx", "s.node", "s.bit")
    rows = bits.groupBy("ctx", "node").agg(
        F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("n0"), F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("n1"))
    rows.withColumn("children", F.lit(0.0)).withColumn("w", _kt(F.col("n0"), F.col("n1"))).write.parquet(f"{path}/{depth}")
    for d in range(depth - 1, -1, -1):
        below = spark.read.parquet(f"{path}/{d + 1}")
        level = below.groupBy(F.col("ctx").bitwiseAND((1 << 8 * d) - 1).alias("ctx"), "node").agg(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("w").alias("children"))
        kt = _kt(F.col("n0"), F.col("n1"))
        top = F.greatest("kt", "children")
        level.withColumn("kt", kt).withColumn(
            "w", top + F.log(0.5 * (F.exp(F.col("kt") - top) + F.exp(F.col("children") - top)))).write.parquet(f"{path}/{d}")
    above = None
    for d in range(depth + 1):
        level = spark.read.parquet(f"{path}/{d}").select("ctx", "node", "n0", "n1", "children", *(["kt"] if d < depth else []))
        if above is None:
            level = level.select("*", F.lit(0.0).alias("done"), F.lit(1.0).alias("left"), F.lit(0.5).alias("up"))
        else:
            level = level.withColumn("pctx", F.col("ctx").bitwiseAND((1 << 8 * (d - 1)) - 1)).join(above, ["pctx", "node"])
        seen = F.col("n0") + F.col("n1") > 0
        own = F.when(seen, (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)).otherwise(F.col("up"))
        share = F.when(seen, 1 / (1 + F.exp(F.least(F.col("children") - F.col("kt"), F.lit(700.0))))).otherwise(1.0) if d < depth else F.lit(1.0)
        level = level.select("ctx", "node", own.alias("own"), share.alias("share"), "done", "left")
        above = level.select(
            F.col("ctx").alias("pctx"), "node", F.col("own").alias("up"), (F.col("done") + F.col("left") * F.col("share") * F.col("own")).alias("done"),
            (F.col("left") * (1 - F.col("share"))).alias("left"))
    # A context has at most 255 nodes, so one row holds them all, and each window meets its context once.
    ones = above.groupBy("pctx").agg(F.map_from_entries(F.collect_list(F.struct("node", "done"))).alias("ones"))
    own = grams.select("key", F.shiftright("key", 8).alias("pctx")).join(ones, "pctx")
    total = F.lit(0.0)
    for node, bit in _steps():
        p1 = F.try_element_at("ones", node)
        total = total + F.log10(F.when(bit == 1, p1).otherwise(1 - p1))
    return own.select("key", total.alias("log10p"))


@dataclass
class Lookup:
    """Values by 64-bit key, open addressing in a table at most half full."""

    keys: np.ndarray
    values: np.ndarray
    full: np.ndarray
    shift: int

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Lookup:
        bits = max(4, int(2 * len(keys)).bit_length())
        out = cls(np.zeros(1 << bits, np.int64), np.zeros(1 << bits, values.dtype), np.zeros(1 << bits, bool), 64 - bits)
        left = np.arange(len(keys))
        slot = out._slot(keys)
        while len(left):
            free = ~out.full[slot]
            # Of several keys that want one slot, the first gets it.
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            won = first[free[first]]
            out.keys[slot[won]], out.values[slot[won]], out.full[slot[won]] = keys[left[won]], values[left[won]], True
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, slot = left[rest], (slot[rest] + 1) & (len(out.full) - 1)
        return out

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).view(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, 0 where there is none; and where there is one."""
        slot = self._slot(keys)
        hit = self.full[slot] & (self.keys[slot] == keys)
        out = np.where(hit, self.values[slot], 0)
        left = np.flatnonzero(~hit & self.full[slot])
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(self.full) - 1)
            here = self.full[slot] & (self.keys[slot] == keys[left])
            out[left[here]], hit[left[here]] = self.values[slot[here]], True
            go = ~here & self.full[slot]
            left, slot = left[go], slot[go]
        return out, hit


_tables: dict[str, Lookup] = {}


def _table(name: str, held) -> Lookup:
    """The table of a broadcast pair of arrays, built once per worker."""
    if name not in _tables:
        for old in list(_tables)[:-1]:
            del _tables[old]
        _tables[name] = Lookup.of(*held.value)
    return _tables[name]


def _sent(rows: DataFrame, key: str, value: str):
    """Two columns of a bounded table, broadcast as plain arrays."""
    got = rows.select(F.col(key).cast("long"), F.col(value).cast("double")).toArrow()
    pair = tuple(c.to_numpy() for c in got.columns)
    del got  # the driver holds one copy
    held = rows.sparkSession.sparkContext.broadcast(pair)
    return held


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def score(docs: DataFrame, held: int = 2, folds: int = 7, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row."""
    spark = docs.sparkSession
    path = work_dir(spark, "counts")
    counts(docs, held, folds, depth).write.parquet(path)
    counted = spark.read.parquet(path)
    term = counted.where(F.col("kind") == _WORD).select(F.col("key").alias("word"), F.col("n").alias("c"))
    texts = counted.where(F.col("kind") == _DOCS).agg(F.sum("n")).first()[0] or 0
    n, v = term.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = n + texts, v + (texts > 0)
    base = math.log10(n + v + 1)

    path = work_dir(spark, "lengths")
    code_lengths(counted.where(F.col("kind") == _GRAM).select("key", "n"), depth).write.parquet(path)
    lengths = spark.read.parquet(path)
    blocks = -(-lengths.count() // TABLE) or 1
    terms = _sent(term.where(F.col("c") * (1 << COMMON) >= n), "word", "c")  # at most 2**COMMON rows
    doc_id = docs.schema["doc_id"]
    schema = T.StructType([
        T.StructField("doc_id", doc_id.dataType), *(T.StructField(c, t) for c, t in (
            ("row", T.LongType()), ("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_bytes", T.LongType()), ("n_known", T.LongType()),
            ("base", T.DoubleType()), ("score", T.DoubleType()), ("word", T.LongType()), ("n", T.LongType())))])

    path = work_dir(spark, "scores")

    def run(block: int):
        grams = _sent(lengths.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block), "key", "log10p")  # about TABLE rows
        name = f"{path}/{block}"

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            row = TaskContext.get().partitionId() << 33
            known_terms, table = _table(f"{name}/terms", terms), _table(name, grams)
            for batch in batches:
                for part in slices(batch, limit=SLICE):
                    data, offsets = buffers(part.column("text"))
                    data = LOWER[data]
                    key, bounds = windows(data, offsets, depth)
                    m = part.num_rows
                    rows = np.arange(row, row + m)
                    row += m
                    got = _per_text(table.get(key)[0], bounds)
                    zero, nothing = np.zeros(m, np.int64), pa.nulls(m, pa.int64())
                    if block:
                        yield pa.RecordBatch.from_arrays([
                            part.column("doc_id"), pa.array(rows), part.column("held_out"), pa.array(zero), pa.array(zero), pa.array(zero),
                            pa.array(np.zeros(m)), pa.array(got), nothing, nothing], names=schema.names)
                        continue
                    w = words(data, offsets)
                    h = span_hashes(data, w.starts, w.ends).view(np.int64)
                    c, known = known_terms.get(h)
                    logs = np.where(known, np.log10(c + 1) - base, 0.0)
                    end = math.log10(texts + 1) - base
                    yield pa.RecordBatch.from_arrays([
                        part.column("doc_id"), pa.array(rows), part.column("held_out"), pa.array(np.diff(w.bounds) + 1), pa.array(np.diff(bounds)),
                        pa.array(_per_text(known.astype(np.int64), w.bounds) + int(texts > 0)), pa.array(_per_text(logs, w.bounds) + end), pa.array(got), nothing, nothing],
                        names=schema.names)
                    # The words that few texts hold: one row for each in each text.
                    of, rare = w.doc[~known], h[~known]
                    order = np.lexsort((rare, of))
                    of, rare = of[order], rare[order]
                    first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (rare[1:] != rare[:-1]))) if len(of) else np.zeros(0, np.int64)
                    k = len(first)
                    if k:
                        many = np.diff(np.append(first, len(of)))
                        gone = [pa.nulls(k, t) for t in (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                        yield pa.RecordBatch.from_arrays([pa.nulls(k, part.column("doc_id").type), pa.array(rows[of[first]]), *gone, pa.array(rare[first]), pa.array(many)], names=schema.names)

        return docs.select("doc_id", _held_out(held, folds).alias("held_out"), "text").mapInArrow(each, schema)

    for block in range(blocks):
        run(block).write.parquet(f"{path}/{block}")
    scored = spark.read.parquet(f"{path}/0")
    rare = (
        scored.where("word is not null").select("row", "word", "n").join(term.hint("shuffle_hash"), "word", "left")
        .groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("known"), F.sum(F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + 1.0) - base)).alias("logs"))
    )
    out = scored.where("word is null").drop("word", "n").join(rare, "row", "left")
    for block in range(1, blocks):
        more = spark.read.parquet(f"{path}/{block}").select("row", F.col("score").alias("more"))
        out = out.join(more, "row").withColumn("score", F.col("score") + F.col("more")).drop("more")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0))).alias("base_score"), "score", (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"))
