"""Best-fit packing of documents into fixed-length sequences by a configuration program.

A configuration is a multiset of piece lengths that fits one sequence. The
linear program asks for the fewest sequences, over all configurations, that
cover the length histogram. It is solved by multiplicative weights: every
length has a price that falls as it gets covered, and each round buys the
configuration of the highest value, found by an unbounded-knapsack dynamic
program over 1..size. The weights are rounded down to whole sequences that
never exceed what is there, and the rest is packed best fit, longest first.

Spark counts the histogram (at most `size` rows whatever the corpus), ranks the
pieces of each length and gives every piece its place; only the histogram is
solved on the driver, and its cost does not depend on the number of documents.

Cases: a null text is an empty one, and an empty text is a piece with the end
id alone; null or repeated doc_ids keep their rows; an empty table gives no
pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlake.llm.textkit import slices
from rasterlake.llm.tokens import encoder
from rasterlake.session import work_dir

#: Rounds of the multiplicative weights.
ROUNDS = 150


def knapsack(values: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """Copies of each length in the most valuable configuration, each used freely."""
    best = np.zeros(size + 1)
    pick = np.full(size + 1, -1, np.int64)
    fits = np.searchsorted(lengths, np.arange(size + 1), side="right")
    for room in range(1, size + 1):
        best[room], pick[room] = best[room - 1], -1
        if fits[room]:
            got = best[room - lengths[: fits[room]]] + values[: fits[room]]
            k = int(got.argmax())
            if got[k] > best[room]:
                best[room], pick[room] = got[k], k
    out, room = np.zeros(len(lengths), np.int64), size
    while room > 0:
        k = pick[room]
        if k < 0:
            room -= 1
        else:
            out[k] += 1
            room -= lengths[k]
    return out


def solve(lengths: np.ndarray, counts: np.ndarray, size: int, rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Fractional uses of configurations (copies by length) that about cover the counts."""
    if not len(lengths):
        return {}
    covered = np.zeros(len(lengths))
    uses: dict[tuple[int, ...], float] = {}
    rate = np.sqrt(8 * np.log(max(2, len(lengths))) / rounds)
    # A piece starts at its length as price; what has been covered beyond others loses value.
    step = np.ceil((lengths * counts).sum() / size) / rounds
    for _ in range(rounds):
        short = covered / counts
        price = lengths * np.exp(-rate * (short - short.min()) * rounds / 8)
        config = knapsack(price, lengths, size)
        # Never more of a configuration in one round than its scarcest length can feed.
        used = config > 0
        amount = min(step, float((counts[used] / config[used]).min()))
        covered += amount * config
        key = tuple(config)
        uses[key] = uses.get(key, 0.0) + amount
    return uses


def _best_fit(lengths: np.ndarray, left: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """One configuration, longest first, each time the largest piece that fits; and how often it can be repeated."""
    config, room, free = np.zeros(len(lengths), np.int64), size, left.copy()
    while True:
        k = int(np.searchsorted(lengths, room, side="right")) - 1
        while k >= 0 and not free[k]:
            k -= 1
        if k < 0:
            break
        n = min(int(free[k]), int(room // lengths[k]))
        config[k] += n
        free[k] -= n
        room -= n * int(lengths[k])
    used = config > 0
    return config, int((left[used] // config[used]).min())


def plan(lengths: np.ndarray, counts: np.ndarray, size: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, int]]:
    """(copies by length, repetitions): whole sequences that hold every piece exactly once."""
    left, out = counts.astype(np.int64).copy(), []
    fractional = solve(lengths, counts.astype(float), size, rounds)
    full = {c: int(np.dot(c, lengths)) for c in fractional}
    # A configuration that wastes more room than the program does on average leaves its pieces to the best fit.
    mean = sum(full[c] * x for c, x in fractional.items()) / max(sum(fractional.values()), 1e-12)
    for key in sorted(fractional, key=lambda c: (-full[c], -fractional[c], c)):
        config = np.array(key)
        used = config > 0
        if full[key] < mean:
            break
        n = min(int(fractional[key]), int((left[used] // config[used]).min()))
        if n > 0:
            left -= n * config
            out.append((config, n))
    while left.any():
        config, n = _best_fit(lengths, left, size)
        left -= n * config
        out.append((config, n))
    return out


@dataclass
class Places:
    """Where the r-th piece of a length goes: runs of ranks by length, each from one configuration."""

    first: dict[int, np.ndarray]
    copies: dict[int, np.ndarray]
    sequence: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]

    @classmethod
    def of(cls, lengths: np.ndarray, planned: list[tuple[np.ndarray, int]]) -> Places:
        runs: dict[int, list[tuple[int, int, int, int]]] = {}
        base, done = 0, dict.fromkeys(map(int, lengths), 0)
        for config, n in planned:
            at = 0
            for k in np.flatnonzero(config)[::-1]:
                size, a = int(lengths[k]), int(config[k])
                runs.setdefault(size, []).append((done[size], a, base, at))
                done[size] += a * n
                at += a * size
            base += n
        cut = lambda j: {k: np.array([r[j] for r in v], np.int64) for k, v in runs.items()}
        return cls(cut(0), cut(1), cut(2), cut(3))

    def place(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run = np.searchsorted(self.first[length], rank, side="right") - 1
        q, a = rank - self.first[length][run], self.copies[length][run]
        return self.sequence[length][run] + q // a, self.offset[length][run] + q % a * length


def pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), part and the rank among a part's pieces of that length."""
    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("piece", T.IntegerType(), False), T.StructField("start", T.LongType(), False),
        T.StructField("length", T.LongType(), False), T.StructField("ids_crc32", T.LongType(), False),
        T.StructField("part", T.IntegerType(), False), T.StructField("rank_in_part", T.LongType(), False),
        *([T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)] if with_ids else []),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            for rows in slices(batch):
                ids, bounds = enc.encode(rows.column("text"))
                ids = np.insert(ids, bounds[1:], end_id).astype("<u4")
                bounds = bounds + np.arange(len(bounds))
                n = -(-np.diff(bounds) // size)
                doc = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                first = bounds[doc] + piece * size
                length = np.minimum(bounds[doc + 1] - first, size)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + b)]) for a, b in zip(first.tolist(), length.tolist(), strict=True)]
                # The rank of each piece among those of its length, going on from earlier batches.
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                run = np.arange(len(ordered)) - np.searchsorted(ordered, ordered)
                rank = np.empty(len(ordered), np.int64)
                rank[order] = seen[ordered] + run
                seen += np.bincount(length, minlength=size + 1)
                out = [rows.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(piece * size),
                       pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(rank)]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(first, bounds[-1]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, with_ids: bool = False, rounds: int = ROUNDS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    spark = docs.sparkSession
    # Written once: ranks must not change if an executor is lost between the two reads.
    path = work_dir(spark, "pieces")
    pieces(docs, tokenizer, size, end_id, with_ids).write.parquet(path)
    cut = spark.read.parquet(path)
    by_part = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = by_part.groupBy("length").agg(F.sum("n").alias("n")).orderBy("length").collect()  # at most `size` rows
    lengths = np.array([r["length"] for r in histogram], np.int64)
    places = Places.of(lengths, plan(lengths, np.array([r["n"] for r in histogram], np.int64), size, rounds))

    before = by_part.select("part", "length", F.coalesce(
        F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("before"))
    ranked = cut.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("rank_in_part"))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = T.StructType([*(ranked.schema[c] for c in kept),
                           T.StructField("sequence_id", T.LongType(), False), T.StructField("offset", T.LongType(), False)])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            for at in np.split(order, np.flatnonzero(np.diff(ordered)) + 1) if len(order) else []:
                sequence[at], offset[at] = places.place(int(length[at[0]]), rank[at])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.select(*kept, "rank").mapInArrow(put, schema)
