"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Words are lower-case runs of letters and digits. A seed is a window of `LEAST`
to n words of a test item that chance would hardly put into the corpus: the
number of windows expected from the corpus's own word counts is at most
`EXPECTED`. Every word of an item begins the shortest such window there is. (An
item without one keeps the `SPARE` rarest of each length.) Where a seed occurs in a
document, the item is aligned with the words around it; edits, insertions and
omissions cost less than the words that agree gain. A pair is reported if the
best score reaches `similarity` of the full score.

Two passes read the texts: one counts the words that the benchmark uses, one
finds and aligns; neither shuffles a text. The benchmark goes to the tasks in
blocks of at most about `BLOCK_WORDS` words, one pass over the texts a block,
so its size is bounded too.

Cases: null texts are empty ones; empty texts and items match nothing; null and
repeated ids keep their rows (items with equal id and text count once); an item
of fewer than `LEAST` words has one seed, all its words; empty tables give an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rasterlake.llm.textkit import Words, buffers, gram_hashes, slices, span_hashes, words

#: Words of the longest and of the shortest seeds.
N, LEAST = 5, 2
#: Seeds of each length of an item none of whose windows is rare.
SPARE = 4
SIMILARITY = 0.4
EXPECTED = 1.0
#: Words of the benchmark in one pass.
BLOCK_WORDS = 2_000_000
#: Agreeing words; the score of one; the cost of a changed, added or missing word.
MATCH, EDIT, GAP = 2, 1, 1
#: The full score of longer items is that of so many words, so that a long item's part counts as a copy.
LONGEST = 60

_MARKS = np.ones(256, bool)
_MARKS[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = False


def plain_words(strings: pa.Array) -> tuple[Words, np.ndarray]:
    """Words of lower-case letters and digits, and their hashes."""
    w = words(*buffers(pc.utf8_lower(pc.fill_null(strings, ""))), spaces=_MARKS)
    return w, span_hashes(w.data, w.starts, w.ends)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The best local score, and the word of text at which it ends."""
    at = GAP * np.arange(len(text) + 1)
    row, best, end = np.zeros(len(text) + 1, np.int64), 0, 0
    for x in item:
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(text == x, MATCH, -EDIT), row[1:] - GAP)
        # A run of added words costs one gap each: the best start of such a run, by a running maximum.
        row = np.maximum(np.maximum.accumulate(new + at) - at, 0)
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


@dataclass
class Block:
    """Test items with their seeds, by ascending seed hash."""

    ids: list
    words: list[np.ndarray]
    seed: np.ndarray
    item: np.ndarray
    place: np.ndarray
    lengths: np.ndarray

    def pairs(self, w: Words, hashes: np.ndarray, similarity: float) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, item, similarity, first word, end) of every match."""
        hits = []
        for n in self.lengths:
            grams, first, _ = gram_hashes(hashes, w.bounds, int(n), short=False)
            at = np.searchsorted(self.seed, grams)
            found = np.flatnonzero((at < len(self.seed)) & (self.seed[np.minimum(at, len(self.seed) - 1)] == grams))
            if not len(found):
                continue
            to = np.searchsorted(self.seed, grams[found], side="right")
            count = to - at[found]
            which = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at[found], count)
            where = np.repeat(first[found], count)
            hits.append((np.searchsorted(w.bounds, where, side="right") - 1, self.item[which], where - self.place[which]))
        if not hits:
            return
        doc, item, diagonal = (np.concatenate(x) for x in zip(*hits, strict=True))
        order = np.lexsort((diagonal, item, doc))
        doc, item, diagonal = doc[order], item[order], diagonal[order]
        size = np.array([len(x) for x in self.words])[item]
        # Seeds of one copy lie on close diagonals; a new copy begins where they part by more than the item.
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > size[1:])
        starts = np.flatnonzero(new)
        for a, b in zip(starts, np.append(starts[1:], len(doc)), strict=True):
            d, i, own = int(doc[a]), int(item[a]), self.words[item[a]]
            slack = len(own) // 2 + N
            low = max(int(diagonal[a]) - slack, int(w.bounds[d]))
            high = min(int(diagonal[b - 1]) + len(own) + slack, int(w.bounds[d + 1]))
            full, base, rest = min(len(own), LONGEST), int(w.bounds[d]), [(low, high)]
            while rest:
                low, high = rest.pop()
                # So few words cannot reach the limit.
                if high - low < similarity * full:
                    continue
                text = hashes[low:high]
                best, end = align(own, text)
                got = best / (MATCH * full)
                if got >= similarity:
                    back = align(own[::-1], text[:end][::-1])[1]
                    yield d, i, min(got, 1.0), low - base + end - back, low - base + end
                    # Copies may follow each other: what lies before and behind this one is aligned again.
                    rest += [(low, low + end - back), (low + end, high)]


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()


def word_counts(docs: DataFrame, wanted: np.ndarray) -> tuple[dict[int, int], int]:
    """How often each wanted word (ascending hashes) occurs in all texts, and the number of all words."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(len(wanted) + 1, np.int64), 0
        for batch in batches:
            for part in slices(batch):
                _, h = plain_words(part.column("text"))
                at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                seen += np.bincount(np.where(wanted[at] == h, at, len(wanted)), minlength=len(wanted) + 1)
                total += len(h)
        some = np.flatnonzero(seen[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(seen[some], total))], names=["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in rows}
    total = found.pop(-1, 0)
    return {int(wanted[k]): n for k, n in found.items()}, total


def block_of(docs: DataFrame, rows: list, n: int = N, expected: float = EXPECTED) -> Block | None:
    """Seeds of these items, rare by the word counts of docs."""
    w, hashes = plain_words(pa.array([r["text"] for r in rows], pa.string()))
    if not len(hashes):
        return None
    known, total = word_counts(docs, np.unique(hashes))
    # Half a word for one that the corpus lacks.
    cost = np.log(np.array([max(known.get(int(h), 0), 0.5) for h in hashes]) / max(total, 1))
    seeds, items, places, lengths = [], [], [], set()
    for k in range(len(rows)):
        a, b = int(w.bounds[k]), int(w.bounds[k + 1])
        own, open_at, spare = np.array([0, b - a]), np.ones(b - a, bool), []
        for size in range(min(LEAST, n, b - a), min(n, b - a) + 1):
            if not size:
                continue
            grams, first, _ = gram_hashes(hashes[a:b], own, size, short=False)
            chance = np.array([cost[a + f : a + f + size].sum() for f in first]) + np.log(max(total, 1))
            rare = np.flatnonzero((chance <= np.log(expected)) & open_at[first])
            open_at[first[rare]] = False
            spare.append((size, grams, first, np.argsort(chance, kind="stable")[:SPARE]))
            if len(rare):
                seeds.append(grams[rare])
                items.append(np.full(len(rare), k))
                places.append(first[rare])
                lengths.add(size)
        if open_at.all():
            for size, grams, first, some in spare:
                seeds.append(grams[some])
                items.append(np.full(len(some), k))
                places.append(first[some])
                lengths.add(size)
    if not seeds:
        return None
    seed, item, place = np.concatenate(seeds), np.concatenate(items), np.concatenate(places)
    order = np.argsort(seed, kind="stable")
    each = [hashes[a:b] for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
    return Block([r["item_id"] for r in rows], each, seed[order], item[order], place[order], np.array(sorted(lengths)))


def blocks(docs: DataFrame, benchmark: DataFrame, n: int = N) -> Iterator[Block]:
    items = _items(benchmark)
    size = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    parts = -(-size // BLOCK_WORDS) or 1
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").collect()
        block = block_of(docs, rows, n)
        if block is not None:
            yield block


def find(docs: DataFrame, benchmark: DataFrame, n: int = N, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, similarity, first_word, end_word of every aligned copy of an item in a document."""
    doc, item = docs.schema["doc_id"], benchmark.schema["item_id"]
    schema = T.StructType([doc, item, T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType())])
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(docs, benchmark, n):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            own = held.value
            for batch in batches:
                for part in slices(batch):
                    got = list(own.pairs(*plain_words(part.column("text")), similarity))
                    if got:
                        d, i, s, a, b = zip(*got, strict=True)
                        ids = pa.array([own.ids[k] for k in i], to_arrow_type(item.dataType))
                        yield pa.RecordBatch.from_arrays(
                            [part.column("doc_id").take(pa.array(d)), ids, pa.array(s, pa.float64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=schema.names)

        out = out.union(docs.select("doc_id", "text").mapInArrow(scan, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, n: int = N, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, with all columns, that hold no copy of an item."""
    for block in list(blocks(docs, benchmark, n)):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            own = held.value
            for batch in batches:
                for part in slices(batch):
                    drop = np.zeros(part.num_rows, bool)
                    drop[[d for d, *_ in own.pairs(*plain_words(part.column("text")), similarity)]] = True
                    yield part.filter(pa.array(~drop))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
