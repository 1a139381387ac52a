"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks.

A text is a bag of units: its words in lower case; a row of single letters that
stand alone ("i d i o t") is one unit, and a unit of more than `LONGEST` signs
is cut into overlapping ones. The kernel of two units sums over all
subsequences of three letters, each weighted by DECAY**span in both, so that
letters with others between them still count; signs that are no letters
take up room and match nothing. It is normalised by the units' own kernels and
raised to `POWER`, so that only close forms count.

A text's kernel with a landmark unit is that of its closest unit. The landmarks
are units of labelled texts: those most tied to either label, none too close to
another, and some usual ones. The inverse root of the landmarks' kernel matrix
(the Nyström map) makes these values features of a linear machine with squared
hinge loss, fitted by Newton steps; a logistic curve turns its margin into a
score, with 0.5 at the margin that divides the training rows best.

Fitting takes a bounded sample: at most `SAMPLE` labelled rows of each label,
those of the least hash of their id. Scoring reads every text once and shuffles
nothing; the model is as large as the landmarks.

Cases: a null text is an empty one; a text without units has the score of no
resemblance at all; null labels and labels of no document are left out; repeated
ids keep their rows and count in the sample once per row; a null doc_id
is scored and never trained on; with labels of one kind or none, every
score is that share; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlake.llm.textkit import buffers, slices, span_hashes, words

SAMPLE = 3000
LANDMARKS = 96
DECAY = 0.7
REACH = 7
POWER = 4
LONGEST = 24
#: Kernel values (before the power) under this are taken as none.
FLOOR = 0.3
#: Landmarks are at most so close to each other.
APART = 0.9
_SYMBOLS = 32
_ROWS = _SYMBOLS**3
_KEPT_UNITS = 2_000_000


def units(strings: pa.Array):
    """Words of lower-case texts, single letters that follow each other as one; and their hashes."""
    data, offsets = buffers(pc.utf8_lower(pc.fill_null(strings, "")))
    w = words(data, offsets)
    single = w.ends - w.starts == 1
    joined = np.zeros(len(single), bool)
    joined[1:] = single[1:] & single[:-1]
    joined[w.bounds[:-1][w.bounds[:-1] < len(joined)]] = False
    keep = np.flatnonzero(~joined)
    ends = w.ends[np.append(keep[1:], len(joined)) - 1] if len(keep) else w.ends[:0]
    w.bounds = np.searchsorted(keep, w.bounds)
    w.starts, w.ends = w.starts[keep], ends
    return w, span_hashes(w.data, w.starts, w.ends)


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts as 0 to 31, other signs as -1; and where each begins. Letters beyond a-z share six symbols."""
    code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    sym = np.where((code >= 97) & (code <= 122), code - 97, np.where(code < 128, -1, 26 + code % 6))
    return sym, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _pieces(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Texts of at most LONGEST signs, and which text each is of."""
    out, of = [], []
    for i, t in enumerate(texts):
        if len(t) <= LONGEST:
            out.append(t)
            of.append(i)
        else:
            for a in range(0, len(t) - LONGEST // 2, LONGEST // 2):
                out.append(t[a : a + LONGEST])
                of.append(i)
    return out, np.array(of, np.int64)


def subsequences(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, subsequence, weight), each pair once: the feature vectors of the kernel."""
    sym, bounds = _symbols(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    key, weight = [], []
    for b in range(2, REACH):
        if len(sym) <= b:
            break
        n = len(sym) - b
        whole = (owner[:n] == owner[b:]) & (sym[:n] >= 0) & (sym[b:] >= 0)
        for a in range(1, b):
            at = np.flatnonzero(whole & (sym[a : a + n] >= 0))
            key.append(owner[at] * _ROWS + (sym[at] * _SYMBOLS + sym[at + a]) * _SYMBOLS + sym[at + b])
            weight.append(np.full(len(at), DECAY ** (b + 1)))
    if not key:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    key, weight = np.concatenate(key), np.concatenate(weight)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first] // _ROWS, key[first] % _ROWS, np.add.reduceat(weight, first) if len(first) else weight


def _own(text: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    return np.sqrt(np.bincount(text, weight**2, minlength=n))


@dataclass
class Landmarks:
    """The normalised feature vectors of the landmark units, as columns."""

    names: list[str]
    table: np.ndarray = field(init=False)

    def __post_init__(self):
        text, row, weight = subsequences(self.names)
        own = _own(text, weight, len(self.names))
        self.table = np.zeros((_ROWS, len(self.names)), np.float32)
        self.table[row, text] = weight / own[text]

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Normalised kernel of each text with each landmark: of its closest piece, under FLOOR 0, else to the power."""
        out = np.zeros((len(texts), len(self.names)), np.float32)
        pieces, of = _pieces(texts)
        for a in range(0, len(pieces), 2000):
            part = pieces[a : a + 2000]
            text, row, weight = subsequences(part)
            if not len(text):
                continue
            own = _own(text, weight, len(part))
            first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            got = np.add.reduceat(self.table[row] * (weight / own[text]).astype(np.float32)[:, None], first)
            got = np.where(got >= FLOOR, np.minimum(got, 1), 0) ** POWER
            np.maximum.at(out, of[a + text[first]], got)
        return out


@dataclass
class Model:
    landmarks: Landmarks
    weights: np.ndarray  # of the kernel values: the Nyström map is folded in
    bias: float
    slope: float

    def margins(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.weights + self.bias

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(-self.slope * self.margins(pooled), -700, 700)))


class Pooler:
    """Kernel values of whole texts; keeps those of units it has met."""

    def __init__(self, landmarks: Landmarks):
        self.landmarks = landmarks
        self._forget()

    def _forget(self):
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.values = np.zeros((0, len(self.landmarks.names)), np.float32)

    def pool(self, strings: pa.Array) -> np.ndarray:
        w, h = units(strings)
        if len(self.keys) > _KEPT_UNITS:
            self._forget()
        new, where = np.unique(h, return_index=True)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, new), len(self.keys) - 1)
            fresh = self.keys[at] != new
            new, where = new[fresh], where[fresh]
        if len(new):
            got = self.landmarks.kernel([w.text(i) for i in where])
            some = got.any(axis=1)
            slot = np.where(some, len(self.values) + np.cumsum(some) - 1, -1)
            self.values = np.concatenate([self.values, got[some]])
            keys = np.concatenate([self.keys, new])
            order = np.argsort(keys, kind="stable")
            self.keys, self.slot = keys[order], np.concatenate([self.slot, slot])[order]
        out = np.zeros((len(w.bounds) - 1, len(self.landmarks.names)), np.float32)
        if len(h):
            slot = self.slot[np.searchsorted(self.keys, h)]
            near = np.flatnonzero(slot >= 0)
            doc, slot = w.doc[near], slot[near]
            for a in range(0, len(doc), 100_000):
                d = doc[a : a + 100_000]
                first = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
                top = np.maximum.reduceat(self.values[slot[a : a + 100_000]], first)
                out[d[first]] = np.maximum(out[d[first]], top)
        return out


def held_out(folds: int = 5, fold: int = 0) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(folds)) == fold


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """doc_id, text, toxic of at most so many training documents of each label, by the least hash of the id."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for label in (0, 1):
        some = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen = some if chosen is None else chosen.union(some)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * rows ids


def choose(docs: DataFrame, n: int = LANDMARKS) -> list[str]:
    """Landmark units of a sample: by how unevenly the labels' documents hold them; the last sixth by how many hold them."""
    kinds = docs.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    total = {r["toxic"]: r["n"] for r in kinds}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w, h = units(part.column("text"))
                key = np.lexsort((h, w.doc))
                doc, hash_ = w.doc[key], h[key]
                first = key[np.append(True, (doc[1:] != doc[:-1]) | (hash_[1:] != hash_[:-1]))] if len(key) else key
                text = [w.text(i) for i in first]
                yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), part.column("toxic").take(pa.array(w.doc[first]))], names=["unit", "toxic"])

    held = docs.select("text", "toxic").mapInArrow(each, T.StructType([T.StructField("unit", T.StringType()), docs.schema["toxic"]]))
    by_unit = held.groupBy("unit").agg(F.sum(F.col("toxic").cast("long")).alias("t"), F.sum(1 - F.col("toxic").cast("long")).alias("c"))
    by_unit = by_unit.where(F.length("unit").between(3, LONGEST) & (F.regexp_count("unit", F.lit(r"\p{L}")) >= 3))
    toxic, clean = max(total.get(1, 0), 1), max(total.get(0, 0), 1)
    tied = F.col("t") * F.log((F.col("t") + 0.5) / (toxic + 1) / ((F.col("c") + 0.5) / (clean + 1)))
    usual = [r["unit"] for r in by_unit.orderBy(F.desc(F.col("t") + F.col("c")), "unit").limit(n).collect()]
    strong = [r["unit"] for r in by_unit.where(tied > 0).orderBy(F.desc(tied), "unit").limit(20 * n).collect()]
    chosen: list[str] = []
    for names, most in ((strong, n - n // 6), (usual, n)):
        for name in names:
            if len(chosen) >= most:
                break
            text, row, weight = subsequences([name])
            if not len(row):
                continue
            if chosen:
                close = Landmarks(chosen).table[row].T @ (weight / np.sqrt((weight**2).sum()))
                if close.max() > APART:
                    continue
            chosen.append(name)
    return chosen


def fit(pooled: np.ndarray, toxic: np.ndarray, landmarks: Landmarks, ridge: float = 1.0) -> Model:
    """A linear machine with squared hinge loss on the Nyström features of pooled kernel values."""
    y = np.where(toxic == 1, 1.0, -1.0)
    if not len(y) or abs(y.sum()) == len(y):
        share = np.clip(((y > 0).sum() + 0.5) / (len(y) + 1), 1e-3, 1 - 1e-3) if len(y) else 0.25
        return Model(landmarks, np.zeros(len(landmarks.names)), float(np.log(share / (1 - share))), 1.0)
    k = landmarks.kernel(landmarks.names).astype(float)
    value, vector = np.linalg.eigh((k + k.T) / 2)
    root = vector / np.sqrt(np.maximum(value, 1e-3)) @ vector.T
    x = np.hstack([pooled @ root, np.ones((len(y), 1))])
    cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    w, reg = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    reg[-1, -1] = 1e-6
    for _ in range(50):
        inside = y * (x @ w) < 1
        a = x[inside] * cost[inside, None]
        new = np.linalg.solve(reg + a.T @ x[inside], a.T @ y[inside])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    margin = x @ w
    # The margin that leaves the fewest weighted errors divides the labels.
    order = np.argsort(margin)
    wrong = (y > 0).sum() * 0 + np.concatenate([[0], np.cumsum(y[order] > 0)]) + np.concatenate([np.cumsum((y[order] < 0)[::-1])[::-1], [0]])
    best = np.flatnonzero(wrong == wrong.min())
    cut = int(best[len(best) // 2])
    low, high = margin[order][max(cut - 1, 0)], margin[order][min(cut, len(y) - 1)]
    return Model(landmarks, root @ w[:-1], float(w[-1] - (low + high) / 2), 3.0)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, n: int = LANDMARKS) -> Model:
    """A model of a bounded sample of the training documents."""
    chosen = sample(docs, labels, rows).persist()
    try:
        landmarks = Landmarks(choose(chosen, n) or ["aaa"])

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pooler = Pooler(landmarks)
            for batch in batches:
                for part in slices(batch):
                    got = pooler.pool(part.column("text")).astype(np.float32)
                    flat = pa.FixedSizeListArray.from_arrays(pa.array(got.ravel()), got.shape[1]).cast(pa.list_(pa.float32()))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), flat], names=["doc_id", "toxic", "x"])

        schema = T.StructType([chosen.schema["doc_id"], chosen.schema["toxic"], T.StructField("x", T.ArrayType(T.FloatType()))])
        rows_ = chosen.mapInArrow(each, schema).orderBy("doc_id").toPandas()  # at most 2 * rows
    finally:
        chosen.unpersist()
    x = np.stack(list(rows_["x"])).astype(float) if len(rows_) else np.zeros((0, len(landmarks.names)))
    return fit(x, rows_["toxic"].to_numpy(), landmarks)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    doc_id = docs.schema["doc_id"]
    schema = T.StructType([doc_id, T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        pooler = Pooler(own.landmarks)
        for batch in batches:
            for part in slices(batch):
                got = own.scores(pooler.pool(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], names=schema.names)

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(each, schema)
