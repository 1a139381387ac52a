"""Vector compression by product codes, with memoised grid cells in place of full searches.

Components become integers, vectors are cut into equal parts, and every part
position has a codebook of a few entries, moved for some rounds to the means of
what they won. The search for the nearest entry goes through a coarse grid: a
part falls into the cell of its components divided by `cell`. For a cell seen
first, the least and greatest squared distance from its box to each entry are
worked out; an entry whose least distance exceeds another one's greatest can win
nowhere in the box. The remaining entries of the cell are kept in a table, and
only those are evaluated exactly. So the result is that of a full search, ties
to the lower index. A task keeps at most `HELD_CELLS` cells, then begins anew.

A round is one pass over the integers. A task sends one sum and count per part,
entry and component, whatever its rows; the codebooks, which are all that reaches
the driver, have `parts * entries` vectors of a part's length.

Cases: rows whose vector is null or empty, or holds a null, a non-finite component
or one of 4096 or more (its squares would not fit), are dropped. The vector of the
least vec_id (nulls last, then the least vector) sets the length; other lengths are dropped,
and all rows if the parts do not divide it. With fewer rows than entries the
codebooks are smaller. Null and repeated vec_ids keep their rows; null labels
are one label; a label's error that exceeds a long is null. An empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlake.operators.skew import attach
from rasterlake.session import work_dir

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Side of a grid cell in scaled units.
CELL = 256
#: Intervals of a component that tables hold.
SIDES = 256
HELD_CELLS = 1 << 16
#: Components from here on are out of range: squares of their differences, summed over 4,096 of them, would exceed a long.
LIMIT = 4096.0


@dataclass(frozen=True)
class Codebooks:
    """entries[part, index, component]."""

    entries: np.ndarray

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v: whole components of the rows that can be coded."""
    usable = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < LIMIT)
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", usable)).select(
        "vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v"))


class Cells:
    """Which entries can be nearest somewhere in a cell, remembered by cell.

    Squared distances add up over components, so the bounds of a cell are sums of one-dimensional ones, which
    a table holds for the `SIDES` intervals around 0. Cells beyond them are worked out one by one.
    """

    def __init__(self, entries: np.ndarray, cell: int) -> None:
        self.entries, self.cell = entries, cell
        self.evaluated = 0
        self._forget()
        size = entries.shape[1]
        self.packs = size <= 8
        near, far = self._intervals(np.repeat(np.arange(-SIDES // 2, SIDES // 2)[:, None], size, 1))
        self.near, self.far = near.transpose(2, 0, 1).copy(), far.transpose(2, 0, 1).copy()

    def _forget(self) -> None:
        self.known: dict = {}
        self.marks = np.zeros((1024, len(self.entries)), bool)

    def _intervals(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest squared distance of each component (cell, entry, component)."""
        low = cells[:, None, :].astype(np.int64) * self.cell
        high = low + self.cell - 1
        e = self.entries[None]
        near = np.maximum(np.maximum(low - e, e - high), 0)
        far = np.maximum(np.abs(e - low), np.abs(e - high))
        return near * near, far * far

    def _bounds(self, cells: np.ndarray, inside: bool) -> np.ndarray:
        """One row a cell: may the entry win there?"""
        if inside:
            at, size = cells + SIDES // 2, range(cells.shape[1])
            near, far = sum(self.near[c, at[:, c]] for c in size), sum(self.far[c, at[:, c]] for c in size)
        else:
            near, far = (x.sum(2) for x in self._intervals(cells))
        return near <= far.min(1)[:, None]

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """Marks of the entries to evaluate, one row a part."""
        cells = np.ascontiguousarray(np.floor_divide(x, self.cell).astype(np.int32))
        inside = bool((cells >= -SIDES // 2).all() and (cells < SIDES // 2).all())
        if inside and self.packs:
            # A byte a component: the key is the cell itself.
            keys = np.zeros((len(cells), 8), np.uint8)
            keys[:, : cells.shape[1]] = cells + SIDES // 2
            keys = keys.view(np.uint64).ravel()
            unique, first, place = np.unique(keys, return_index=True, return_inverse=True)
            names = unique.tolist()
        else:
            keys = cells.view(np.dtype((np.void, cells.shape[1] * 4))).ravel()
            _, first, place = np.unique(keys, return_index=True, return_inverse=True)
            names = [keys[i].tobytes() for i in first]
        if len(self.known) + len(names) > HELD_CELLS:
            self._forget()
        new = [i for i, n in enumerate(names) if n not in self.known]
        at = len(self.known)
        if at + len(new) > len(self.marks):
            self.marks = np.concatenate([self.marks, np.zeros((at + len(new), len(self.entries)), bool)])
        for i in range(0, len(new), 4096):
            some = new[i : i + 4096]
            self.marks[at + i : at + i + len(some)] = self._bounds(cells[first[some]], inside)
        self.known.update(zip([names[i] for i in new], range(at, at + len(new)), strict=True))
        return self.marks[np.fromiter((self.known[n] for n in names), np.int64, len(names))[place]]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each part."""
        best, code = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
        marks = self.candidates(x)
        self.evaluated += int(marks.sum())
        for k, entry in enumerate(self.entries):
            rows = np.flatnonzero(marks[:, k])
            d = x[rows] - entry
            d = (d * d).sum(1)
            won = d < best[rows]
            best[rows[won]], code[rows[won]] = d[won], k
        return code, best


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def _assigned(batches: Iterator[pa.RecordBatch], books: Codebooks, cell: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, vectors, codes, errors) with one column a part."""
    parts, _, size = books.entries.shape
    grids = [Cells(books.entries[p], cell) for p in range(parts)]
    for batch in batches:
        if not batch.num_rows:
            continue
        v = _matrix(batch.column("v"), parts * size)
        found = [g.nearest(v[:, p * size : (p + 1) * size]) for p, g in enumerate(grids)]
        yield batch, v, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _sums(books: Codebooks, cell: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, size = books.entries.shape
        total = np.zeros((parts, entries, size), np.int64)
        count = np.zeros((parts, entries), np.int64)
        for _, v, codes, _ in _assigned(batches, books, cell):
            for p in range(parts):
                np.add.at(total[p], codes[:, p], v[:, p * size : (p + 1) * size])
                count[p] += np.bincount(codes[:, p], minlength=entries)
        p, k = np.nonzero(count)
        if len(p):
            at = pa.array(np.arange(len(p) + 1, dtype=np.int32) * size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(p.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(count[p, k]),
                 pa.ListArray.from_arrays(at, pa.array(total[p, k].ravel()))],
                names=["part", "entry", "n", "total"])

    return run


def _moved(whole: DataFrame, books: Codebooks, cell: int) -> Codebooks:
    """Every entry at the mean of its parts, rounded down; one that won none stays."""
    sums = (
        whole.select("v").mapInArrow(_sums(books, cell), "part int, entry int, n bigint, total array<bigint>")
        .select("part", "entry", "n", F.posexplode("total").alias("at", "x"))
        .groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    )
    entries = books.entries.copy()
    for r in sums.collect():  # parts * entries * components of a part at most
        entries[r["part"], r["entry"], r["at"]] = int(r["x"]) // r["n"]
    return Codebooks(entries)


def train(whole: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, cell: int = CELL) -> Codebooks | None:
    """Codebooks for a table of integers(); None if no row can be coded."""
    first = whole.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    if not first or len(first[0]["v"]) % parts:
        return None
    length = len(first[0]["v"])
    whole = whole.where(F.size("v") == length)
    seeds = whole.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    start = np.array([r["v"] for r in seeds], np.int64).reshape(len(seeds), parts, length // parts)
    books = Codebooks(np.ascontiguousarray(start.transpose(1, 0, 2)))
    for _ in range(rounds):
        books = _moved(whole, books, cell)
    return books


def encode(whole: DataFrame, books: Codebooks, cell: int = CELL) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error of the rows of integers() that fit the codebooks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, codes, errors in _assigned(batches, books, cell):
            raw = codes.astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([row.tobytes().hex() for row in raw], pa.string()), pa.array(errors.sum(1))],
                names=["vec_id", "label", "code", "error"])

    parts, _, size = books.entries.shape
    schema = T.StructType([whole.schema["vec_id"], whole.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return whole.where(F.size("v") == parts * size).select("vec_id", "label", "v").mapInArrow(run, schema)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, cell: int = CELL) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    spark = vectors.sparkSession
    path = work_dir(spark, "integers")
    integers(vectors).write.parquet(path)
    whole = spark.read.parquet(path)
    books = train(whole, parts, entries, rounds, cell)
    if books is None:
        return whole.limit(0).select(
            "vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"),
            F.lit("").alias("codebooks_sha256"))
    path = work_dir(spark, "codes")
    encode(whole, books, cell).write.parquet(path)
    coded = spark.read.parquet(path).withColumn("of", F.coalesce(F.concat(F.lit("v"), F.col("label").cast("string")), F.lit("")))
    sums = coded.groupBy("of").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    return attach(coded, sums, ["of"], ["vec_id", "code"], count="n").select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same by full searches, for tables of unique vec_ids."""
    steps = [f"""
kept as materialized (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor(cast(x as double) * {SCALE}) as bigint)) v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (
  select vec_id, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] x from kept, range({parts}) t(p)),
book0 as materialized (
  select p, k, x c from (select p, x, row_number() over (partition by p order by vec_id) - 1 k from parts) where k < {entries})"""]
    for i in range(rounds + 1):
        steps.append(f"""
won{i} as materialized (
  select parts.vec_id, parts.p, any_value(x) x,
    min({{'e': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'k': k}}) m
  from parts join book{i} using (p) group by all)""")
        if i < rounds:
            steps.append(f"""
mean{i} as (
  select p, k, list(floor(s / n) order by pos) c from (
    select p, m.k k, pos, cast(sum(x[pos]) as double) s, count(*) n
    from won{i}, lateral (select unnest(range(1, len(x) + 1)) pos) group by all)
  group by p, k),
book{i + 1} as materialized (
  select b.p, b.k, coalesce(list_transform(m.c, lambda y: cast(y as bigint)), b.c) c from book{i} b left join mean{i} m on b.p = m.p and b.k = m.k)""")
    return "with " + ",".join(steps) + f""",
coded as (
  select vec_id, string_agg(printf('%02x', m.k), '' order by p) code, cast(sum(m.e) as bigint) error from won{rounds} group by vec_id)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) label_error,
  (select sha256(string_agg(array_to_string(c, ','), ',' order by p, k)) from book{rounds}) codebooks_sha256
from coded join kept using (vec_id)"""


SQL = _sql()
