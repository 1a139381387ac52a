"""Near-duplicate join on word n-grams: MinHash bands find pairs, full n-gram sets verify them.

1. Every text is read once: its digest and one hash per band, each over `rows`
   MinHash values of its n-gram set. Equal texts are one node from here on.
2. A shuffle on (band, hash) finds the buckets with two texts or more. Buckets
   with the same members keep the one of the lowest band.
3. The texts in such buckets are read once more for their full n-gram sets,
   which go to their buckets. A bucket of more than `BLOCK` texts is cut into
   blocks, and every pair of blocks is one bounded group. A group counts
   the links of each text and leaves one row per text: no pair becomes a row.
   A pair counts where it first agrees, so each is verified once.
4. Connected components of the links are the classes.

Bands and rows come from the similarity and the recall asked for. A text of
fewer than n words has one n-gram, all its words.

Cases: a null text is an empty one; empty texts have no n-gram and are copies of
each other; null and repeated doc_ids keep their rows, and a class is named by its
least id. Where it has none, or where that id already names a class (of lesser
digest), its name comes from its digest: a negative number, or the digest in
hexadecimal digits if ids are no integers. An empty table gives an empty result;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlake.llm.components import components
from rasterlake.llm.textexpr import digest, fresh
from rasterlake.llm.textkit import buffers, gram_hashes, mix, slices, span_hashes, unique_per_doc, words
from rasterlake.session import work_dir

if TYPE_CHECKING:
    import pandas as pd

#: Most texts of one side of a group.
BLOCK = 1024
#: Columns of the incidence matrix at once.
_STRIP = 1024


def bands_for(similarity: float, recall: float, most: int = 40) -> tuple[int, int]:
    """(bands, rows) with the most rows, so the fewest false pairs, among plans of at most 3 * most hashes that reach the recall."""
    best = (most, 1)
    for rows in range(1, 13):
        hit = similarity**rows
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - hit))) if hit < 1 else 1
        if bands <= most and bands * rows <= 3 * most:
            best = (bands, rows)
    return best


def gram_sets(strings: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of every string, and their bounds."""
    data, offsets = buffers(strings)
    w = words(data, offsets)
    grams, _, bounds = gram_hashes(span_hashes(data, w.starts, w.ends), w.bounds, n)
    return unique_per_doc(grams, bounds)


def band_hashes(grams: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One row of band hashes per text; rows of texts without n-grams mean nothing."""
    out = np.zeros((len(bounds) - 1, bands), np.uint64)
    some = np.flatnonzero(np.diff(bounds))
    if not len(some):
        return out
    starts = bounds[some]
    rng = np.random.Generator(np.random.PCG64(7))
    keys = rng.integers(1, 1 << 63, (bands, rows), dtype=np.uint64)
    for b in range(bands):
        h = np.full(len(some), b + 1, np.uint64)
        for r in range(rows):
            # Multiplication and one fold of bits already well mixed: an order of its own for each row.
            x = (grams ^ keys[b, r]) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(32)
            h = mix(h + np.minimum.reduceat(x * np.uint64(0xD6E8FEB86659FD93), starts))
        out[some, b] = h
    return out


def _digests(strings: pa.Array) -> list[bytes]:
    """As textexpr.digest."""
    data, at = buffers(strings)
    raw = memoryview(data)
    return [hashlib.sha256(raw[a:b]).digest()[:16] for a, b in zip(at[:-1], at[1:], strict=True)]


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, node (digest of the text), bands (null without n-grams) of every row."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                node = _digests(part.column("text"))
                first: dict[bytes, int] = {}
                for i, d in enumerate(node):
                    first.setdefault(d, i)
                at = list(first.values())
                grams, bounds = gram_sets(part.column("text").take(pa.array(at)), n)
                hashes = band_hashes(grams, bounds, bands, rows).view(np.int64)
                place = {d: k for k, d in enumerate(first)}
                row = np.array([place[d] for d in node])
                empty = (np.diff(bounds) == 0)[row]
                flat = pa.array(hashes[row].ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * bands), flat, mask=pa.array(empty))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(node, pa.binary()), lists], names=["doc_id", "node", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(sign, f"doc_id {kind}, node binary, bands array<bigint>")


def _links(left: list[int], right: list[int], sets: list[np.ndarray], bands: np.ndarray, weight: np.ndarray, band: int, similarity: float):
    """Which of left x right are linked, as a matrix; a pair that agrees in an earlier band is left to it."""
    own = left + right if right is not left else left
    size = np.array([len(sets[i]) for i in own])
    flat = np.concatenate([sets[i] for i in own])
    grams, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(own)), size)
    shared = count[inverse] > 1
    row, column = row[shared], (np.cumsum(count > 1) - 1)[inverse[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(left), len(own) - len(left) if right is not left else len(left)), np.float32)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, _STRIP):
        a, b = np.searchsorted(column, [c, c + _STRIP])
        m = np.zeros((len(own), _STRIP), np.float32)
        m[row[a:b], column[a:b] - c] = 1
        common += m[: len(left)] @ (m[len(left) :] if right is not left else m).T
    sl, sr = size[: len(left)], size[len(left) :] if right is not left else size
    both = (sl[:, None] + sr[None, :]).astype(np.float64)
    ok = common.astype(np.float64) * (1 + similarity) >= similarity * both - 1e-6
    for j in range(band):
        ok &= bands[left, j][:, None] != bands[right, j][None, :]
    return ok & (bands[left, band][:, None] == bands[right, band][None, :])


def _forest(ok: np.ndarray) -> np.ndarray:
    """The least index of each one's component in a symmetric matrix."""
    label = np.arange(len(ok), dtype=np.int32)
    while True:
        new = np.minimum(label, np.where(ok, label[None, :], np.int32(len(ok))).min(axis=1, initial=len(ok)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _group(g: pd.DataFrame, similarity: float) -> pd.DataFrame | None:
    """Links of one group: a bucket, or two blocks of one."""
    import pandas as pd

    band, i, j = int(g["band"].iloc[0]), int(g["i"].iloc[0]), int(g["j"].iloc[0])
    block = g["block"].to_numpy()
    sets, weight = list(g["grams"]), g["n"].to_numpy()
    bands = np.stack(list(g["bands"]))
    left = np.flatnonzero(block == i).tolist()
    right = left if i == j else np.flatnonzero(block == j).tolist()
    if not left or not right:
        return None
    part = _links(left, right, sets, bands, weight, band, similarity)
    if right is left:
        np.fill_diagonal(part, False)
        links, copies, root = part.sum(1), part @ weight[left], _forest(part)
        own = left
    else:
        whole = np.zeros((len(left) + len(right),) * 2, bool)
        whole[: len(left), len(left) :] = part
        whole[len(left) :, : len(left)] = part.T
        own = left + right
        links, copies, root = whole.sum(1), whole @ weight[own], _forest(whole)
    node = g["node"].to_numpy()[own]
    some = links > 0
    return pd.DataFrame({"node": node[some], "texts": links[some], "links": copies[some], "peer": node[root[some]]}) if some.any() else None


def _verify(similarity: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups follow each other in the sorted partition; one that a batch cuts is carried on."""
        import pandas as pd

        key, kept = ["band", "hash", "i", "j"], None
        for frame in frames:
            frame = frame if kept is None else pd.concat([kept, frame], ignore_index=True)
            new = (frame[key] != frame[key].shift()).any(axis=1).to_numpy()
            starts = np.flatnonzero(new)
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if (out := _group(frame.iloc[a:b], similarity)) is not None:
                    yield out
            kept = frame.iloc[starts[-1] :] if len(starts) else None
        if kept is not None and (out := _group(kept, similarity)) is not None:
            yield out

    return run


def buckets(signed: DataFrame) -> DataFrame:
    """band, hash, node, size: members of the buckets of two texts or more, one bucket for each set of members."""
    rows = signed.where("bands is not null").select("node", F.posexplode("bands").alias("band", "hash")).distinct()
    held = (
        rows.groupBy("band", "hash").agg(
            F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("members"), F.min("node").alias("least"))
        .where("size > 1")
    )
    one = held.groupBy("size", "members", "least").agg(F.min(F.struct("band", "hash")).alias("b")).select("b.band", "b.hash", "size")
    return rows.join(one, ["band", "hash"])


def links(docs: DataFrame, signed: DataFrame, n: int, similarity: float, bands: int, rows: int) -> DataFrame:
    """node, texts, links, peer: partial counts of links to other texts and to their documents, and edges that join all linked texts."""
    spark = docs.sparkSession
    path = work_dir(spark, "members")
    buckets(signed).write.parquet(path)
    members = spark.read.parquet(path)
    wanted = members.select("node").distinct()
    size = signed.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"))
    # One row of each wanted text: that of the least id; several rows of one id are told apart by the digest.
    chosen = wanted.join(size, "node")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                grams, bounds = gram_sets(part.column("text"), n)
                hashes = band_hashes(grams, bounds, bands, rows).view(np.int64)
                at = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * bands)
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("n"), pa.ListArray.from_arrays(at, pa.array(hashes.ravel())),
                     pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(grams.view(np.int64)))],
                    names=["node", "n", "bands", "grams"])

    texts = (
        docs.select(F.col("doc_id").alias("_id"), "text", digest(F.col("text")).alias("_node"))
        .join(chosen, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_node") == F.col("node")))
        .select("node", "n", "text").mapInArrow(read, "node binary, n bigint, bands array<bigint>, grams array<bigint>")
    )
    path = work_dir(spark, "sets")
    texts.write.parquet(path)
    texts = spark.read.parquet(path).dropDuplicates(["node"])
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    groups = (
        members.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
        .join(texts, "node")
        .select("band", "hash", "i", "j", "block", "node", "n", "bands", "grams")
    )
    return (
        groups.repartition("band", "hash", "i", "j").sortWithinPartitions("band", "hash", "i", "j")
        .mapInPandas(_verify(similarity), "node binary, texts bigint, links bigint, peer binary")
    )


def _names(roots: DataFrame) -> DataFrame:
    """root, class_id of every root (columns root, least): the least id where it names no class of lesser root, else a name from the root."""
    kind = roots.schema["least"].dataType
    first = roots.groupBy("least").agg(F.min("root").alias("first"))
    free = F.col("least").isNotNull() & (F.col("root") == F.col("first"))
    if isinstance(kind, T.IntegralType):
        own, least = -F.pmod(F.xxhash64("root"), F.lit(1 << 62)) - 2, F.col("least").cast("long")
    else:
        own, least = F.lower(F.hex("root")), F.col("least").cast("string")
    return roots.join(first, "least", "left").select("root", F.when(free, least).otherwise(own).alias("class_id"))


def classes(docs: DataFrame, n: int = 5, similarity: float = 0.8, recall: float = 0.999) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of every row, and (node, class_id, root, n_links, n_texts, n_copies) of every different text."""
    spark = docs.sparkSession
    bands, rows = bands_for(similarity, recall)
    path = work_dir(spark, "signatures")
    signatures(docs, n, bands, rows).write.parquet(path)
    signed = spark.read.parquet(path)
    path = work_dir(spark, "links")
    links(docs, signed, n, similarity, bands, rows).write.parquet(path)
    linked = spark.read.parquet(path)
    roots = components(linked.select(F.col("node").alias("a"), F.col("peer").alias("b")))
    count = linked.groupBy("node").agg(F.sum("texts").alias("n_texts"), F.sum("links").alias("others"))
    texts = (
        signed.groupBy("node").agg(F.count(F.lit(1)).alias("n_copies"), F.min("doc_id").alias("least"))
        .join(roots, "node", "left").join(count, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    named = _names(texts.groupBy("root").agg(F.min("least").alias("least")))
    texts = texts.join(named, "root").select(
        "node", "root", "class_id", "least", "n_copies", F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_texts"),
        (F.coalesce("others", F.lit(0)) + F.col("n_copies") - 1).cast("long").alias("n_links"))
    return signed.select("doc_id", "node"), texts


def join(docs: DataFrame, n: int = 5, similarity: float = 0.8, recall: float = 0.999) -> DataFrame:
    """One row per row of docs: doc_id, class_id (least id of its class), n_copies (documents with its text, itself
    included), n_links (other documents whose n-gram sets are similar, copies included), n_texts (similar other texts)."""
    signed, texts = classes(docs, n, similarity, recall)
    return signed.join(texts, "node").select("doc_id", "class_id", "n_links", "n_texts", "n_copies")


def one_of_each(docs: DataFrame, n: int = 5, similarity: float = 0.8, recall: float = 0.999) -> DataFrame:
    """One row of docs, all columns, of each class: of its least doc_id, and among rows of that id, of the least digest."""
    _, texts = classes(docs, n, similarity, recall)
    first = texts.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node")).alias("k"))
    own_id, own_node, node = fresh(docs.columns, "own_id", "own_node", "node")
    first = first.select(F.col("k.least").alias(own_id), F.col("k.node").alias(own_node))
    signed = docs.withColumn(node, digest(F.col("text")))
    found = signed.join(first, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(node) == F.col(own_node)))
    return found.dropDuplicates([own_node]).select(*docs.columns)
