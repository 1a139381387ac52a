"""Mixing sources to target weights: pivotal rounding of copy numbers, combined in a reduction tree.

A source's target is its share by weight of `share` times all words, at most
`most` times its own words; what a source cannot take is shared again by weight
among the others. A document should be taken target / source size times. The
whole part of that is sure, the rest is a probability, and pivotal rounding turns
the probabilities into zeros and ones: two documents meet, words move from one
to the other, at random in direction but even on average, until one of them
has probability 0 or 1; the other one meets the next. Words are what moves,
so a source's expected number of words never changes; only its last
open document is drawn on its own, and the words taken differ from the target by
less than that one document.

Documents of a source are dealt to leaves of about `LEAF` rows by a hash of id and
text. In a leaf all have one probability. So its longest document is paired with the
pool of all shorter ones, which move together: the document becomes 0 or 1 at once, the
pool takes up the difference, and then its own longest is next. What stays
open is the shortest document, or one that outweighs all shorter ones. The rests of `FAN`
leaves meet one by one on the next level, from long to short, up to one rest a source. A
task streams its sorted rows and holds a batch of them (a leaf that a batch cuts is several
pools, and the rest of one meets the next), and each level is written to the shared folder.

Draws are hashes of id, text, source, level and seed, so the same table gives the same mix
however it is split. Sources are ranked over range partitions, and targets need
single numbers on the driver.

Cases: a null or empty text has size 0: nothing is taken, its number of copies is
drawn on its own; a source without words has target 0; the null source is one
source, the last. Null and repeated doc_ids keep their rows; rows alike in id, text and
source are interchangeable and share a leaf. An empty table gives an empty result. Columns
other than doc_id, text and source are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.textexpr import fresh
from rasterlake.llm.textkit import mix as spread
from rasterlake.operators.ordered import range_ranks
from rasterlake.operators.skew import attach
from rasterlake.session import work_dir

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
SEED = 11
LEAF = 4096
FAN = 1024


def _kept(frame: DataFrame, purpose: str) -> DataFrame:
    path = work_dir(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def _key(seed: int):
    return F.xxhash64("doc_id", "text", "source", F.lit(seed))


def sizes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, key of every row."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), _key(seed).alias("key"))


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, n (rows), target of every source, null included."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    ranked = range_ranks(per, [F.col("source").asc_nulls_last()], "rank")
    weight = F.get(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights)).cast("int"))
    table = _kept(ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        # A source is full if its weight's part at this level is no less than its cap; more become full, never fewer.
        at = F.col("cap") <= F.col("weight") * level
        n, taken, free = table.agg(
            F.count_if(at), F.sum(F.when(at, F.col("cap")).otherwise(0.0)), F.sum(F.when(at, 0.0).otherwise(F.col("weight")))).first()
        if n == full or not free:
            break
        full, level = n, (total * share - taken) / free
    # With no free weight left, every source is full.
    target = F.col("cap") if not free else F.least(F.col("cap"), F.col("weight") * level)
    return table.select("source", "source_size", "n", target.alias("target"))


def _pool(p: list, size: list, draw: list, of: list) -> int:
    """Each group's longest open row against the pool of the rows behind it, which share one probability; the first row may have its own.

    The row that stays open in the last group, or its last one."""
    start, kept = 0, 0
    while start < len(p):
        end = start + 1
        while end < len(p) and of[end] == of[start]:
            end += 1
        rest, q, kept = sum(size[start:end]), p[min(start + 1, end - 1)], end - 1
        for a in range(start, end):
            s, own = size[a], p[a] if a == start else q
            rest -= s
            p[a] = own
            if rest <= 0:
                break
            if not 0.0 < own < 1.0:
                continue
            words, room, more, less = q * rest, (1.0 - q) * rest, (1.0 - own) * s, own * s
            up, down = min(more, words), min(less, room)
            if rise := draw[a] * (up + down) < down:
                p[a], q = (1.0, (words - more) / rest) if more <= words else (own + words / s, 0.0)
            else:
                p[a], q = (0.0, (words + less) / rest) if less <= room else (own - room / s, 1.0)
            q = min(max(q, 0.0), 1.0)
            if (more > words) if rise else (less > room):
                # The pool has ended before the document.
                p[a + 1 : end] = [q] * (end - a - 1)
                kept = a
                break
        start = end
    return kept


def _pairs(p: list, size: list, draw: list, of: list) -> int:
    """Rows of a group against each other in their order, whoever stays open against the next; the row that stays open at the end."""
    a = 0
    for b in range(1, len(p)):
        if of[b] != of[a] or not 0.0 < p[a] < 1.0:
            a = b
            continue
        sa, sb, own, other = size[a], size[b], p[a], p[b]
        up, down = min((1.0 - own) * sa, other * sb), min(own * sa, (1.0 - other) * sb)
        rise = draw[b] * (up + down) < down
        move = up if rise else -down
        # Whoever ends is set to 0 or 1 exactly.
        a_ends = (1.0 - own) * sa <= other * sb if rise else own * sa <= (1.0 - other) * sb
        b_ends = other * sb <= (1.0 - own) * sa if rise else (1.0 - other) * sb <= own * sa
        p[a] = (1.0 if rise else 0.0) if a_ends else own + move / sa
        p[b] = (0.0 if rise else 1.0) if b_ends else other - move / sb
        if a_ends:
            a = b
    return a


def _meet(level: int, pooled: bool):
    """Rows (of, bucket, size, p, key, ...) sorted by group: p becomes 0 or 1 in all rows of a group but at most one.

    pooled: all rows of a group come with one p."""
    duel = _pool if pooled else _pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            p, size = whole.column("p").to_pylist(), whole.column("size").to_pylist()
            key = whole.column("key").to_numpy().astype(np.int64).view(np.uint64)
            salted = spread(key + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))
            # A row that met a pool and stayed open meets the next one with another draw: the first row of the pool has a say in it.
            draw = ((spread(salted * np.uint64(3) + np.roll(salted, -1)) if pooled else salted) >> np.uint64(11)) / 2.0**53
            of = list(zip(whole.column("of").to_pylist(), whole.column("bucket").to_pylist(), strict=True))
            last = duel(p, size, draw.tolist(), of)
            at = whole.schema.get_field_index("p")
            done = whole.set_column(at, "p", pa.array(p, pa.float64())).to_batches()[0]
            held = done.slice(last, 1)
            yield done.slice(0, last)
            yield done.slice(last + 1)
        if held is not None:
            yield held

    return run


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, source, key, size, source_size, target, copies, taken, one row per row of docs."""
    sized = _kept(sizes(docs, seed), "sizes")
    of = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    per = _kept(targets(sized, weights, share, most).withColumn("of", of).drop("source"), "targets")
    rows = attach(sized.withColumn("of", of), per, ["of"], ["key"], count="n")
    wanted = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0)
    rows = rows.withColumn("sure", F.floor(wanted)).withColumn("p", wanted - F.col("sure"))
    rows = rows.withColumn("bucket", F.pmod("key", F.ceil(F.col("n") / LEAF)))
    rows = rows.select("doc_id", "source", "key", "size", "source_size", "target", "sure", "p", "of", "bucket")
    open_ = (F.col("p") > 0.0) & (F.col("p") < 1.0)
    worth = open_ & (F.col("size") > 0)
    alone = F.pmod(F.xxhash64("key", F.lit(0)), F.lit(1 << 53)) / float(1 << 53) < F.col("p")
    parts = [rows.where(~worth)]
    most_rows = per.agg(F.max("n")).first()[0] or 0
    width, level, now = -(-most_rows // LEAF), 1, rows.where(worth)
    while True:
        met = now.repartition("of", "bucket").sortWithinPartitions("of", "bucket", F.col("size").desc(), "key", "doc_id")
        met = _kept(met.mapInArrow(_meet(level, level == 1), now.schema), f"level-{level}")
        if width <= 1:
            parts.append(met)
            break
        parts.append(met.where(~open_))
        now = met.where(open_).withColumn("bucket", F.floor(F.col("bucket") / FAN))
        width, level = -(-width // FAN), level + 1
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    one = F.when(open_, F.when(alone, 1).otherwise(0)).otherwise(F.col("p")).cast("long")
    copies = F.col("sure") + one
    return every.select("doc_id", "source", "key", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixture(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The rows of docs, all columns, each as often as it is taken. Rows alike in id, text and source are one row, taken as often as all of them."""
    key, times = fresh(docs.columns, "key", "times")
    taken = mix(docs, weights, share, most, seed).where("copies > 0").groupBy("key").agg(F.sum("copies").alias(times)).withColumnRenamed("key", key)
    one = docs.withColumn(key, _key(seed)).dropDuplicates([key])
    return one.join(taken, key).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
