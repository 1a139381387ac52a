"""Spelling variants: words one edit apart, found along a trie that is a table of edges.

1. Words are counted over all texts, with partial counts before the shuffle.
2. A word's prefixes are nodes, named by their digest. Only nodes where the trie
   branches or a word ends are kept; an edge carries the string between two of
   them. So a level of the trie is a branching, not a letter, and a word of a
   thousand letters has few. The words read backwards make a second trie in the
   same tables.
3. States are (word, position, node, edits). A word's own path is known from the
   nodes, so all its states without an edit enter together, from the middle of
   the word on: an edit in its first half is in the second half of the word read
   backwards, and the crowded top of the trie is never branched at. There an
   edge other than the word's own spends the edit: it replaces the letter (by a
   greater one only) or skips it (the longer word looks for the shorter). States
   with one edit are joined with the edges level by level until none is left;
   those at the end of their word and of another one are neighbours, and the
   relation is made symmetric.
4. A word's form is its most frequent neighbour, if frequent enough; roots are
   found by doubling the chains of forms.

A node with very many states is cut into parts (`skew.attach`). No group of words
is compared pair by pair. Rounds are as many as the branchings behind an edit.

Cases: null and empty texts hold no words; a null doc_id counts as an empty one in
the checksum; repeated rows count as often as they occur; an empty table
gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.operators.skew import attach
from rasterlake.session import work_dir

LETTERS = "A-Za-zÀ-ÿ"
LENGTH = 6
LEAST = 5
RATIO = 5
DROP = 199
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _kept(frame: DataFrame, purpose: str) -> DataFrame:
    path = work_dir(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def _part(text: Column | str, start: Column, length: Column | None = None) -> Column:
    """Code points from start (0-based) on."""
    return F.substring(text, start + 1, F.length(text) if length is None else length)


def vocabulary(docs: DataFrame, length: int = LENGTH, least: int = LEAST, drop: int = DROP) -> DataFrame:
    """word, n: runs of letters, lower-cased in A-Z, of at least so many code points and occurrences.

    A run whose checksum with its document `drop` divides loses one code point.
    """
    run = F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{length},}}"), F.lit(0))).alias("run")
    runs = docs.select("doc_id", run).select("doc_id", F.when(
        F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _UPPER.lower())).otherwise(F.col("run")).alias("run"))
    hashed = runs.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % drop == 0, F.concat(_part("run", F.lit(0), at), _part("run", at + 1))).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= length).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _prefixes(start: int):
    """word (as read), back, depth, node, next (empty at the word's end) from depth `start` on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            held = 0
            for word in batch.column("word").to_pylist():
                for back in (False, True):
                    text = word[::-1] if back else word
                    h = hashlib.blake2b(text[:start].encode(), digest_size=16, person=b"back" if back else b"")
                    n = len(text) - start + 1
                    nodes = [h.digest()]
                    for c in text[start:]:
                        h.update(c.encode())
                        nodes.append(h.digest())
                    for column, values in zip(out, ([text] * n, [back] * n, range(start, len(text) + 1), nodes, [*text[start:], ""]), strict=True):
                        column.extend(values)
                    held += n * (len(text) + 40)
                if held > 8 << 20:
                    yield _batch(out)
                    out, held = [[], [], [], [], []], 0
            if out[0]:
                yield _batch(out)

    return run


def _batch(columns: list[list]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.bool_(), pa.int32(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["word", "back", "depth", "node", "next"])


def trie(words: DataFrame, start: int) -> tuple[DataFrame, DataFrame]:
    """(word, back, nodes: structs of depth, node, ends) of every word both ways, and node, edges: structs of ch, label, child, ends.

    start: depth of the first node of a word; all words have at least that many code points.
    """
    steps = _kept(words.select("word").mapInArrow(_prefixes(start), "word string, back boolean, depth int, node binary, next string"), "prefixes")
    branching = steps.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("next").alias("low"), F.max("next").alias("high")).where(
        "low <> high or low = ''").select("node", "n", (F.col("low") == "").alias("ends"))
    on = attach(steps.drop("next"), branching, ["node"], ["word"], count="n")
    paths = _kept(on.groupBy("word", "back").agg(F.array_sort(F.collect_list(F.struct("depth", "node", "ends"))).alias("nodes")), "paths")
    pair = F.arrays_zip(F.col("nodes").alias("a"), F.slice("nodes", F.lit(2), F.size("nodes")).alias("b"))
    edges = (
        paths.select("word", F.inline(pair)).where("b is not null")
        .select(F.col("a.node").alias("node"), _part("word", F.col("a.depth"), F.col("b.depth") - F.col("a.depth")).alias("label"),
                F.col("b.node").alias("child"), F.col("b.ends").alias("ends"))
        .groupBy("node", "child").agg(F.first("label").alias("label"), F.first("ends").alias("ends"))
        .groupBy("node").agg(F.collect_list(F.struct(F.substring("label", 1, 1).alias("ch"), "label", "child", "ends")).alias("edges"))
    )
    return paths, _kept(edges, "edges")


def near(words: DataFrame, length: int = LENGTH) -> DataFrame:
    """word, other: all pairs, both ways, that one inserted, deleted or replaced code point tells apart. Words have at least `length` code points."""
    paths, edges = trie(words, length // 2)
    size = F.length("word")
    middle = F.when(F.col("back"), size - F.floor(size / 2)).otherwise(F.floor(size / 2))
    states = paths.select("word", "back", F.inline("nodes")).where(F.col("depth") >= middle).withColumnRenamed("depth", "pos")
    found = [states.where((F.col("pos") == size - 1) & F.col("ends")).select("word", "back", F.col("pos").alias("at"), F.lit("").alias("ch"))]

    own, m = _part("word", F.col("pos"), F.lit(1)), F.length("label")
    rest = F.substring("label", F.lit(2), m)
    replaced = (own != "") & (F.col("first") > own) & (rest == _part("word", F.col("pos") + 1, m - 1))
    skipped = (own != "") & (F.col("first") != own) & (F.col("label") == _part("word", F.col("pos") + 1, m))
    counted = states.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    met = attach(states.drop("ends"), edges.join(counted, "node"), ["node"], ["word"], count="n")
    met = met.select("word", "back", "pos", F.inline("edges")).withColumnRenamed("ch", "first").where(replaced | skipped)

    def after(spent: Column, ch: Column, extra: int) -> Column:
        return F.when(spent, F.struct(ch.alias("ch"), (F.col("pos") + m + extra).alias("pos")))

    spent = F.array_compact(F.array(after(replaced, F.col("first"), 0), after(skipped, F.lit(""), 1)))
    now = met.select("word", "back", F.col("pos").alias("at"), F.col("child").alias("node"), "ends", F.inline(spent))
    # One row an edge: a state with its edit spent follows the edge of its next letter alone.
    single = edges.select("node", F.inline("edges")).withColumnRenamed("node", "of")
    while True:
        now = _kept(now, "frontier")
        found.append(now.where((F.col("pos") == size) & F.col("ends")).select("word", "back", "at", "ch"))
        alive = now.where(F.col("pos") < size).drop("ends").withColumnRenamed("ch", "by").withColumnRenamed("node", "of").withColumn("ch", own)
        if alive.isEmpty():
            break
        reached = alive.groupBy("of", "ch").agg(F.count(F.lit(1)).alias("n"))
        step = attach(alive, single.join(reached, ["of", "ch"]), ["of", "ch"], ["word", "at"], count="n")
        now = step.where(F.col("label") == _part("word", F.col("pos"), m)).select(
            "word", "back", "at", F.col("by").alias("ch"), (F.col("pos") + m).alias("pos"), F.col("child").alias("node"), "ends")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    other = F.concat(_part("word", F.lit(0), F.col("at")), F.col("ch"), _part("word", F.col("at") + 1))
    turn = lambda x: F.when(F.col("back"), F.reverse(x)).otherwise(x)
    pairs = every.select(turn(F.col("word")).alias("a"), turn(other).alias("b"))
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"))))
    return pairs.select(both.alias("p")).select("p.word", "p.other").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root for rows (word, form): forms followed to the last, each round twice as far. No form leads back to its word."""
    now = _kept(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        now = _kept(now.join(ahead, "root", "left").select(
            "word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.drop("moved")


def group(docs: DataFrame, length: int = LENGTH, least: int = LEAST, ratio: int = RATIO, drop: int = DROP) -> DataFrame:
    """word, n, n_near, form, form_n, root."""
    words = _kept(vocabulary(docs, length, least, drop), "words")
    pairs = near(words, length)
    seen = (
        pairs.join(words.withColumnRenamed("word", "other").withColumnRenamed("n", "other_n"), "other")
        .groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("top"))
    )
    enough = -F.col("top.less") >= ratio * F.col("n")
    formed = _kept(words.join(seen, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("top.other")).alias("form"), F.when(enough, -F.col("top.less")).alias("form_n")), "forms")
    last = roots(formed.where("form is not null"))
    return formed.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


#: The checksum byte by byte; near words by joining words with a letter left out of both, or of one.
SQL = f"""
with recursive crc as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) t),
runs as materialized (
  select doc_id, run, count(*) n from (
    select doc_id, translate(unnest(regexp_extract_all(text, '[{LETTERS}]+')), '{_UPPER}', '{_UPPER.lower()}') run from documents)
  where length(run) >= {LENGTH} group by all),
hashed as materialized (
  select run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(hx) // 2), lambda i: cast('0x' || substr(hx, 2 * i + 1, 2) as bigint))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) h
  from (select run, n, hex(coalesce(cast(doc_id as varchar), '') || ':' || run) hx from runs), crc),
words as materialized (
  select word, cast(sum(n) as bigint) n from (
    select n, case when h % {DROP} = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end word from hashed)
  where length(word) >= {LENGTH} group by word having sum(n) >= {LEAST}),
less as materialized (
  select word, i, substr(word, 1, i - 1) || substr(word, i + 1) rest from (select word, unnest(range(1, length(word) + 1)) i from words)),
pairs as materialized (
  select a.word word, b.word other from less a join less b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select a.word, b.word from less a join words b on a.rest = b.word
  union select b.word, a.word from less a join words b on a.rest = b.word),
seen as (
  select p.word, count(*) n_near, arg_min(p.other, (-o.n, p.other)) top, max(o.n) top_n from pairs p join words o on p.other = o.word group by p.word),
formed as materialized (
  select w.word, n, coalesce(n_near, 0) n_near, case when top_n >= {RATIO} * n then top end form, case when top_n >= {RATIO} * n then top_n end form_n
  from words w left join seen using (word)),
chain as (
  select word, word now, 0 step from formed
  union all select c.word, f.form, step + 1 from chain c join formed f on c.now = f.word where f.form is not null)
select f.word, n, n_near, form, form_n, root
from formed f join (select word, arg_max(now, step) root from chain group by word) using (word)"""
