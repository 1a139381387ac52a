"""Quality rules: a hashed n-gram log-likelihood ratio beside fixed base rules, in DataFrame functions only.

Tokens are lower-case runs of letters and digits, or of other signs. Every
token and pair of neighbouring tokens falls into one of `buckets` hash buckets.
Two multinomials with add-one smoothing are counted over all documents: the
target over those that `labels` calls good, the raw one over the whole table.
A document's score is the mean over its n-grams of log(target / raw); it is
kept if it passes the base rules and its score is at least `threshold`. The
score of a text like the trusted ones is near 0 or above it; a threshold under
0 leaves room for texts in a style that the trusted ones hold less of.

Counting and scoring are two passes over the texts. What goes to the driver is
the table of `buckets` ratios, whatever the corpus.

Cases: a null text counts as no words: base_failed, not kept, score 0; so does a
text of white space. Null or repeated doc_ids keep their rows. With no trusted
document, both multinomials are even and the scores 0. Labels that are null or
name no document count for nothing; a document labelled twice is trusted if any
label trusts it. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.textexpr import let

BUCKETS = 10_000
THRESHOLD = -0.25
#: Ids of eight bytes that a broadcast may hold.
BROADCAST_IDS = 2_000_000
MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
_SPACES = "\t\n\x0b\x0c\r"


def spaced(text: Column) -> Column:
    """The text with every space character a blank. Replacing rare characters is far cheaper than translating all."""
    for c in _SPACES:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def words(text: Column) -> Column:
    """Runs of characters outside 0x20 and 0x09-0x0D."""
    return F.array_remove(F.split(spaced(text), " "), "")


def repeated_words(w: Column) -> Column:
    """Words that lie in a window found twice or more; most texts end at the test for any repeat."""
    def windows(w: Column) -> Column:
        return F.when(F.size(w) >= WINDOW, F.transform(
            F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)),
            lambda i: F.xxhash64(*(F.element_at(w, i + k) for k in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))

    def places(hashes: Column) -> Column:
        """Ascending places of the windows that have an equal one."""
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, x, j: F.coalesce(x["h"] == F.get(s, j)["h"], F.lit(False))
        return let(placed, lambda s: F.array_sort(F.transform(
            F.filter(s, lambda x, i: same(s, x, i - 1) | same(s, x, i + 1)), lambda x: x["i"])))

    covered = lambda p: F.aggregate(
        p, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), x - acc["last"])).alias("n")))["n"]
    none = lambda h: F.size(F.array_distinct(h)) == F.size(h)
    count = lambda h: F.when(none(h), F.lit(0)).otherwise(let(places(h), covered))
    # The words are bound too: a filter pushed below would else put their making into every step.
    return let(w, lambda v: let(windows(v), count)).cast("long")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and characters beyond ASCII, and runs of other signs."""
    return words(F.regexp_replace(F.lower(text), r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " $0 "))


def _bucket(buckets: int, *gram: Column) -> Column:
    return F.pmod(F.xxhash64(*gram), F.lit(buckets)).cast("int")


def base_rules(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select("doc_id", text.alias("text")).withColumn("w", words(F.col("text"))).select(
        "doc_id", "text", F.size("w").cast("long").alias("n_words"),
        F.length(F.replace(spaced(F.col("text")), F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """log(target / raw) of every bucket, counted over all documents."""
    trusted = labels.where(F.col("quality") == 1).select("doc_id").distinct().withColumn("good", F.lit(1))
    # So few ids go to every task, and no text is shuffled; beyond that, the join shuffles both sides.
    if trusted.count() <= BROADCAST_IDS:
        trusted = F.broadcast(trusted)
    counted = (
        docs.select("doc_id", "text").join(trusted, "doc_id", "left")
        .select("good", tokens(F.coalesce("text", F.lit(""))).alias("t"))
        # A token with its neighbour, which the last one lacks.
        .select("good", F.inline(F.arrays_zip(F.col("t").alias("a"), F.slice("t", F.lit(2), F.size("t")).alias("b"))))
        .select("good", F.explode(F.array(_bucket(buckets, F.col("a")), F.when(F.col("b").isNotNull(), _bucket(buckets, F.col("a"), F.col("b"))))).alias("bucket"))
        .where("bucket is not null")
        .groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("good").alias("target"))
    )
    got = {r["bucket"]: (r["raw"], r["target"]) for r in counted.collect()}  # at most `buckets` rows
    raw, target = (sum(v[k] for v in got.values()) for k in (0, 1))
    out = []
    for b in range(buckets):
        r, t = got.get(b, (0, 0))
        out.append(log((t + 1) / (target + buckets)) - log((r + 1) / (raw + buckets)) if target else 0.0)
    return out


def mean_ratio(text: Column, table: list[float]) -> Column:
    """The mean log-ratio over a text's n-grams; 0 without any."""
    values = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")
    ratio = lambda *gram: F.get(values, _bucket(len(table), *gram))
    add = lambda a, x: a + x
    return let(tokens(text), lambda t: (
        F.aggregate(F.transform(t, lambda x: ratio(x)), F.lit(0.0), add)
        + F.aggregate(F.zip_with(t, F.slice(t, F.lit(2), F.size(t)), lambda x, y: F.when(y.isNotNull(), ratio(x, y)).otherwise(0.0)), F.lit(0.0), add)
    ) / F.greatest(2 * F.size(t) - 1, F.lit(1)))


def score(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """The base rules' columns without the text, and score, kept."""
    sums = mean_ratio(F.col("text"), log_ratios(docs, labels, buckets))
    return (
        base_rules(docs).withColumn("score", sums).drop("text")
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    )


def keep(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all columns, that the rules keep. The ratio is worked out for what passes the base rules."""
    text = F.coalesce("text", F.lit(""))
    passes = let(words(text), lambda w: F.when(F.size(w) < MIN_WORDS, F.lit(False)).otherwise(
        100 * repeated_words(w) <= REPEAT_PERCENT * F.size(w)))
    return docs.where(F.when(passes, mean_ratio(text, log_ratios(docs, labels, buckets)) >= threshold).otherwise(False))
