"""Secret scan over a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is turned into a Boolean query over trigrams that
any match must hold: an OR of ANDs. Postings (trigram, doc_id) are built for the
trigrams that some query names, in lower case. Intersecting them by document
gives candidates, which alone the rule's expression verifies; a rule with an
alternative that holds no trigram is run over every text.

Spans count code points of the whole text, end exclusive. Matches of a kind are
leftmost and do not overlap; those whose value is shorter than `least` fall away
after matching.

Cases: a null text is an empty one, with no spans. Null doc_ids match null ones;
where an id is repeated, a candidate is verified in each of its rows. An empty
table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.textexpr import fresh, let

#: More alternatives than this become a gap, of which nothing is known.
ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    group: int = 0
    least: int = 0


# Kinds in the order of the report, the first three being the base ones.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Shorter runs of digits are no match; a run is always taken whole, so asking for 24 finds the same spans.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE_KINDS = ("assign", "access", "hex")

_GAP = "\0"


def _shapes(tree) -> list[str]:
    """All strings that an expression's matches may be, with gaps where anything may stand."""
    out = [""]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            parts = [chr(arg)]
        elif name == "SUBPATTERN":
            parts = _shapes(arg[3])
        elif name == "BRANCH":
            parts = [s for branch in arg[1] for s in _shapes(branch)]
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            parts = [chr(a) for _, a in arg]
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, body = arg
            once = _shapes(body)
            if (low, high) == (0, 1):
                parts = ["", *once]
            elif low:
                parts = [s + _GAP for s in once]
            else:
                parts = [_GAP]
        elif name == "AT":
            parts = [""]
        else:
            parts = [_GAP]
        if len(out) * len(parts) > ALTERNATIVES:
            parts = [_GAP]
        out = [a + b for a, b in product(out, parts)]
    return out


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """An OR of sets of lower-case trigrams, one of which every match holds whole; None: no such query."""
    found = set()
    for shape in _shapes(_parser.parse(regex)):
        # Every third trigram and the last cover a run of letters; the others would say little more.
        runs = [run for run in shape.lower().split(_GAP) if len(run) > 2]
        grams = frozenset(run[i : i + 3] for run in runs for i in {*range(0, len(run) - 2, 3), len(run) - 3})
        if not grams:
            return None
        found.add(grams)
    # A set that holds another one adds nothing.
    return sorted((s for s in found if not any(o < s for o in found)), key=sorted)


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """trigram, doc_id: the inverted index for these trigrams over all texts."""
    held = lambda low: F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams)))
    return docs.select("doc_id", F.explode(let(F.lower("text"), held)).alias("trigram")).distinct()


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, kinds: the documents that hold all trigrams of an alternative of a rule's query."""
    clauses = [(f"{r.kind}/{i}", r.kind, t, len(clause))
               for r in rules for i, clause in enumerate(trigram_query(r.regex) or []) for t in sorted(clause)]
    spark = docs.sparkSession
    # As long as the rules have trigrams, whatever the table.
    query = spark.createDataFrame(clauses or [("", "", "", 0)], "clause string, kind string, trigram string, needed int")
    held = postings(docs, sorted({c[2] for c in clauses})) if clauses else docs.limit(0).select("doc_id", F.lit("").alias("trigram"))
    return (
        held.join(F.broadcast(query), "trigram")
        .groupBy("doc_id", "clause", "kind", "needed").agg(F.count(F.lit(1)).alias("n")).where("n = needed")
        .groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))  # at most one entry per rule
    )


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Sorted array of (start, order, kind, end) of one rule in a text."""
    pattern = F.lit(rule.regex)
    empty = F.array().cast("array<struct<start:int,k:int,kind:string,end:int>>")

    def place(parts: Column) -> Column:
        m, v, gaps = parts["m"], parts["v"], parts["gaps"]
        at = lambda a, i: F.length(F.get(a, i))
        start = lambda acc, i: acc["pos"] + at(gaps, i)
        found = F.aggregate(
            F.sequence(F.lit(0), F.size(m) - 1),
            F.struct(F.lit(0).alias("pos"), empty.alias("out")),
            lambda acc, i: F.struct(
                (start(acc, i) + at(m, i)).alias("pos"),
                F.when(at(v, i) >= rule.least, F.concat(acc["out"], F.array(F.struct(
                    start(acc, i).alias("start"), F.lit(order).alias("k"), F.lit(rule.kind).alias("kind"),
                    (start(acc, i) + at(m, i)).alias("end"))))).otherwise(acc["out"]).alias("out")),
        )["out"]
        return F.when(F.size(m) > 0, found).otherwise(empty)

    matches = F.regexp_extract_all(text, pattern, 0)
    values = F.regexp_extract_all(text, pattern, rule.group) if rule.group else matches
    parts = F.struct(matches.alias("m"), values.alias("v"), F.split(text, rule.regex).alias("gaps"))
    return F.when(text.rlike(rule.regex), let(parts, place)).otherwise(empty)


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES, name: str = "found") -> DataFrame:
    """All columns of docs and, by that name, an array of (start, k, kind, end) by start, then rule."""
    hit, kinds = fresh([*docs.columns, name], "hit_id", "kinds")
    hits = candidates(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), rules).toDF(hit, kinds)
    rows = docs.join(hits, docs["doc_id"].eqNullSafe(hits[hit]), "left")
    text = F.coalesce(docs["text"], F.lit(""))
    empty = F.array().cast("array<struct<start:int,k:int,kind:string,end:int>>")
    every = []
    for order, rule in enumerate(rules):
        spans = spans_of(text, rule, order)
        if trigram_query(rule.regex):
            spans = F.when(F.array_contains(kinds, rule.kind), spans).otherwise(empty)
        every.append(spans)
    return rows.withColumn(name, F.array_sort(F.concat(*every))).drop(hit, kinds)


def joined(found: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans and all spans as text."""
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))
    return find(docs.select("doc_id", "text"), rules).select(
        "doc_id", *map(count, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every span's text replaced by [kind]; of overlapping spans, the earlier hides both. n_chars follows the text."""
    [found] = fresh(docs.columns, "found")
    cut = F.aggregate(
        found, F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["pos"], F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), acc["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("pos"), F.concat(acc["out"], F.substr(F.col("text"), acc["pos"] + 1, s["start"] - acc["pos"]),
                                                     F.lit("["), s["kind"], F.lit("]")).alias("out"))))
    whole = F.when(F.size(found) == 0, F.col("text")).otherwise(
        let(cut, lambda c: F.concat(c["out"], F.substr(F.col("text"), c["pos"] + 1, F.length("text")))))
    out = find(docs, rules, found).withColumn("text", whole)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(found) == 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def _sql() -> str:
    """The same report for DuckDB, by every rule's expression over every text."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    kinds = []
    for k, r in enumerate(RULES):
        kinds.append(f"""
select doc_id, {k} k, {quote(r.kind)} kind, m, v, g from (
  select doc_id, regexp_extract_all(t, {quote(r.regex)}, 0) m, regexp_extract_all(t, {quote(r.regex)}, {r.group}) v,
         string_split_regex(t, {quote(r.regex)}) g from d)""")
    least = " ".join(f"when {k} then {r.least}" for k, r in enumerate(RULES))
    base = ", ".join(quote(k) for k in BASE_KINDS)
    counts = ", ".join(f"count(*) filter (kind = {quote(k)}) n_{k}" for k in BASE_KINDS)
    said = "kind || ':' || s || ':' || e"
    return f"""
with d as (select doc_id, coalesce(text, '') t from documents),
found as ({" union all ".join(kinds)}),
place as (select doc_id, k, kind, unnest(m) x, unnest(v) y, unnest(range(1, len(m) + 1)) i, m, g from found where len(m) > 0),
span as (
  select doc_id, k, kind, s, s + length(x) e from (
    select *, list_sum(list_transform(g[1:i], lambda a: length(a))) + coalesce(list_sum(list_transform(m[1:i-1], lambda a: length(a))), 0) s from place
  ) where length(y) >= case k {least} end),
report as (
  select doc_id, {counts}, string_agg({said}, ',' order by s, k) filter (kind in ({base})) b, string_agg({said}, ',' order by s, k) spans
  from span group by doc_id)
select d.doc_id, {", ".join(f"coalesce(n_{k}, 0)::bigint n_{k}" for k in BASE_KINDS)},
       sha256(coalesce(b, '')) base_sha256, coalesce(spans, '') spans
from d left join report using (doc_id)"""


SQL = _sql()
