"""Licence scan by canonical digest: whole texts and whole lines against known licence texts.

A text is made canonical (ASCII letters to lower case, copyright lines dropped,
equivalent spellings made one, every other sign a blank, blanks collapsed) and
hashed; a hash join with the digests of the known texts names the licence. The
units are the whole document and each of its lines, as notices stand on a line
of their own. Lines without a word that every known notice holds one of are not
hashed, as they cannot match.

Cases: a null or empty text has no licence; null or repeated doc_ids keep their
rows; a document may carry several licences, named in order; an empty table gives
an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.license_texts import KNOWN
from rasterlake.llm.textexpr import let

# Fixed value: a line that states a copyright or reserves rights, in lower case.
_COPYRIGHT = r"(?m)^[^a-z\n]*(copyright *(\(c\)|©|[0-9]{4})|\(c\) *[0-9]{4}|©|all rights reserved)[^\n]*$"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Equivalent spellings, applied in this order to canonical words.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non commercial", "noncommercial"),
    ("version 2 0", "version 2"), ("v2 0", "version 2"), ("v2", "version 2"), ("v3", "version 3"), ("4 0", "4"),
    ("https", "http"), ("e g", "eg"), ("co operation", "cooperation"), ("merchantibility", "merchantability"),
)
#: Every canonical known text holds one of these. Parts of one word: between two, a text may have any signs.
STEMS = ("licens", "licenc", "permission", "redistribution", "warranty", "domain")


def canonical(text: Column) -> Column:
    low = F.translate(text, _UPPER, _UPPER.lower())
    kept = F.regexp_replace(low, _COPYRIGHT, " ")
    plain = F.concat(F.lit(" "), F.regexp_replace(kept, r"[^a-z0-9]+", " "), F.lit(" "))
    for said, meant in SPELLINGS:
        plain = F.replace(plain, F.lit(f" {said} "), F.lit(f" {meant} "))
    return F.trim(F.regexp_replace(plain, " +", " "))


def known_digests(spark) -> DataFrame:
    """digest, license of the known texts; as many rows as the library knows texts."""
    rows = spark.createDataFrame(list(KNOWN), "license string, known string")
    return rows.select(F.sha2(canonical(F.col("known")), 256).alias("digest"), "license").distinct()


def units(docs: DataFrame) -> DataFrame:
    """row, doc_id, whole, digest: of each document and of its lines that may be notices."""
    held = lambda c: let(F.lower(c), lambda low: F.greatest(*(F.contains(low, F.lit(s)).cast("int") for s in STEMS)) == 1)
    rows = docs.select("doc_id", "text").where(held(F.col("text")))
    lines = F.array_distinct(F.filter(F.split("text", "\n"), held))
    return (
        rows.select("doc_id", F.explode(F.concat(
            F.array(F.struct(F.lit(True).alias("whole"), F.col("text").alias("unit"))),
            F.transform(lines, lambda x: F.struct(F.lit(False).alias("whole"), x.alias("unit"))))).alias("u"))
        .select("doc_id", "u.whole", F.sha2(canonical(F.col("u.unit")), 256).alias("digest"))
    )


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, license, whole (the document is that text and no more) for every licence in every document."""
    found = units(docs).join(F.broadcast(known_digests(docs.sparkSession)), "digest")
    return found.groupBy("doc_id", "license").agg(F.max("whole").alias("whole"))


def _canonical_sql(text: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"translate({text}, '{_UPPER}', '{_UPPER.lower()}')"
    out = f"regexp_replace({out}, {quote(_COPYRIGHT)}, ' ', 'g')"
    out = f"' ' || regexp_replace({out}, '[^a-z0-9]+', ' ', 'g') || ' '"
    for said, meant in SPELLINGS:
        out = f"replace({out}, ' {said} ', ' {meant} ')"
    return f"sha256(trim(regexp_replace({out}, ' +', ' ', 'g')))"


def _sql() -> str:
    """The same result for DuckDB, hashing every text and line."""
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in KNOWN)
    return f"""
with known as (select distinct license, {_canonical_sql("t")} digest from (values {values}) k(license, t)),
unit as (
  select doc_id, true whole, text u from documents where text is not null
  union all
  select distinct doc_id, false, unnest(string_split(text, chr(10))) from documents where text is not null)
select doc_id, license, bool_or(whole) whole from (select doc_id, whole, {_canonical_sql("u")} digest from unit) join known using (digest)
group by doc_id, license"""


SQL = _sql()
