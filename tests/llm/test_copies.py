"""N-gram join, components, decontamination and substring dedup against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterlake.llm import components, decontaminate, ngram_join, substring_dedup


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def grams(text, n=5):
    w = split(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))) if w else frozenset()


def classes_of(texts, least):
    """class and links of each id, by comparing all pairs."""
    sets, root = {k: grams(t) for k, t in texts.items()}, {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    n, keys = defaultdict(int), sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if texts[a] == texts[b] or both and both / (len(sets[a]) + len(sets[b]) - both) >= least:
                n[a] += 1
                n[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (find(k), n[k]) for k in texts}


def edited(seed, copies, words=120, changes=1):
    """A text and copies of it with a few words changed, all of them different."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(copies):
        own = list(base)
        for _ in range(changes):
            own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block", [1024, 7])
def test_join_by_brute_force(spark, texts, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = dict(texts) | {10_000 + i: t for i, t in enumerate(edited(1, 40) + edited(2, 6, changes=3) + ["", "a b", "a b", "a b c"])}
    frame = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.join(frame).collect()}
    assert got == classes_of({k: t or "" for k, t in rows.items()}, 0.8)


def test_join_odd_rows(docs, none):
    rows = ngram_join.join(docs).collect()
    assert len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert by[900_001][0]["class_id"] == by[900_002][0]["class_id"] == 900_001  # null and empty texts are copies
    assert [r["n_copies"] for r in by[900_005]] == [2, 2] and len(by[None]) == 1
    one = ngram_join.one_of_each(docs)
    assert one.columns == docs.columns
    left = one.collect()
    assert len(left) == len({r["class_id"] for r in rows})
    kept = [r["doc_id"] for r in left]
    assert kept.count(900_005) == 1 and kept.count(900_001) == 1 and 900_002 not in kept and kept.count(None) == 1
    assert ngram_join.join(none).collect() == [] and ngram_join.one_of_each(none).collect() == []


def test_join_shared_and_missing_ids(spark):
    """Classes keep names of their own where all rows lack an id or share one; texts are joined by id and digest."""
    pairs = [t for seed in range(400) for t in edited(seed, 1, words=40)]
    for ids in (None, 7):
        frame = spark.createDataFrame([(ids, t) for t in pairs], "doc_id int, text string").repartition(4)
        rows = ngram_join.join(frame).collect()
        size = defaultdict(int)
        for r in rows:
            size[r["class_id"]] += 1
        want = classes_of(dict(enumerate(pairs)), 0.8)
        count = defaultdict(int)
        for name, _ in want.values():
            count[name] += 1
        assert sorted(size.values()) == sorted(count.values()) and None not in size
        assert (7 in size) == (ids == 7)
        assert ngram_join.one_of_each(frame).count() == len(count)
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    for kind in ("bigint", "string"):
        frame = spark.createDataFrame([("1", a), ("1", b), ("2", a), ("3", b)], "doc_id string, text string")
        rows = ngram_join.join(frame.withColumn("doc_id", F.col("doc_id").cast(kind))).collect()
        names = {int(r["doc_id"]): r["class_id"] for r in rows if int(r["doc_id"]) > 1}
        assert names[2] != names[3] and {r["class_id"] for r in rows} == set(names.values())
        assert str(1) in {str(n) for n in names.values()}


def test_bands_reach_the_recall():
    for similarity, recall in ((0.8, 0.999), (0.5, 0.95), (0.9, 0.99)):
        bands, rows = ngram_join.bands_for(similarity, recall)
        assert 1 - (1 - similarity**rows) ** bands >= recall


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(300, 301), (301, 300), (5, 5)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {i: 0 for i in range(41)} | {k: 100 for k in range(100, 160)} | {300: 300, 301: 300}
    assert got == want
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def score_by_table(item, text):
    h = np.zeros((len(item) + 1, len(text) + 1), int)
    for i, x in enumerate(item, 1):
        for j, y in enumerate(text, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max(), h


def test_alignment_by_table():
    rng = np.random.default_rng(5)
    for _ in range(60):
        item, text = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(0, 25))
        best, h = score_by_table(item, text)
        got, end = decontaminate.align(item.astype(np.uint64), text.astype(np.uint64))
        assert got == best and (best == 0 or h[:, end].max() == best)


def test_decontamination(spark, plain, texts, benchmark):
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(plain, benchmark).collect()}
    items = {r["item_id"]: r["text"] or "" for r in benchmark.collect()}
    low = lambda t: re.findall(r"[^\W_]+", t.lower())
    want = set()
    for i, t in items.items():
        for d, x in texts.items():
            a, b = low(t), low(x)
            if len(a) >= 8 and any(a[:8] == b[k : k + 8] for k in range(len(b) - 7)):
                want.add((d, i))
    assert found >= want and len(found - want) <= 1
    left = decontaminate.clean(plain, benchmark)
    assert left.columns == plain.columns
    assert {r["doc_id"] for r in left.collect()} == set(texts) - {d for d, _ in found}


def test_edited_copies_are_found(spark, texts, benchmark):
    rng = random.Random(4)
    items = {r["item_id"]: r["text"].split() for r in benchmark.collect() if r["text"] and len(r["text"].split()) >= 20}
    filler = " ".join(list(texts.values())[:5]).split()[:80]
    rows = []
    for i, w in items.items():
        own = [x if rng.random() > 0.15 else rng.choice([f"q{rng.randrange(999)}", x + " " + x, ""]) for x in w]
        rows.append((i, " ".join([*filler, *own, *filler])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, benchmark).collect()}
    assert len({i for i in items if (i, i) in found}) >= 0.95 * len(items)


def test_copies_without_a_window_of_five_words(spark, texts, benchmark):
    """Every fifth word changed, and 20 to 30 % of them: all copies whose whole alignment reaches the similarity are found."""
    rng = random.Random(6)
    items = {r["item_id"]: r["text"].split() for r in benchmark.collect() if r["text"] and len(r["text"].split()) >= 10}
    filler = " ".join(list(texts.values())[:5]).split()[:80]
    hashes = lambda w: decontaminate.plain_words(pa.array([" ".join(w)]))[1]
    rows, want = [], {0: set(), 1: set(), 2: set(), 3: set()}
    for k, rate in enumerate((None, 0.2, 0.25, 0.3)):
        for i, w in items.items():
            own = [f"q{rng.randrange(9999)}" if (j % 5 == 4 if rate is None else rng.random() < rate) else x for j, x in enumerate(w)]
            rows.append((10 * i + k, " ".join([*filler, *own, *filler])))
            if decontaminate.align(hashes(w), hashes(own))[0] >= decontaminate.SIMILARITY * decontaminate.MATCH * min(len(hashes(w)), decontaminate.LONGEST):
                want[k].add(i)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, benchmark).collect()}
    got = {k: {i for i in some if (10 * i + k, i) in found} for k, some in want.items()}
    assert got[0] == want[0] == set(items)
    assert all(len(got[k]) >= 0.99 * len(want[k]) for k in want), {k: (len(got[k]), len(want[k])) for k in want}


def test_benchmark_in_blocks(plain, benchmark, monkeypatch):
    key = lambda rows: sorted((r["doc_id"], r["item_id"], round(r["similarity"], 6), r["first_word"], r["end_word"]) for r in rows)
    whole = key(decontaminate.find(plain, benchmark).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 500)
    assert key(decontaminate.find(plain, benchmark).collect()) == whole


def test_decontamination_odd_rows(docs, none, benchmark):
    assert decontaminate.clean(docs, benchmark).columns == docs.columns
    assert decontaminate.find(none, benchmark).collect() == [] and decontaminate.clean(none, benchmark).collect() == []
    assert decontaminate.find(docs, benchmark.limit(0)).collect() == [] and decontaminate.clean(docs, benchmark.limit(0)).count() == docs.count()


def test_copies_one_after_another_and_types_of_ids(spark):
    rng = random.Random(3)
    item = " ".join(f"w{rng.randrange(10**6)}" for _ in range(20))
    other = " ".join(f"v{rng.randrange(10**6)}" for _ in range(30))
    docs = spark.createDataFrame([(1, " ".join([item] * 10)), (2, f"{other} {item} {item} {other}"), (3, other)], "doc_id int, text string")
    for kind in ("smallint", "int", "bigint", "string"):
        items = spark.createDataFrame([("7", item)], "item_id string, text string").withColumn("item_id", F.col("item_id").cast(kind))
        got = sorted((r["doc_id"], str(r["item_id"]), r["first_word"], r["end_word"]) for r in decontaminate.find(docs, items).collect())
        assert got == [(1, "7", 20 * k, 20 * k + 20) for k in range(10)] + [(2, "7", 30, 50), (2, "7", 50, 70)]


def chunks_by_recurrence(data):
    """One byte at a time."""
    h, last, out = 0, 0, []
    for i, b in enumerate(data, 1):
        h = ((h << 1) + int(substring_dedup._GEAR[b])) % 2**32
        if i - last == substring_dedup.MOST or i - last >= substring_dedup.LEAST and h >> (32 - substring_dedup.BITS) == 0:
            out.append(i)
            last = i
    return out + [len(data)] * (last < len(data))


def test_chunks_by_recurrence(texts):
    for t in [*list(texts.values())[:40], "", "a", "ab" * 2000]:
        data = np.frombuffer(t.encode(), np.uint8)
        assert substring_dedup.cuts(data) == chunks_by_recurrence(data) if len(data) else True


def test_repeated_passages(spark, plain, texts):
    got = substring_dedup.repeated(plain).collect()
    holders = defaultdict(set)
    for d, t in texts.items():
        w = t.split()
        for i in range(len(w) - 49):
            holders[tuple(w[i : i + 50])].add(d)
    want = set().union(*(s for s in holders.values() if len(s) > 1))
    assert {r["doc_id"] for r in got} >= want
    raw = {d: t.encode() for d, t in texts.items()}
    for r in got:
        part = raw[r["doc_id"]][r["start"] : r["end"]]
        assert len(part) >= substring_dedup.SPAN
        # Some other document holds the span's first bytes.
        assert any(part[:16] in t for d, t in raw.items() if d != r["doc_id"])


def test_short_passages_of_two_documents(spark):
    """Passages of 51 words in two documents each, fresh words around them: both documents have a span that is the passage, to the byte, unless the two share no whole chunk."""
    rng = random.Random(8)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))
    rows, want = [], {}
    for k in range(150):
        passage = fresh(51)
        for d in (2 * k, 2 * k + 1):
            head = fresh(30) + " "
            rows.append((d, head + passage + " " + fresh(30)))
            want[d] = len(head), len(head) + len(passage)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    texts, got = dict(rows), {r["doc_id"]: (r["start"], r["end"]) for r in substring_dedup.repeated(docs).collect()}
    common = lambda x, y: next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
    exact = {}
    for d, (a, b) in want.items():
        x, y, (p, q) = texts[d], texts[d ^ 1], want[d ^ 1]
        exact[d] = a - common(x[:a][::-1], y[:p][::-1]), b + common(x[b:], y[q:])
    ends = {d: substring_dedup.cuts(np.frombuffer(t.encode(), np.uint8)) for d, t in texts.items()}
    pieces = lambda d: {texts[d][a:b] for a, b in zip([0, *ends[d]], ends[d])}
    lost = exact.keys() - got.keys()
    assert len(lost) <= 2 and not any(pieces(d) & pieces(d ^ 1) for d in lost)
    assert got == {d: x for d, x in exact.items() if d not in lost}
    left = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(docs).collect()}
    assert all(left[d] == (texts[d] if d % 2 == 0 else texts[d][:a] + texts[d][b:]) for d, (a, b) in got.items())


def test_ends_with_several_holders(spark):
    """One chunk run in four documents, whose surroundings agree for different lengths: each has its longest."""
    rng = random.Random(10)
    own = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    shared, tail = own(500), own(70)
    rows = [(k, own(90).upper() + shared + tail[:n] + own(90).upper()) for k, n in enumerate((20, 21, 55, 70))]
    got = {r["doc_id"]: (r["start"], r["end"]) for r in substring_dedup.repeated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {0: (90, 610), 1: (90, 611), 2: (90, 645), 3: (90, 645)}


def test_ends_longer_than_a_window(spark):
    """Without borders for thousands of bytes, chunks of MOST bytes do not fall together; the bytes beside a run do."""
    blank, rng = "a" * 6000, random.Random(9)
    own = lambda n: "".join(rng.choice("bcdefghijklmnopqrstuvwxyz") for _ in range(n))
    shared = own(400)
    rows = [(1, own(100) + blank[:5000] + shared + own(90)), (2, own(153) + blank[:4321] + shared + own(50))]
    got = substring_dedup.repeated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r["doc_id"]) for r in got if r["end"] - r["start"] >= 4321 + 400} == {1, 2}


@pytest.mark.parametrize("parts,single", [(1, 64), (2, 64), (5, 64), (40, 64), (7, 5), (40, 9)])
def test_nearest_by_brute_force(spark, parts, single, monkeypatch):
    """Agreement with the best other document by comparing all pairs: equal contexts, runs of one document, tags of one row, many partitions of a few rows."""
    monkeypatch.setattr(substring_dedup, "PARTS", single)
    rng = random.Random(parts)
    rows = []
    for site in range(300):
        own = bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 1, 3, 8, 8, 8])))
        rows.append((site, rng.choice([1, 1, 1, 2, 3, 4]), bytes([rng.randrange(6)]) * 2, own, rng.random() < 0.7))
    rows += [(300 + i, 7, b"zz", b"same", True) for i in range(30)] + [(400 + i, 8, b"zz", b"same" + b"x" * i, True) for i in range(5)] + [(500, 9, b"yy", b"alone", True)]
    table = spark.createDataFrame(rows, "site bigint, doc_id bigint, tag binary, own binary, edge boolean").repartition(3)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r["site"]: r["got"] for r in substring_dedup._nearest(table).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    common = lambda x, y: next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
    assert got == {s: max((common(own, o) for _, e, t, o, _ in rows if t == tag and e != d), default=0) for s, d, tag, own, edge in rows if edge}


def test_ends_of_rows_without_an_id(spark):
    """A row without an id goes on as far as two documents do, or not at all with one."""
    rng = random.Random(12)
    own = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    shared, tail = own(500), own(70)
    rows = [(k, own(90).upper() + shared + tail[:n] + own(90).upper()) for k, n in ((1, 20), (2, 21), (None, 55), (4, 30))]
    got = {r["doc_id"]: (r["start"], r["end"]) for r in substring_dedup.repeated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: (90, 610), 2: (90, 611), None: (90, 611), 4: (90, 611)}


def test_insertions_move_few_borders(texts):
    text = max(texts.values(), key=len).encode()
    moved = text[:1000] + b"inserted" + text[1000:]
    pieces = lambda t: {t[a:b] for a, b in zip([0, *substring_dedup.cuts(np.frombuffer(t, np.uint8))], substring_dedup.cuts(np.frombuffer(t, np.uint8)))}
    assert len(pieces(text) - pieces(moved)) <= 4


def test_substring_odd_rows(docs, none):
    assert substring_dedup.repeated(none).collect() == []
    out = substring_dedup.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
