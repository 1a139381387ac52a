"""Source mixing, spelling variants and vector codes against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterlake.catalog.compare import compare
from rasterlake.llm import mixing, spelling, vector_codes

SF = "/root/testdata/sf0.001"


def count_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets_of(size_of, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by sharing the excess again until no source is above its cap."""
    order = sorted(size_of, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), share * sum(size_of.values())
    while True:
        rest = total - sum(most * size_of[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        now = {s: most * size_of[s] if s in full else rest * weight[s] / free for s in order}
        more = {s for s in order if s not in full and now[s] > most * size_of[s]}
        if not more:
            return now
        full |= more


def check_mix(rows, frame_rows):
    size_of = defaultdict(int)
    for _, text, source in frame_rows:
        size_of[source] += count_words(text)
    want = targets_of(size_of)
    taken, longest = defaultdict(int), defaultdict(int)
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in rows) == Counter((i, s, count_words(t)) for i, t, s in frame_rows)
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9) and r["source_size"] == size_of[r["source"]]
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        ratio = r["target"] / r["source_size"] if r["source_size"] else 0
        assert math.floor(ratio + 1e-9) <= r["copies"] <= math.ceil(ratio - 1e-9)
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for s in want:
        assert abs(taken[s] - want[s]) <= longest[s] + 1e-6
    return taken, want


def test_mix_keeps_targets(spark, docs):
    frame_rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    rows = mixing.mix(docs).collect()
    check_mix(rows, frame_rows)
    again = mixing.mix(docs.repartition(7, "lang")).collect()
    key = lambda r: (r["key"], r["size"], r["copies"])
    assert sorted(map(key, rows)) == sorted(map(key, again))


@pytest.mark.parametrize("leaf,fan,records", [(16, 3, 7), (4096, 1024, 10_000)])
def test_mix_tree(spark, monkeypatch, leaf, fan, records):
    """Several levels, small batches, one source with a third of all rows, sources at their caps and without words."""
    monkeypatch.setattr(mixing, "LEAF", leaf)
    monkeypatch.setattr(mixing, "FAN", fan)
    rng = random.Random(3)
    rows = [(i, "w " * rng.choice([0, 1, 2, 5, 9, 30, 200]), "a" if i % 3 == 0 else f"s{rng.randrange(7)}") for i in range(1500)]
    rows += [(5000 + i, "x y", None) for i in range(3)] + [(6000, "", "void"), (6001, None, "void")] + [(7000, "same words here", "a")] * 5
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    try:
        got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    taken, want = check_mix(got, rows)
    # What is drawn alone is the last open document: in most sources a short one, if a leaf holds the source.
    assert leaf < 1000 or sorted(abs(taken[s] - want[s]) for s in want)[len(want) // 2] <= 5


@pytest.mark.parametrize("pooled", [True, False])
def test_mix_is_fair(pooled):
    """Over many seeds a document is taken as often as its source's ratio says; words are kept, and one row a group stays open."""
    p = lambda i: 0.3 if pooled else 0.1 + i % 5 * 0.2
    sized = [dict(p=p(i), size=max(1, 400 // (1 + i % 40) ** 2), key=i, of="a" if i < 40 else "b", bucket=0) for i in range(70)]
    words = {g: sum(r["p"] * r["size"] for r in sized if r["of"] == g) for g in "ab"}
    total, rounds = np.zeros(70), 3000
    batch = pa.Table.from_pylist(sized).combine_chunks().to_batches()[0]
    for seed in range(rounds):
        rows = [r for part in mixing._meet(seed, pooled)(iter([batch.slice(0, 25), batch.slice(25, 30), batch.slice(55)])) for r in part.to_pylist()]
        assert len(rows) == 70
        for g in "ab":
            own = [r for r in rows if r["of"] == g]
            assert sum(0 < r["p"] < 1 for r in own) <= 1 and sum(r["p"] * r["size"] for r in own) == pytest.approx(words[g])
        for r in rows:
            total[r["key"]] += r["p"]
    assert np.abs(total / rounds - [p(i) for i in range(70)]).max() < 0.05


def test_mixture(docs, none):
    times = Counter()
    for r in mixing.mix(docs).collect():
        times[r["doc_id"], r["size"]] += r["copies"]
    whole = mixing.mixture(docs)
    assert whole.columns == docs.columns
    got = Counter((r["doc_id"], count_words(r["text"])) for r in whole.collect())
    assert got == Counter({k: v for k, v in times.items() if v})
    assert mixing.mix(none).collect() == [] and mixing.mixture(none).collect() == []


def words_of(rows):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 5}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def near_of(words):
    """All pairs by neighbouring strings that are words."""
    holes = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[i, w[:i] + "\0" + w[i + 1 :]].add(w)
    out = defaultdict(set)
    for group in holes.values():
        for a in group:
            out[a] |= group - {a}
    for w in words:
        for i in range(len(w)):
            if (b := w[:i] + w[i + 1 :]) in words:
                out[w].add(b)
                out[b].add(w)
    return out


def groups_of(words):
    near = near_of(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {w: (n, len(near[w]), form[w], words.get(form[w]), root(w)) for w, n in words.items()}


def got_groups(frame):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.group(frame).collect()}


def test_variants_of_documents(docs, none):
    words = words_of([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert got_groups(docs) == groups_of(words) and len(words) > 100
    assert got_groups(none) == {}


def test_variants_of_dense_words(spark):
    """Short alphabets, runs of one letter, prefixes of each other, edits at both ends, accents, very long words."""
    rng = random.Random(9)
    words = {"a" * n for n in range(6, 14)} | {"".join(rng.choice("abé") for _ in range(rng.randrange(6, 9))) for _ in range(700)}
    long = "".join(rng.choice("abcdefgh") for _ in range(3000))
    words |= {long, long[:-1], long[1:], long[:1500] + "z" + long[1501:], long[:1500] + long[1502:], "zz" + long}
    words |= {"letter", "letters", "lettter", "etters", "xetter", "lettex", "ÿetter", "better"}
    near = near_of(words)
    frame = spark.createDataFrame([(w,) for w in sorted(words)], "word string").repartition(5)
    got = spelling.near(frame).collect()
    assert len(got) == len({(r["word"], r["other"]) for r in got})
    assert {(r["word"], r["other"]) for r in got} == {(a, b) for a in near for b in near[a]}
    assert all(is_near(r["word"], r["other"]) for r in got)


def test_variant_chains(spark):
    """Forms of forms; ties go to the smaller word; frequency exactly five times."""
    words = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "zzzzzz": 6, "zzzzzb": 30, "zzzzza": 30, "qqqqqq": 5, "qqqqqr": 24}
    rows = [(100 + i, " ".join([w] * n)) for i, (w, n) in enumerate(words.items())]
    assert words_of(rows) == words
    got = got_groups(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert got == groups_of(words)
    assert got["aaaaaa"][4] == "aaabbb" and got["zzzzzz"][2] == "zzzzza" and got["qqqqqq"][2] is None


def coded(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error) and the digest by full searches in whole numbers."""
    kept = [(i, label, [math.floor(4096 * x) for x in v]) for i, v, label in rows
            if v and all(x is not None and math.isfinite(x) and abs(x) < 4096 for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not kept or len(kept[0][2]) % parts:
        return [], None
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    d = len(kept[0][2]) // parts
    part = lambda v, p: v[p * d : (p + 1) * d]
    books = [[part(v, p) for _, _, v in kept[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            won = defaultdict(list)
            for _, _, v in kept:
                won[nearest(part(v, p), books[p])[1]].append(part(v, p))
            books[p] = [[sum(c) // len(won[k]) for c in zip(*won[k], strict=True)] if k in won else e for k, e in enumerate(books[p])]
    out, labels = [], Counter()
    for i, label, v in kept:
        best = [nearest(part(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(e for e, _ in best), label))
        labels[label] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, c, e, labels[label]) for i, c, e, label in out], digest


def check_codes(frame, rows, **more):
    got = vector_codes.compress(frame, **more).collect()
    want, digest = coded(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=key) == sorted(want, key=key)
    assert {r["codebooks_sha256"] for r in got} <= {digest}
    return got


@pytest.mark.parametrize("cell", [64, 512, 5000])
def test_codes_by_full_search(spark, cell):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet").limit(300).persist()
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in frame.collect()]
    assert len(check_codes(frame.repartition(3), rows, cell=cell)) == len(rows)


def test_codes_of_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i % 40, [rng.choice([-0.5, 0.0, 0.25, 1e-4, -1e-4, 3.0]) for _ in range(16)], rng.choice([None, 1, 2])) for i in range(60)]
    rows += [(None, [0.5] * 16, None), (70, None, 1), (71, [None] * 16, 1), (72, [float("nan")] * 16, 1), (73, [float("inf")] * 16, 1),
             (74, [0.1] * 15 + [-float("inf")], 2), (75, [0.1] * 8, 2), (76, [], 2), (77, [1e30] * 16, 2), (78, [4095.9, -4095.9] * 8, 2)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumns({c: F.lit("x") for c in ("v", "code", "of", "n", "error")})
    check_codes(frame.repartition(4), rows)
    few = rows[:5]
    check_codes(spark.createDataFrame(few, "vec_id bigint, embedding array<float>, label int"), [(i, [float(np.float32(x)) for x in v], n) for i, v, n in few])
    for bad in ([], [(1, [0.5] * 7, 1)], [(1, None, 1)]):
        assert vector_codes.compress(spark.createDataFrame(bad, "vec_id bigint, embedding array<float>, label int")).collect() == []


def test_cells_spare_searches_and_lose_nothing(monkeypatch):
    rng = np.random.default_rng(6)
    entries = rng.integers(-2000, 2000, (16, 4))
    entries[5] = entries[3]  # a tie that index 3 must win
    x = (entries[rng.integers(0, 16, 5000)] + rng.integers(-300, 300, (5000, 4))).astype(np.int64)
    full = ((x[:, None] - entries[None]) ** 2).sum(2)
    for held in (1 << 16, 10):
        monkeypatch.setattr(vector_codes, "HELD_CELLS", held)
        cells = vector_codes.Cells(entries, 256)
        for _ in range(2):
            code, error = cells.nearest(x)
            assert (code == full.argmin(1)).all() and (error == full.min(1)).all()
        assert cells.evaluated < 2 * 5000 * 16 / 3


@pytest.mark.parametrize("name", ["op12_spelling_variants", "op13_vector_codes"])
def test_sql(spark, name):
    from rasterlake.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert compare(QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()) == ""
