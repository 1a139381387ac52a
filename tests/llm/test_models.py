"""Toxicity and context-tree scores: brute force and held-out accuracy."""

import math
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

from rasterlake.llm import context_tree, toxicity


def kernel(a, b):
    """Sum over pairs of three-letter subsequences, all positions tried."""
    def features(s):
        out = Counter()
        sym = [ord(c) - 97 if "a" <= c <= "z" else -1 if ord(c) < 128 else 26 + ord(c) % 6 for c in s]
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + toxicity.REACH)):
                    if min(sym[i], sym[j], sym[k]) >= 0:
                        out[sym[i], sym[j], sym[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    x, y = features(a), features(b)
    own = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(x[u] * y[u] for u in x) / own if own else 0.0


def test_kernel_by_brute_force():
    names = ["idiot", "pathetic", "réeux", "aaaa"]
    words = ["idiot", "i-d-i-o-t", "idxiyot", "id", "", "pathétic", "PATH", "réeuxpa", "aaaaaa", "tioidi", "12345", "i d i o t"]
    got = toxicity.Landmarks(names).kernel(words)
    for i, w in enumerate(words):
        for j, n in enumerate(names):
            k = kernel(w, n)
            assert got[i, j] == pytest.approx(min(k, 1) ** toxicity.POWER if k >= toxicity.FLOOR else 0, abs=1e-5)
    assert got[1, 0] > 0.02 and got[2, 0] > 0.02 and got[9, 0] < got[2, 0]


def test_units():
    w, _ = toxicity.units(pa.array(["You i d i o t, a b", None, "", "a b cd e f", "x"]))
    said = [[w.text(i) for i in range(a, b)] for a, b in zip(w.bounds[:-1], w.bounds[1:])]
    assert said[1] == said[2] == [] and said[4] == ["x"] and said[3] == ["a b", "cd", "e f"]
    assert said[0] == ["you", "i d i o", "t,", "a b"]


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").toPandas()
    assert got["held_out"].equals(got["doc_id"].map(lambda k: zlib.crc32(str(k).encode()) % 5 == 0))
    own = got[got["held_out"]]
    rank = own["score"].rank()
    bad = own["toxic"] == 1
    area = (rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    assert area > 0.8
    assert (own["predicted"] == own["toxic"]).mean() > 0.9
    assert ((got["score"] >= 0.5) == (got["predicted"] == 1)).all() and got["score"].between(0, 1).all()


def test_gapped_insults_score_high(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.train(docs, labels, rows=400)
    clean = "And the thin of that is on the with and here it was for them to this are from by the"
    said = {"plain": "idiot", "dots": "i.d.i.o.t", "inserted": "idi-ot", "spaced": "i d i o t", "none": "table"}
    rows = spark.createDataFrame([(i, f"{clean} {w} {clean}") for i, w in enumerate(said.values())], "doc_id bigint, text string")
    got = dict(zip(said, (r["score"] for r in sorted(toxicity.score(rows, model).collect(), key=lambda r: r["doc_id"]))))
    assert got["plain"] > 0.5 and got["none"] < 0.2
    assert min(got["dots"], got["inserted"], got["spaced"]) > 2 * got["none"]


def test_toxicity_odd_rows(docs, none, labels):
    model = toxicity.train(docs, labels)
    assert toxicity.score(docs, model).count() == docs.count()
    assert toxicity.score(none, model).collect() == []
    empty = toxicity.train(docs, labels.limit(0))
    assert len({r["score"] for r in toxicity.score(docs, empty).collect()}) == 1


def tree(texts, learnt, depth):
    """The model by dictionaries: code lengths of windows."""
    def windows(t):
        b = bytes([255] * depth) + t.encode() + b"\xff"
        return [b[i : i + depth + 1] for i in range(len(b) - depth)]

    counts, child = {}, {}
    for k, t in texts.items():
        for g in windows(t) if learnt(k) else ():
            for d in range(depth + 1):
                for j in range(8):
                    counts.setdefault((d, g[depth - d : depth], (1 << j) | (g[-1] >> (8 - j))), [0, 0])[(g[-1] >> (7 - j)) & 1] += 1
    kt = {k: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for k, (a, b) in counts.items()}
    for d in range(depth, -1, -1):
        for k in [k for k in counts if k[0] == d]:
            top = max(kt[k], child.get(k, 0.0))
            w = kt[k] if d == depth else top + math.log(0.5 * (math.exp(kt[k] - top) + math.exp(child[k] - top)))
            if d:
                above = (d - 1, k[1][1:], k[2])
                child[above] = child.get(above, 0.0) + w

    @lru_cache(None)
    def code(g):
        total = 0.0
        for j in range(8):
            node, bit, done, left, up = (1 << j) | (g[-1] >> (8 - j)), (g[-1] >> (7 - j)) & 1, 0.0, 1.0, 0.5
            for d in range(depth + 1):
                k = (d, g[depth - d : depth], node)
                if k not in counts:
                    done += left * up
                    break
                a, b = counts[k]
                up = (b + 0.5) / (a + b + 1)
                share = 1.0 if d == depth else 1 / (1 + math.exp(min(700.0, child[k] - kt[k])))
                done, left = done + left * share * up, left * (1 - share)
            total += math.log10(done if bit else 1 - done)
        return total

    return lambda t: sum(code(g) for g in windows(t))


LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.mark.parametrize(("common", "table"), [(22, 1 << 24), (4, 3000)])
def test_scores_by_brute_force(spark, texts, monkeypatch, common, table):
    """Also with few common words and the windows in several blocks."""
    monkeypatch.setattr(context_tree, "COMMON", common)
    monkeypatch.setattr(context_tree, "TABLE", table)
    some = {k: t[:3000].translate(LOWER) for k, t in list(texts.items())[:40]} | {k: texts[k].translate(LOWER) for k in (900_002, 900_003, 900_006)}
    learnt = lambda k: zlib.crc32(str(k).encode()) % 7 != 2
    frame = spark.createDataFrame(list(some.items()), "doc_id bigint, text string").repartition(3)
    words = {k: [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w] + ["\0end"] for k, t in some.items()}
    count = Counter(w for k in some if learnt(k) for w in words[k])
    n, v = sum(count.values()), len(count)
    model = tree(some, learnt, 3)
    rows = context_tree.score(frame, depth=3).collect()
    assert len(rows) == len(some)
    for r in rows:
        w = words[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not learnt(r["doc_id"]), len(w), sum(count[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w))
        assert r["score"] == pytest.approx(model(some[r["doc_id"]]), rel=1e-8)


def test_probabilities_sum_to_one(spark, texts):
    """Over all bytes that may follow a context."""
    rows = spark.createDataFrame([(2, list(texts.values())[1])], "doc_id bigint, text string")
    grams = context_tree.counts(rows, 2, 7, 2).where("kind = 0").select("key", "n")
    some = grams.selectExpr("shiftright(key, 8) c").distinct().orderBy("c").limit(5)
    every = some.selectExpr("explode(transform(sequence(0, 255), x -> shiftleft(c, 8) + x)) key").join(grams, "key", "left").na.fill(0, ["n"])
    got = context_tree.code_lengths(grams.union(every.where("n = 0").select("key", "n")), 2)
    sums = got.join(every.select("key"), "key").selectExpr("shiftright(key, 8) c", "power(10, log10p) p").groupBy("c").sum("p").collect()
    assert all(r[1] == pytest.approx(1.0) for r in sums) and len(sums) == 5


def test_lookup():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(-(1 << 62), 1 << 62, 5000))
    table = context_tree.Lookup.of(keys[::2], np.arange(len(keys[::2]), dtype=float))
    got, hit = table.get(keys)
    assert hit[::2].all() and not hit[1::2].any() and (got[::2] == np.arange(len(keys[::2]))).all() and not got[1::2].any()
    assert context_tree.Lookup.of(keys[:0], np.zeros(0)).get(keys)[1].sum() == 0


def test_context_tree_odd_rows(docs, none):
    rows = context_tree.score(docs).collect()
    assert len(rows) == docs.count()
    assert all(r["score"] < 0 and r["n_tokens"] >= 1 for r in rows)
    assert context_tree.score(none).collect() == []
