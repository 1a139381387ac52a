"""Token files and packing: exact ids, places and whole sequences."""

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from rasterlake.llm import packing, textkit, token_files
from rasterlake.llm.queries import tokenizer_path
from rasterlake.llm.tokens import encoder


def whole(text):
    return encoder(tokenizer_path()).tokenizer.encode(text or "", add_special_tokens=False).ids


ODD = ["a<|endoftext|>b <|startoftext|>", "é é ́x ΑΣ Σ J̌ É İ", "x y don't'S it's-'ll a1b,c.D", "", None, " \n\t ", "x\x1cy\x85z", "<|endoftext|", "a'b'' 'sx", "KK 'S", "\U0001f600!!a"]


def test_piecewise_ids_are_those_of_whole_texts(texts):
    strings = [*ODD, *texts.values()]
    ids, bounds = encoder(tokenizer_path()).encode(pa.array(strings, pa.string()))
    for s, a, b in zip(strings, bounds[:-1], bounds[1:], strict=True):
        assert ids[a:b].tolist() == whole(s)


def thue_morse(n, swap=False):
    """Two words that a sum of powers modulo 2**64 cannot tell apart."""
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


@pytest.mark.parametrize("n", [256, 512, 2048, 4096])
def test_built_words_are_told_apart(n):
    a, b = thue_morse(n), thue_morse(n, True)
    ids, bounds = encoder(tokenizer_path()).encode(pa.array([a, b, f"{a} {b}"]))
    assert [ids[x:y].tolist() for x, y in zip(bounds[:-1], bounds[1:], strict=True)] == [whole(a), whole(b), whole(f"{a} {b}")]
    data = np.frombuffer((a + b).encode(), np.uint8)
    for seed in (0, 5):
        one, other = textkit.span_hashes(data, np.array([0, n]), np.array([n, 2 * n]), seed)
        assert one != other


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_files_round_trip(spark, docs, tmp_path, encoding):
    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs, path, tokenizer_path(), 2, encoding=encoding, row_group_bytes=1 << 16)
    rows = token_files.read_starts(spark, path).orderBy("start").collect()
    assert [r["doc_id"] or -1 for r in rows] == sorted(r["doc_id"] or -1 for r in rows)
    at = 0
    for r in rows:
        assert (r["start"], r["n_tokens"], r["tokens"][-1]) == (at, len(r["tokens"]), 2)
        at += r["n_tokens"]
    want = sorted(((r["doc_id"], [*whole(r["text"]), 2]) for r in docs.collect()), key=str)
    assert sorted(((r["doc_id"], r["tokens"]) for r in rows), key=str) == want
    crc = token_files.ids_crc32(token_files.read_starts(spark, path), ("doc_id", "start", "n_tokens")).collect()
    assert sorted((r["doc_id"] or -1, r["ids_crc32"]) for r in crc) == sorted((k or -1, zlib.crc32(np.array(i, "<u4").tobytes())) for k, i in want)
    # The encodings asked for, and page indexes.
    files = [pq.ParquetFile(f) for f in (tmp_path / "tokens").glob("*.parquet")]
    columns = [f.metadata.row_group(0).column(k) for f in files if f.metadata.num_rows for k in range(f.metadata.num_columns)]
    ids = [c for c in columns if c.path_in_schema.startswith("tokens")]
    assert all(("RLE_DICTIONARY" if encoding == "dictionary" else "DELTA_BINARY_PACKED") in c.encodings for c in ids)
    assert all(c.has_column_index and c.has_offset_index for c in columns if c.path_in_schema == "doc_id")
    some = token_files.read_tokens(spark, path, ("doc_id", "n_tokens"), 10, 20)
    assert {r["doc_id"] for r in some.collect()} == {r["doc_id"] for r in rows if 10 <= (r["doc_id"] or -1) <= 20}
    scan = some._jdf.queryExecution().executedPlan().toString()
    assert "array" not in scan.split("ReadSchema")[1] and "GreaterThanOrEqual(doc_id,10)" in scan


def test_empty_files(spark, none, tmp_path):
    path = str(tmp_path / "none")
    token_files.write_tokens(none, path, tokenizer_path(), 2)
    assert token_files.read_starts(spark, path).collect() == []


def check_packed(rows, size):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return len(by_sequence)


@pytest.mark.parametrize("size", [64, 2048])
def test_packing(docs, size):
    rows = packing.pack(docs, tokenizer_path(), size=size, with_ids=True, rounds=20).collect()
    used = check_packed(rows, size)
    total = sum(r["length"] for r in rows)
    assert used <= 1.02 * -(-total // size) + 2
    got = {}
    for r in sorted(rows, key=lambda r: r["piece"]):
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    want = sorted((d["doc_id"] or -1, p, p * size, tuple(ids[p * size : (p + 1) * size]))
                  for d in docs.collect() for ids in [[*whole(d["text"]), 0]] for p in range(-(-len(ids) // size)))
    got = sorted((r["doc_id"] or -1, r["piece"], r["start"], tuple(r["ids"])) for r in rows)
    assert got == want


def test_packing_nothing(none):
    assert packing.pack(none, tokenizer_path()).collect() == []


@pytest.mark.parametrize(("lengths", "counts", "best"), [
    ([1], [5], 1), ([10], [7], 7), ([5], [9], 5), ([3, 7], [4, 4], 4), ([2, 3, 5], [10, 10, 10], 10), ([4, 6, 10], [1000, 1000, 500], 1500), ([], [], 0),
    ([3], [1000], 334), ([6], [11], 11),
])
def test_plan_is_whole_and_best(lengths, counts, best):
    lengths, counts = np.array(lengths, np.int64), np.array(counts, np.int64)
    planned = packing.plan(lengths, counts, 10)
    assert sum(n for _, n in planned) == best
    assert sum((c * n for c, n in planned), np.zeros(len(lengths), np.int64)).tolist() == counts.tolist()
    assert all(0 < c @ lengths <= 10 and n > 0 for c, n in planned)


def test_knapsack_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = np.unique(rng.integers(1, 15, 4))
        values = rng.random(len(lengths)) * 10
        best = np.zeros(31)
        for room in range(1, 31):
            best[room] = max([best[room - 1], *(best[room - k] + v for k, v in zip(lengths, values, strict=True) if k <= room)])
        got = packing.knapsack(values, lengths, 30)
        assert got @ lengths <= 30 and got @ values == pytest.approx(best[30])
