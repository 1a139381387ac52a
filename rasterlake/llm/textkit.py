"""Words and their hashes, vectorised over the raw bytes of Arrow string batches.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. A null text counts
as an empty one. Hashes have 64 bits: two different words agree with a chance
of 2**-64, which callers accept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; the vector kernels need about thirty times that.
SLICE_BYTES = 4 << 20

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BYTE = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}
#: Bytes of the longest span without a digest of its own.
WHOLE = 256


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= SLICE_BYTES + 1:
            _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all strings and where each begins."""
    strings = pc.fill_null(strings, "")
    wide = pa.types.is_large_string(strings.type)
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most so many bytes of text, or one row."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size)
    start = 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


@dataclass
class Words:
    """starts, ends: byte positions; bounds[d]:bounds[d + 1] are the words of text d."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def text(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode()


def words(data: np.ndarray, offsets: np.ndarray, spaces: np.ndarray = SPACES, cuts: np.ndarray | None = None) -> Words:
    """cuts: marks at which a further word begins inside of a run of bytes."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~spaces[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    if cuts is not None:
        edge[:-1] |= cuts
    starts = np.flatnonzero(inside[1:-1] & (edge[:-1] | ~inside[:-2]))
    ends = np.flatnonzero(inside[1:-1] & (edge[1:] | ~inside[2:])) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every span of bytes.

    The sum of powers that serves short spans is no safe one for long ones: from 2,048 bytes on, two can be built that agree.
    """
    total = np.zeros(len(data) + 1, np.uint64)
    whole = np.flatnonzero(ends - starts > WHOLE)
    table = _BYTE if not seed else mix(_BYTE + np.uint64(seed)) | np.uint64(1)
    np.cumsum(table[data] * _power(_STEP, len(data)), out=total[1:])
    h = (total[ends] - total[starts]) * _power(_BACK, len(data) + 1)[starts]
    h = mix(h + (ends - starts).astype(np.uint64) * _GRAM)
    if len(whole):
        raw, key = memoryview(np.ascontiguousarray(data)), seed.to_bytes(8, "little")
        h[whole] = [int.from_bytes(blake2b(raw[starts[i] : ends[i]], digest_size=8, key=key).digest(), "little") for i in whole]
    return h


def gram_hashes(word_hashes: np.ndarray, bounds: np.ndarray, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-word windows: (hash, first word, bounds by text).

    short: a text of 1 to n - 1 words has one window, all its words.
    """
    count = np.diff(bounds)
    full = np.maximum(count - n + 1, 0)
    per = np.where((full == 0) & (count > 0), 1, full) if short else full
    to = np.concatenate([[0], np.cumsum(per)])
    first = np.arange(to[-1]) - np.repeat(to[:-1] - bounds[:-1], per)
    length = np.repeat(np.minimum(count, n), per)
    h = np.zeros(len(first), np.uint64)
    padded = np.concatenate([word_hashes, np.zeros(n, np.uint64)])
    for k in range(n):
        # A shorter window stops early, so that it differs from its extensions.
        h = np.where(k < length, h * _GRAM + padded[first + k], h)
    return mix(h + length.astype(np.uint64)), first, to


def unique_per_doc(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of every text in ascending order, and their bounds."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    v, d = v[new], d[new]
    return v, np.searchsorted(d, np.arange(len(bounds)))
