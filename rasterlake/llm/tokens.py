"""Token ids of whole texts with a given tokenizer file.

The tokenizer lower-cases, drops white space, and its pattern looks neither
across white space nor, in ASCII, across a border of letters and marks. So the
pieces between those borders are encoded once each and put together again; the
ids are those of encoding the whole text (tests compare them).
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rasterlake.llm.textkit import LOWER, buffers, span_hashes, words

#: Different pieces that one worker keeps; beyond it, the memory begins anew.
KEPT_PIECES = 3_000_000
_PER_CALL = 2000

#: 1 letters, 2 marks, 0 whatever the pattern may join to either: digits, the apostrophe, other alphabets.
_KIND = np.zeros(256, np.uint8)
for _c in range(0x21, 0x7F):
    _KIND[_c] = 1 if chr(_c).isalpha() else 0 if chr(_c).isdigit() or chr(_c) == "'" else 2


class Encoder:
    """Encodes string arrays; one per worker process."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # A token that the tokenizer cuts out of any text parts the pieces of one call.
        special = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special]
        self.special = [s for s, _ in special]
        self.mark, self.mark_id = special[-1]
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of pieces. ASCII letters are one word to the model; the rest goes through the whole tokenizer."""
        out: list = [None] * len(texts)
        rest = []
        for i, t in enumerate(texts):
            if t.isascii() and t.isalpha():
                out[i] = np.array([x.id for x in self.tokenizer.model.tokenize(t)], np.int32)
            else:
                rest.append(i)
        for i in range(0, len(rest), _PER_CALL):
            part = rest[i : i + _PER_CALL]
            joined = self.mark.join(texts[k] for k in part)
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int32)
            cut = np.flatnonzero(ids == self.mark_id)
            for k, a, b in zip(part, np.append(0, cut + 1), np.append(cut, len(ids)), strict=True):
                out[k] = ids[a:b]
        return out

    def _learn(self, w, hashes: np.ndarray) -> None:
        new, where = np.unique(hashes, return_index=True)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, new), len(self.keys) - 1)
            fresh = self.keys[at] != new
            new, where = new[fresh], where[fresh]
        if not len(new):
            return
        got = self._encode([w.text(i) for i in where])
        size = np.array([len(x) for x in got], np.int64)
        first = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, *got])
        keys = np.concatenate([self.keys, new])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.first = np.concatenate([self.first, first])[order]
        self.count = np.concatenate([self.count, size])[order]

    def encode(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the strings, and where those of each string begin."""
        strings = pc.fill_null(strings, "")
        whole = np.zeros(len(strings), bool)
        for s in self.special:
            whole |= pc.match_substring(strings, s).to_numpy(zero_copy_only=False)
        if whole.any():
            return self._with_special(strings, whole)
        data, offsets = buffers(strings)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        # A letter before a byte of another alphabet stays, as that may be an accent that joins it.
        data = np.where(np.append(data[1:], 0) < 0x80, LOWER[data], data)
        kind = _KIND[data]
        cuts = np.zeros(len(data), bool)
        cuts[1:] = kind[1:] + kind[:-1] == 3
        w = words(data, offsets, cuts=cuts)
        if not len(w.starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        hashes = span_hashes(data, w.starts, w.ends)
        if len(self.keys) > KEPT_PIECES:
            self._forget()
        self._learn(w, hashes)
        at = np.searchsorted(self.keys, hashes)
        first, count = self.first[at], self.count[at]
        to = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.arange(to[-1]) + np.repeat(first - to[:-1], count)]
        return ids, to[w.bounds]

    def _with_special(self, strings: pa.Array, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts that hold a special token go through the tokenizer as they are."""
        rest, bounds = self.encode(strings.filter(pa.array(~whole)))
        parts, k = [], 0
        for i, alone in enumerate(whole):
            if alone:
                parts.append(np.array(self.tokenizer.encode(strings[i].as_py(), add_special_tokens=False).ids, np.int32))
            else:
                parts.append(rest[bounds[k] : bounds[k + 1]])
                k += 1
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
