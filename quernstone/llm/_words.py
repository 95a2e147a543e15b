"""Words and word n-grams of many texts at once, on the UTF-8 bytes of an Arrow column.

A word is ``[^\\x20\\x09-\\x0D]+``.  All work is done by numpy on whole byte
arrays; nothing loops over documents or words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_BASE = 0x9E3779B97F4A7C15
_STEP = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes (multiply and xor-shift); a bijection."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def same_bytes(a: np.ndarray, a0: np.ndarray, a1: np.ndarray, b: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
    """Whether the bytes a[a0:a1] are those of b[b0:b1], for each pair of slices, eight at a time; both end in eight spare bytes."""
    same = a1 - a0 == b1 - b0
    one, two = (np.ndarray((len(x) - 7,), "<u8", np.ascontiguousarray(x), strides=(1,)) for x in (a, b))
    own = np.flatnonzero(same)
    x, y, left = a0[own], b0[own], (a1 - a0)[own]
    while len(own):
        bad = ((one[x] ^ two[y]) & _MASK[np.minimum(left, 8)]) != 0
        same[own[bad]] = False
        more = ~bad & (left > 8)
        own, x, y, left = own[more], x[more] + 8, y[more] + 8, left[more] - 8
    return same


class Words:
    """Words of a column of texts: ``start``/``end`` byte places, ``first`` word of each row, 64-bit ``hash``es.

    terms: words are runs of ASCII letters, digits and other non-ASCII characters instead.
    """

    def __init__(self, texts, lower: bool = False, terms: bool = False):
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and n else np.zeros(0, np.uint8)
        at = at - at[0]
        self.n, self.raw, self.at = n, raw, at
        if terms:
            word = ((raw | np.uint8(32)) - np.uint8(97) < 26) | (raw - np.uint8(48) < 10) | (raw > 127)
        else:
            word = (raw != 32) & (raw - np.uint8(9) > 4)
        edge = np.empty(len(raw) + 1, bool)  # where a run of word bytes starts or, one further, ends
        edge[0] = len(raw) > 0 and word[0]
        edge[-1] = len(raw) > 0 and word[-1]
        np.not_equal(word[1:], word[:-1], out=edge[1:-1])
        inner = at[1:-1]
        inner = np.unique(inner[(inner > 0) & (inner < len(raw))])
        joined = inner[word[inner] & word[inner - 1]]  # a row ends within a run
        edges = np.flatnonzero(edge)
        if len(joined):
            edges = np.sort(np.concatenate((edges, joined, joined)))
        self.start, self.end = edges[::2], edges[1::2]
        self.first = np.searchsorted(self.start, at)
        self.hash = self._hashes(raw + (raw - np.uint8(65) < 26) * np.uint8(32) if lower else raw)

    def _hashes(self, seen: np.ndarray) -> np.ndarray:
        """Of each word, from its length and its bytes, eight at a time."""
        length = self.end - self.start
        h = length.astype(np.uint64) * U(_BASE)
        eight = np.ndarray((len(seen),), "<u8", np.concatenate((seen, np.zeros(8, np.uint8))), strides=(1,))
        own, start, left = None, self.start, length
        while len(start):
            part = eight[start]
            part &= _MASK[np.minimum(left, 8)]
            if own is None:
                h = mix(h ^ part)
            else:
                h[own] = mix(h[own] ^ part)
            more = np.flatnonzero(left > 8)
            own = more if own is None else own[more]
            start, left = start[more] + 8, left[more] - 8
        return h

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts())

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (word numbers) at which n words of one row start, and the hashes of these n words."""
        total = len(self.hash)
        if total < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.zeros(total - n + 1, np.uint64)
        for k in range(n):
            h *= U(_STEP)
            h += self.hash[k : total - n + 1 + k]
        left = np.repeat(self.first[1:], self.counts())[: total - n + 1] - np.arange(total - n + 1)
        place = np.flatnonzero(left >= n)
        return place, mix(h[place] + U(n))
