"""Vectorised words, shingles and hashes over Arrow batches of texts.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. A batch is walked in pieces
of about a megabyte of text, so memory is bounded by the piece or by the longest text.
A word's hash is 128 bits: of up to 15 bytes a permutation of the bytes and their number, so that different words never
have equal ones, of more bytes a cryptographic digest. Its halves are two independent 64-bit hashes, and what must be exact is
decided by both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = _BYTE.copy()
_FOLD[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = np.arange(97, 123)
#: Masks of the first 0 to 16 bytes of two lanes.
_FIRST = np.array([[(1 << 8 * min(k, 8)) - 1, (1 << 8 * max(0, k - 8)) - 1] for k in range(17)], np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser, a bijection of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix32(x: np.ndarray) -> np.ndarray:
    """Murmur3's 32-bit finaliser, a bijection of 32-bit integers."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = max(n, PIECE + 4096)
        for k, base in enumerate((_BASE, _BACK)):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


@dataclass
class Piece:
    """Some consecutive texts of a batch: ``first`` is the number of the first one."""

    first: int
    data: np.ndarray
    offsets: np.ndarray  # of texts in data, one more than texts
    start: np.ndarray  # of words in data
    end: np.ndarray
    word_at: np.ndarray  # of texts in words, one more than texts

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def digests(self, fold: bool = False) -> np.ndarray:
        """Two 64-bit hashes of each word (words x 2); ``fold``: A-Z as a-z."""
        if not len(self.start):
            return np.empty((0, 2), np.uint64)
        data, size = _LOWER[self.data] if fold else self.data, self.end - self.start
        lanes = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(16, np.uint8)), 16)[self.start].view(np.uint64)
        lanes &= _FIRST[np.minimum(size, 16)]
        x, y = lanes[:, 0].copy(), lanes[:, 1] | size.astype(np.uint64) << np.uint64(56)
        for k in range(1, 4):
            x ^= mix64(y + np.uint64(k * _BASE % 2**64))
            y ^= mix64(x + _BYTE[k])
        lanes[:, 0], lanes[:, 1] = x, y
        long = np.flatnonzero(size > 15)
        raw = data.tobytes() if len(long) else b""
        known: dict[bytes, bytes] = {}
        for i, a, b in zip(long.tolist(), self.start[long].tolist(), self.end[long].tolist(), strict=True):
            word = raw[a:b]
            if (name := known.get(word)) is None:
                name = known[word] = hashlib.blake2b(word, digest_size=16).digest()
            lanes[i] = np.frombuffer(name, np.uint64)
        return lanes

    def hashes(self, fold: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; ``fold``: A-Z as a-z."""
        return np.ascontiguousarray(self.digests(fold)[:, 0])

    def words_in(self) -> np.ndarray:
        return np.diff(self.word_at)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word hashes, texts not minded; fewer than n words give none."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = h[:m] + np.uint64(_BASE)
    for k in range(1, n):
        out = mix64(out) + h[k : k + m]
    return mix64(out)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null is the empty text."""
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if offsets is None or len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), at


def pieces(texts: pa.Array) -> Iterator[Piece]:
    """An array of texts in pieces, with the bounds of their words."""
    data, at = buffers(texts)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, side="right")) - 1)
        yield piece(data[at[i] : at[j]], at[i : j + 1] - at[i], i)
        i = j


def piece(part: np.ndarray, offsets: np.ndarray, first: int = 0) -> Piece:
    word = ~_SPACE[part]
    if not len(part):
        none = np.empty(0, np.int64)
        return Piece(first, part, offsets, none, none, np.zeros(len(offsets), np.int64))
    cut = np.zeros(len(part) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(part), bool)
    before[0] = False
    before[1:] = word[:-1]
    before &= ~cut[:-1]
    after = np.empty(len(part), bool)
    after[-1] = False
    after[:-1] = word[1:]
    after &= ~cut[1:]
    start = np.flatnonzero(word & ~before)
    end = np.flatnonzero(word & ~after) + 1
    return Piece(first, part, offsets, start, end, np.searchsorted(start, offsets))


def of_texts(texts: list[str | None]) -> Piece:
    raw = [(t or "").encode() for t in texts]
    return piece(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def shingles(d: np.ndarray, n: int) -> np.ndarray:
    """Both hashes of each n-word shingle of one text (shingles x 2), in order; a shorter text is one shingle, an empty one has none."""
    if len(d) >= n:
        return np.stack([grams(d[:, 0], n), grams(d[:, 1], n)], 1)
    return np.frombuffer(hashlib.blake2b(d.tobytes(), digest_size=16, key=b"short").digest(), np.uint64).reshape(1, 2) if len(d) else np.empty((0, 2), np.uint64)


def shingle_sets(p: Piece, n: int, fold: bool = True) -> Iterator[np.ndarray]:
    """Of each text its distinct shingles by both hashes (shingles x 2), sorted by the first."""
    d = p.digests(fold)
    both = [grams(np.ascontiguousarray(d[:, k]), n) for k in range(2)]
    for i in range(len(p)):
        a, b = int(p.word_at[i]), int(p.word_at[i + 1])
        if b - a >= n:
            first, at = np.unique(both[0][a : b - n + 1], return_index=True)
            yield np.stack([first, both[1][a + at]], 1)
        else:
            yield shingles(d[a:b], n)


def set_keys(sets: Iterable[np.ndarray]) -> list[bytes]:
    """128 bits that name each set of shingles."""
    return [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column of arrays."""
    at = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, kind))
