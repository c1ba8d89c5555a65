"""Vectorised words and word-window hashes over Arrow text columns.

A word is a maximal run of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``; white space is
ASCII, so splitting UTF-8 bytes equals splitting code points).  A word's 64-bit hash is a
multilinear sum over its bytes, finished by a bit mixer; words of more than ``LONG`` bytes are
hashed by BLAKE2b.  Everything is computed on whole slices of a batch with numpy, a few dozen
nanoseconds a word, and depends on the bytes alone: any executor gets the same numbers again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LONG = 256
SLICE_BYTES = 2 << 20
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POS = _rng.integers(1, 2**63, LONG, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE[SPACE] = 0
_LOWER = _BYTE.copy()
_LOWER[0x41:0x5B] = _BYTE[0x61:0x7B]
_TO_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_C1, _C2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher."""
    h = h ^ (h >> np.uint64(30))
    h *= _C1
    h ^= h >> np.uint64(27)
    h *= _C2
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Words:
    """Words of the rows of one slice: byte ranges in ``data``, row numbers, and rows' word counts."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    counts: np.ndarray
    first: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    _, off, data = col.buffers()
    kind = np.int64 if wide else np.int32
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, kind)[col.offset:col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch whose texts hold about ``limit`` bytes (one row at least)."""
    _, off = text_buffers(batch.column(batch.schema.get_field_index(column)))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield batch.slice(i, j - i)
        i = j


def split(col: pa.Array) -> Words:
    """Find the words of every row of a string column."""
    data, off = text_buffers(col)
    n = len(off) - 1
    is_word = ~SPACE[data]
    start, end = is_word.copy(), is_word.copy()
    if len(data):
        start[1:] &= ~is_word[:-1]
        end[:-1] &= ~is_word[1:]
        inner = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(data))]
        start[inner] = is_word[inner]
        end[inner - 1] = is_word[inner - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    row = np.searchsorted(off, starts, side="right") - 1
    counts = np.bincount(row, minlength=n)[:n] if n else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    return Words(data, off, starts, ends, row, counts.astype(np.int64), first)


def hash_one(word: bytes, lower: bool = False) -> int:
    """The hash of one word, as ``hashes`` gives it (a plain form for dictionaries and tests)."""
    if lower:
        word = word.translate(_TO_LOWER)
    if len(word) > LONG:
        return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    h = 0
    for b, p in zip(word, _POS.tolist()):
        h += int(_BYTE[b]) * p
    return int(mix(np.array([(h + len(word) * int(_STEP)) & (2**64 - 1)], np.uint64))[0])


def hashes(w: Words, lower: bool = False) -> np.ndarray:
    """64-bit hashes of all words; ``lower`` folds A-Z only."""
    if not len(w.starts):
        return np.zeros(0, np.uint64)
    table = _LOWER if lower else _BYTE
    out = np.empty(len(w.starts), np.uint64)
    size = w.ends - w.starts
    step = max(1, len(w.starts) * (1 << 20) // max(1, len(w.data)))
    for a in range(0, len(w.starts), step):
        b = min(a + step, len(w.starts))
        lo, hi = w.starts[a], w.ends[b - 1]
        if hi - lo > (4 << 20):  # very long words: keep the temporaries small
            for i in range(a, b):
                out[i] = hash_one(w.data[w.starts[i]:w.ends[i]].tobytes(), lower)
            continue
        at = w.starts[a:b] - lo
        run = np.diff(np.append(at, hi - lo))
        pos = np.arange(hi - lo) - np.repeat(at, run)
        np.minimum(pos, LONG - 1, out=pos)
        out[a:b] = np.add.reduceat(table[w.data[lo:hi]] * _POS[pos], at)
    out = mix(out + size.astype(np.uint64) * _STEP)
    for i in np.flatnonzero(size > LONG):
        out[i] = hash_one(w.data[w.starts[i]:w.ends[i]].tobytes(), lower)
    return out


def windows(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows inside one row, and the index of each window's first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = np.full(n, k, np.uint64)
    for j in range(k):
        acc *= _C2
        acc += h[j:j + n]
    at = np.flatnonzero(row[:n] == row[k - 1:k - 1 + n])
    return mix(acc[at]), at


def sequence_hash(h: np.ndarray) -> int:
    """Hash of a whole word sequence; equals ``windows`` for a window of that length."""
    acc = len(h)
    for x in h.tolist():
        acc = (acc * int(_C2) + x) & (2**64 - 1)
    return int(mix(np.array([acc], np.uint64))[0])


def shingles(w: Words, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each row, sorted by (row, hash): (row, hash).

    A row of fewer than ``k`` words, but not none, has its whole sequence as one shingle.
    """
    hs, at = windows(h, w.row, k)
    rows = w.row[at]
    few = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(few):
        extra = np.array([sequence_hash(h[w.first[i]:w.first[i + 1]]) for i in few], np.uint64)
        hs, rows = np.concatenate([hs, extra]), np.concatenate([rows, few])
    return distinct(rows, hs)


def distinct(rows: np.ndarray, hs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs, sorted."""
    if not len(hs):
        return rows.astype(np.int64), hs
    order = np.argsort(hs, kind="stable")
    order = order[np.argsort(rows[order], kind="stable")]
    rows, hs = rows[order], hs[order]
    keep = np.ones(len(hs), bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (hs[1:] != hs[:-1])
    return rows[keep].astype(np.int64), hs[keep]


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of a per-byte array over each row's bytes."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]
