"""Sorted arrays in the shared folder, written by tasks and memory-mapped by workers.

The folder is a sub-folder of ``spark.checkpoint.dir``.  Files are written under a temporary name and
renamed, and their content depends on the input alone, so a task that runs again (retry, speculation,
lost executor) replaces a file by the same bytes.  On a file system that workers mount, arrays are
mapped in place; from another store a worker fetches the file, maps it and unlinks its copy at once.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow.fs as pafs

_open: dict[str, np.ndarray] = {}


class ArrayStore:
    """Named one-dimensional arrays below one folder."""

    def __init__(self, uri: str):
        self.uri = uri.rstrip("/")
        u = urlparse(self.uri)
        self.local = u.path if u.scheme in ("", "file") else None

    def save(self, name: str, array: np.ndarray) -> None:
        if self.local:
            os.makedirs(self.local, exist_ok=True)
            tmp = f"{self.local}/.{name}-{uuid.uuid4().hex}"
            with open(tmp, "wb") as f:
                np.save(f, array)
            os.replace(tmp, f"{self.local}/{name}.npy")
            return
        fs, path = pafs.FileSystem.from_uri(self.uri)
        fs.create_dir(path, recursive=True)
        tmp = f"{path}/.{name}-{uuid.uuid4().hex}"
        with fs.open_output_stream(tmp) as f:
            np.save(f, array)
        fs.move(tmp, f"{path}/{name}.npy")

    def load(self, name: str) -> np.ndarray:
        key = f"{self.uri}/{name}"
        if key not in _open:
            if len(_open) > 4096:
                _open.clear()
            if self.local:
                _open[key] = np.load(f"{self.local}/{name}.npy", mmap_mode="r")
            else:
                fs, path = pafs.FileSystem.from_uri(self.uri)
                fd, copy = tempfile.mkstemp(suffix=".npy")
                with fs.open_input_stream(f"{path}/{name}.npy") as f, os.fdopen(fd, "wb") as out:
                    while part := f.read(8 << 20):
                        out.write(part)
                _open[key] = np.load(copy, mmap_mode="r")
                os.unlink(copy)
        return _open[key]


def planes(a: np.ndarray) -> bytes:
    """Little-endian integers as byte planes: planes of zeros vanish in the shuffle's compression."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()


def from_planes(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys: high halves as differences, both halves as byte planes."""
    hi, lo = (keys >> np.uint64(32)).astype(np.uint32), keys.astype(np.uint32)
    return planes(np.diff(hi, prepend=np.uint32(0)).astype(np.uint32)) + planes(lo)


def unpack_sorted(b: bytes) -> np.ndarray:
    half = len(b) // 2
    hi = np.cumsum(from_planes(b[:half], np.uint32), dtype=np.uint64)
    return (hi << np.uint64(32)) | from_planes(b[half:], np.uint32).astype(np.uint64)


def sum_by_key(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at)


def low_planes(h: np.ndarray) -> bytes:
    """The low 48 bits of hashes as six byte planes."""
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def from_low(b: bytes) -> np.ndarray:
    """The hashes (low 48 bits) of ``low_planes``."""
    raw = np.frombuffer(b, np.uint8).reshape(6, -1).T
    out = np.zeros((raw.shape[0], 8), np.uint8)
    out[:, :6] = raw
    return out.view(np.uint64).reshape(-1)


def deltas(a: np.ndarray) -> bytes:
    """Ascending numbers below 2^32 as differences."""
    return planes(np.diff(a, prepend=0).astype(np.uint32))


def undelta(b: bytes) -> np.ndarray:
    return np.cumsum(from_planes(b, np.uint32), dtype=np.int64)


def home(flush: int, shards: int) -> int:
    """The shard through which a flush (partition << 20 | number) passes on what only concerns itself; all shards alike."""
    return ((flush >> 20) + (flush & 0xFFFFF)) % shards
