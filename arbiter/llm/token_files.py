"""Token-ID output: Parquet files of token ids in document order, read selectively.

A row is a document: ``part`` (the file's number), ``doc_id``, ``start`` (tokens before it in its file), ``n_tokens``
and the list ``ids``.  Documents are dealt to files by ranges of doc_id, so the order of files and of rows in them is the
order of ids.  Ids are dictionary-coded, the numbers are delta-coded; the sizes of row groups and pages are parameters, and
Parquet's page indexes let a reader skip pages.  A small table beside the files has the tokens before each file, so
files are written in one pass, without counting first.  ``metadata`` reads no ids, ``documents`` and ``span`` (a stretch of the
whole token stream) only the pages that hold them.

Encoding is the tokenizers library's.  For byte-level BPE with its usual split pattern, texts are split into the pattern's
segments by numpy, the distinct segments of a slice that a worker hasn't met are encoded by the library, and ids are
gathered from the worker's table of at most ``CACHE`` segments.  The split is not trusted: the library splits a probe of every
character that a worker meets first, and texts with a character that is split otherwise, or with one of the vocabulary's
special strings, are encoded whole by the library; so is one text in ``check_every`` and compared.

Nulls and odd input: a null text is empty, and an empty text has the end id alone; null doc_ids come first; rows that share a
doc_id are ordered by a hash of the text, then as they were read; other columns are ignored.  A text longer than
a slice is encoded in pieces cut before a space.  An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbiter.llm import words as W
from arbiter.llm.registry import query
from arbiter.llm.tables import broadcast_checked, load, small_batches
from arbiter.session import scratch_path

END = 0
SLICE = 8 << 20
CACHE, CACHE_BYTES, TOGETHER = 800_000, 64 << 20, 50
ROW_GROUP, PAGE, PAGE_ROWS = 32 << 20, 128 << 10, 1000
MAX_PARTS = 100_000         # files whose first positions are broadcast
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
SCHEMA = "part int, doc_id long, start long, n_tokens int, ids array<int>"


def _classes() -> np.ndarray:
    """The split pattern's class of every code point (checked against the library when met)."""
    import unicodedata
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))
        out[c] = LETTER if k[0] == "L" else NUMBER if k[0] == "N" else SPACE if k in ("Zs", "Zl", "Zp") else OTHER
    out[[9, 10, 11, 12, 13, 0x85]] = SPACE
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first bytes of non-ASCII characters, and their code points."""
    at = np.flatnonzero(data >= 0xC0)
    lead = data[at].astype(np.int64)
    size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    cp = lead & np.array([0, 0, 0x1F, 0x0F, 0x07])[size]
    for k in (1, 2, 3):
        more = size > k
        cp[more] = cp[more] << 6 | data[at[more] + k] & 0x3F
    return at, cp


def segment_starts(data: np.ndarray, off: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """First bytes of the split pattern's segments of the rows; segments tile the bytes.

    A segment is a run of letters, numbers or other characters, with one plain space before it if there is one; a run
    of white space less its last character, if something follows; a contraction that begins at an apostrophe.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes[data]  # right for ASCII
    at, cp = code_points(data)
    kind_at = classes[cp]
    for k in range(4):
        more = (cp >= (0, 0x80, 0x800, 0x10000)[k])
        kind[at[more] + k] = kind_at[more]
    run = np.empty(n, bool)
    run[0] = True
    np.not_equal(kind[1:], kind[:-1], out=run[1:])
    rows = off[off < n]
    first = np.zeros(n, bool)
    first[rows] = True
    run |= first
    start = run.copy()
    after = np.flatnonzero(run & (kind != SPACE) & ~first)
    after = after[kind[after - 1] == SPACE]
    last = after - 1
    for _ in range(3):
        last = last - ((data[last] & 0xC0) == 0x80)
    start[last] = True
    start[after[data[after - 1] == 0x20]] = False
    # contractions: a lone apostrophe that begins a segment and the letters after it
    a = np.flatnonzero((data == 0x27) & start & run)
    end = off[np.searchsorted(off, a, side="right")]
    pad = np.concatenate([data, np.zeros(3, np.uint8)])
    x, y = pad[a + 1], pad[a + 2]
    one = (a + 1 < end) & np.isin(x, np.frombuffer(b"stmd", np.uint8))
    two = (a + 2 < end) & (((x == ord("r")) & (y == ord("e"))) | ((x == ord("v")) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l"))))
    start[a[one | two] + 1] = False
    for hit, size in ((one, 2), (two, 3)):
        cut = a[hit] + size
        start[cut[cut < n]] = True
    return np.flatnonzero(start)


class Encoder:
    """The library's ids of whole texts, by segments where that is the same."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        made = json.loads(self.library.to_str())
        split = made.get("pre_tokenizer") or {}
        self.by_segments = (made["model"]["type"] == "BPE" and not made["model"].get("dropout") and made.get("normalizer") is None
                            and made.get("truncation") is None and made.get("padding") is None
                            and (split.get("type"), split.get("add_prefix_space"), split.get("use_regex")) == ("ByteLevel", False, True))
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids of pieces that begin with a space
        self.spaced[[i for x, i in vocabulary.items() if x.startswith("Ġ")]] = True
        self.classes = _classes() if self.by_segments else np.zeros(0x110000, np.uint8)
        self.met, self.odd = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
        self._clear()
        if self.by_segments:
            self._meet(np.arange(128))

    def _clear(self) -> None:
        self.cache: dict[bytes, int] = {}
        self.flat, self.n_flat, self.key_bytes = np.zeros(1 << 16, np.int32), 0, 0
        self.first, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    def _meet(self, cps: np.ndarray) -> None:
        """Split probes of new characters as the library does; note those that are split otherwise."""
        for c in cps.tolist():
            x = chr(c)
            probe = f"a{x}1{x}!{x} {x}  {x}\n{x}{x}a"
            raw = np.frombuffer(probe.encode(), np.uint8)
            mine = segment_starts(raw, np.array([0, len(raw)]), self.classes)
            theirs = [len(probe[:a].encode()) for _, (a, _) in self.library.pre_tokenizer.pre_tokenize_str(probe)]
            self.odd[c] = mine.tolist() != theirs
        self.met[cps] = True

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: pa.Array) -> None:
        """Encode new segments by the library; those with a space in front together, as it ends the one before."""
        data, off = W.text_buffers(new)
        size = np.diff(off)
        pad = np.concatenate([data, np.zeros(2, np.uint8)])
        second = pad[off[:-1] + 1]
        together = (pad[off[:-1]] == 0x20) & (size > 1) & (size < 256) & (second < 128) & (self.classes[second] != SPACE)
        order = np.argsort(~together, kind="stable")
        n = int(together.sum())
        data, off = W.text_buffers(new.take(pa.array(order)))
        cuts = [*range(0, n, TOGETHER), n]
        ids = [np.array(x, np.int32) for x in self.whole([data[off[i]:off[j]].tobytes().decode() for i, j in zip(cuts, cuts[1:])])]
        spaced = [self.spaced[x] for x in ids]
        if [int(x.sum()) for x in spaced] != np.diff(cuts).tolist():  # a vocabulary whose pieces cross these spaces
            n, ids, spaced = 0, [], []
        first = np.flatnonzero(np.concatenate(spaced)) if n else np.zeros(0, np.int64)
        alone = self.whole([data[off[i]:off[i + 1]].tobytes().decode() for i in range(n, len(new))])
        ids += [np.array(x, np.int32) for x in alone]
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        counts = np.empty(len(new), np.int64)
        counts[order] = np.concatenate([np.diff(first, append=len(flat) - sum(map(len, alone))), np.array([len(x) for x in alone], np.int64)])
        at = np.empty(len(new), np.int64)
        at[order] = np.cumsum(counts[order]) - counts[order]
        have = len(self.cache)
        while self.n_flat + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while have + len(new) > len(self.first):
            self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size))
        self.flat[self.n_flat:self.n_flat + len(flat)] = flat
        self.first[have:have + len(new)] = self.n_flat + at
        self.size[have:have + len(new)] = counts
        self.n_flat += len(flat)
        self.cache.update(zip(new.to_pylist(), range(have, have + len(new))))

    def _entries(self, keys: pa.Array) -> np.ndarray:
        """Places in the table of distinct segments, which are learnt where they aren't there."""
        entry = np.fromiter(map(self.cache.get, keys.to_pylist(), repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(entry < 0)
        if len(new):
            some = keys.take(pa.array(new))
            size = int(pc.sum(pc.binary_length(some)).as_py())
            if len(self.cache) + len(new) > CACHE or self.key_bytes + size > CACHE_BYTES:
                self._clear()
                new, some, size = np.arange(len(keys)), keys, int(pc.sum(pc.binary_length(keys)).as_py())
            self.key_bytes += size
            entry[new] = len(self.cache) + np.arange(len(new))
            self._learn(some)
        return entry

    def _segments(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and numbers of ids of rows without odd characters and special strings."""
        rows = len(off) - 1
        starts = segment_starts(data, off, self.classes)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(rows, np.int64)
        edges = np.append(starts, len(data)).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        entry = self._entries(coded.dictionary)[coded.indices.to_numpy()]
        size = self.size[entry].astype(np.int64)
        before = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.first[entry] - before[:-1], size) + np.arange(before[-1])]
        return ids, np.diff(before[np.searchsorted(starts, off)])

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of UTF-8 bytes and offsets, and each row's number of ids."""
        if len(data) > SLICE and len(off) == 2 and len(cut := self._pieces(data)) > 1:
            parts = [self.encode(data[a:b], np.array([0, b - a])) for a, b in cut]
            return np.concatenate([p[0] for p in parts]), np.array([sum(int(p[1][0]) for p in parts)])
        apart = self._apart(data, off)
        if not apart.any():
            return self._segments(data, off)
        size = np.diff(off)
        kept = np.repeat(~apart, size)
        ids, counts = self._segments(data[kept], np.concatenate([[0], np.cumsum(size[~apart])]))
        some = iter(np.split(ids, np.cumsum(counts)[:-1]))
        odd = iter(self.whole([data[off[i]:off[i + 1]].tobytes().decode() for i in np.flatnonzero(apart)]))
        out = [np.array(next(odd), np.int32) if x else next(some) for x in apart]
        return np.concatenate(out), np.array([len(x) for x in out])

    def _apart(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Rows that the library has to encode whole."""
        if not self.by_segments:
            return np.ones(len(off) - 1, bool)
        at, cp = code_points(data)
        new = cp[~self.met[cp]]
        if len(new):
            self._meet(np.unique(new))
        hits = at[self.odd[cp]].tolist()
        if self.odd[:128].any():
            hits += np.flatnonzero(self.odd[data] & (data < 128)).tolist()
        raw = data.tobytes()
        for s in self.special:
            i = raw.find(s)
            while i >= 0:
                hits.append(i)
                i = raw.find(s, i + 1)
        out = np.zeros(len(off) - 1, bool)
        out[np.searchsorted(off, hits, side="right") - 1] = bool(hits)
        return out

    def _pieces(self, data: np.ndarray) -> list[tuple[int, int]]:
        """A long text cut before plain spaces between an ASCII letter and another, where a segment always begins."""
        if self._apart(data, np.array([0, len(data)])).any():
            return [(0, len(data))]
        ascii_letter = (data < 128) & (self.classes[np.minimum(data, 127)] == LETTER)
        cuts = np.flatnonzero((data[1:-1] == 0x20) & ascii_letter[:-2] & ascii_letter[2:]) + 1
        out, a = [], 0
        while len(data) - a > SLICE:
            k = np.searchsorted(cuts, a + SLICE, side="right") - 1
            if k < 0 or cuts[k] <= a:
                k += 1  # no such space for a slice's length: the next one there is
                if k >= len(cuts):
                    break
            out.append((a, int(cuts[k])))
            a = int(cuts[k])
        return [*out, (a, len(data))]


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def encoded(docs: DataFrame, tokenizer: str, end: int = END, files: int | None = None, check_every: int = 512) -> DataFrame:
    """The rows of the files, in order: a range of doc_id a partition."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    files = files or max(1, src.rdd.getNumPartitions())
    order = ["doc_id", "_hash", "_row"]
    src = src.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    dealt = src.repartitionByRange(files, *order).sortWithinPartitions(*order)

    def run(batches):
        enc, part, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for whole in batches:
            for b in W.slices(whole, "text", SLICE):
                data, off = W.text_buffers(b.column("text"))
                ids, counts = enc.encode(data, off)
                if check_every:
                    mark = b.column("_hash").to_numpy().view(np.uint64) % np.uint64(check_every) == 0
                    ends = np.cumsum(counts)
                    for i in np.flatnonzero(mark):
                        text = data[off[i]:off[i + 1]].tobytes().decode()
                        if enc.library.encode(text, add_special_tokens=False).ids != ids[ends[i] - counts[i]:ends[i]].tolist():
                            raise ValueError(f"encoding differs from the tokenizers library in a text of {len(text)} characters")
                ids = np.insert(ids, np.cumsum(counts), np.int32(end))
                edges = np.concatenate([[0], np.cumsum(counts + 1)])
                yield pa.record_batch([pa.array(np.full(len(counts), part, np.int32)), b.column("doc_id"), pa.array(at + edges[:-1]),
                                       pa.array((counts + 1).astype(np.int32)), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int32)))],
                                      names=["part", "doc_id", "start", "n_tokens", "ids"])
                at += int(edges[-1])

    return small_batches(dealt).mapInArrow(run, SCHEMA)


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END, files: int | None = None, row_group: int = ROW_GROUP,
          page: int = PAGE, page_rows: int = PAGE_ROWS, check_every: int = 512) -> None:
    """Write the token files of (doc_id, text) below ``path``, and the table of the files' first positions."""
    spark = docs.sparkSession
    numbers = {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "start", "n_tokens")}  # delta-coded by version 2
    (encoded(docs, tokenizer, end, files, check_every).write.mode("overwrite").option("compression", "zstd")
     .options(**{"parquet.compression.codec.zstd.level": "1", "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": str(row_group),
                 "parquet.page.size": str(page), "parquet.page.row.count.limit": str(page_rows), "parquet.enable.dictionary": "true", **numbers})
     .parquet(f"{path}/tokens"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    ends = spark.read.schema(SCHEMA).parquet(f"{path}/tokens").groupBy("part").agg(
        F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    ends.select("*", F.coalesce(F.sum("tokens").over(w), F.lit(0)).alias("before")).write.mode("overwrite").parquet(f"{path}/parts")


def _rows(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    parts = spark.read.parquet(f"{path}/parts").select("part", "before")
    rows = spark.read.schema(SCHEMA).parquet(f"{path}/tokens").select("part", "doc_id", "start", "n_tokens", *columns)
    return (rows.join(broadcast_checked(parts, MAX_PARTS), "part")
            .select("part", "doc_id", (F.col("before") + F.col("start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), *columns))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens) of all documents; the ids are not read."""
    return _rows(spark, path).drop("part")


def documents(spark: SparkSession, path: str, first_id: int | None = None, last_id: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a range of doc_ids (both included); other files, row groups and pages are skipped."""
    rows = _rows(spark, path, "ids").drop("part")
    rows = rows.where(F.col("doc_id") >= first_id) if first_id is not None else rows
    return rows.where(F.col("doc_id") <= last_id) if last_id is not None else rows


def span(spark: SparkSession, path: str, first: int, end: int) -> DataFrame:
    """(doc_id, start, ids) of the tokens ``first`` to ``end`` (excluded) of the whole stream, cut at both ends."""
    parts = spark.read.parquet(f"{path}/parts").where((F.col("before") < end) & (F.col("before") + F.col("tokens") > first))
    a, b = parts.agg(F.min("part"), F.max("part")).first()
    rows = _rows(spark, path, "ids").where(F.col("part").between(a if a is not None else 0, b if b is not None else -1))
    rows = rows.where((F.col("start") < end) & (F.col("start") + F.col("n_tokens") > first))
    lo = F.greatest(F.lit(first) - F.col("start"), F.lit(0))
    hi = F.least(F.lit(end) - F.col("start"), F.col("n_tokens"))
    return rows.select("doc_id", (F.col("start") + lo).alias("start"), F.slice("ids", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("ids"))


def checksums(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): the crc32 of the ids as little-endian unsigned 32-bit integers."""
    def run(batches):
        for b in batches:
            lists = b.column("ids")
            raw = memoryview(lists.flatten().to_numpy().astype("<u4").tobytes())
            at = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64) * 4
            crc = [zlib.crc32(raw[x:y]) for x, y in zip(at.tolist(), at[1:].tolist())]
            yield pa.record_batch([b.column(c) for c in ("doc_id", "start", "n_tokens")] + [pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return small_batches(rows.select("doc_id", "start", "n_tokens", "ids")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op11_token_files")
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all ``documents``, read back."""
    path = scratch_path(spark, "tokens")
    write(load(spark, sf_dir, "documents"), path, default_path())
    return checksums(documents(spark, path))
