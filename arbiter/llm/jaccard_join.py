"""Jaccard self-join of documents on word shingles by vertical partitioning of the global shingle order.

A document's set: distinct 5-word shingles of its lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+``; with fewer
words the whole sequence is one shingle; without words the set is empty and linked with nothing.  Two
documents link when 100 * |intersection| >= 75 * |union|.  Shingles are compared by hashes of at least 52 bits.

The global order is by document frequency (in powers of two, ``HOT`` and more together), then by hash.

1. Texts become sets in one pass.  Equal sets within a task's flush share one class.  The shingles are cut into
   fragments by the top bits of their hashes, one fragment a shard, and shuffled as packed blobs.  A shingle
   that ``HOT`` or more classes of one flush hold is known to be in the last part of the order, so only its
   count is sent to its shard: no line or passage, however frequent, can fill a fragment.
2. A fragment finds each shingle's frequency and sends the shingles of two or more classes back to their flush.
   The fragments' partial counts sum to r(x), the shingles of x that anyone shares: x can only link if
   100 r(x) >= 75 |x|.  What remains (sets in the global order) is written to the shared folder once.
3. Prefix filter: linked sets share one of their first |x| - ceil(0.75 |x|) + 1 shingles.  Every shared prefix
   shingle ties its classes to the smallest of them (a star, linear in the group); the connected components
   of these ties are blocks, and only classes of one block can link.
4. Blocks are packed into cells; a block of more than ``PART`` classes is cut into parts, one cell for every
   two parts.  In its cell, a class meets the classes that share a prefix shingle, fit in size and are not yet
   connected; their overlaps are counted fragment by fragment of the order, rarest first, summed per pair, and
   a pair leaves as soon as its sum and what is left can't reach the bound.  A cell returns a spanning forest
   of its links, fewer rows than it has classes.  Partial counts per pair stay inside the cell: sent from
   separate tasks they would be all pairs of a group.
5. Components of the links give ``component_id``, the smallest doc_id of all classes that are connected.

Nulls and odd input: null and empty texts have n_shingles 0 and their own id as component; a row with a null id
joins its class but never names it (all ids null: null); repeated rows give repeated results; rows that
share an id with different texts are separate members; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbiter.llm import words as W
from arbiter.llm.components import components
from arbiter.llm.registry import query
from arbiter.llm.shared import deltas, from_low, from_planes, home, low_planes, planes, undelta
from arbiter.llm.tables import broadcast_checked, load, materialize, shard_bits, small_batches

SIZE, PERCENT, HOT, FLUSH, PART, STEPS, NAME_PARTS = 5, 75, 64, 500_000, 500, 4, 16
LAST = HOT.bit_length() - 1  # the last part of the order
SALTS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x3C6EF372FE94F82A)
NO_ID = np.iinfo(np.int64).min
BLOB = "shard int, flush long, kind int, a binary, b binary"
SETS = "kind int, doc_id long, n long, key long, plen int, hashes binary"
DOCS, POSTINGS, COUNTS, KNOWN = range(4)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["shard", "flush", "kind", "a", "b"])


class _Flush:
    """Sets of one flush of a task: classes, their documents, and the distinct shingles of the classes."""

    def __init__(self, bits: int, number: int):
        self.bits, self.number = bits, number
        self.classes: dict[tuple, int] = {}
        self.docs: list[tuple[int, int, int]] = []
        self.hashes: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []
        self.held = 0

    def add(self, ids: np.ndarray, col: pa.Array, size: int) -> None:
        w = W.split(col)
        rows, h = W.shingles(w, W.hashes(w, lower=True), size)
        n = np.bincount(rows, minlength=len(ids))[:len(ids)]
        cut = np.concatenate([[0], np.cumsum(n)])
        sums = []
        for salt in SALTS:
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(h + salt))])
            sums.append(total[cut[1:]] - total[cut[:-1]])
        local, before = np.full(len(ids), -1, np.int64), len(self.classes)
        for i, sig in enumerate(zip(n.tolist(), sums[0].tolist(), sums[1].tolist())):
            if sig[0]:
                local[i] = self.classes.setdefault(sig, len(self.classes))
            self.docs.append((int(ids[i]), int(local[i]), sig[0]))
        fresh = np.zeros(len(ids), bool)  # the first row of every class that is new with this call
        u, first = np.unique(local, return_index=True)
        fresh[first[u >= before]] = True
        take = fresh[rows]
        self.hashes.append(h[take] >> np.uint64(max(0, 16 - self.bits)))  # bits + 48 bits, at most 64
        self.owners.append(local[rows[take]])
        self.held += int(take.sum())

    def rows(self) -> list[tuple]:
        bits, shards = self.bits, 1 << self.bits
        mine = home(self.number, shards)
        ids, local, n = (np.array(x, np.int64) for x in zip(*self.docs))
        sig = np.array([[s[0], s[1], s[2]] for s in self.classes], dtype=np.uint64).reshape(-1, 3)
        keys = W.mix(W.mix(sig[:, 1] + sig[:, 0] * W._C1) + sig[:, 2])
        out = [(mine, self.number, DOCS, np.concatenate([ids, local, n]).tobytes(), keys.tobytes() + sig[:, 0].tobytes())]
        if not self.held:
            return out
        h, owner = np.concatenate(self.hashes), np.concatenate(self.owners)
        width = min(64, bits + 48)
        order = np.argsort(h, kind="stable")
        h, owner = h[order], owner[order]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        count = np.diff(np.append(at, len(h)))
        hot = count >= HOT
        hot_each = np.repeat(hot, count)
        hh, ho = h[hot_each], owner[hot_each]
        if len(hh):
            o = np.argsort(ho, kind="stable")
            out.append((mine, self.number, KNOWN, deltas(ho[o]), planes(hh[o])))
        for kind, hs, xs in ((POSTINGS, h[~hot_each], owner[~hot_each]), (COUNTS, h[at[hot]], count[hot])):
            shard = (hs >> np.uint64(width - bits)).astype(np.int64)
            edges = np.searchsorted(shard, np.arange(shards + 1))
            for s in range(shards):
                a, b = edges[s], edges[s + 1]
                if b > a:
                    o = np.argsort(xs[a:b], kind="stable") if kind == POSTINGS else np.arange(b - a)
                    out.append((s, self.number, kind, deltas(xs[a:b][o]) if kind == POSTINGS else xs[a:b].astype(np.int64).tobytes(),
                                low_planes(np.ascontiguousarray(hs[a:b][o]))))
        return out


def _fragment(t: pa.Table, bits: int) -> pa.Table:
    """Frequencies of one fragment's shingles; those of two or more classes go back to their flush."""
    width = min(64, bits + 48)
    s = t["shard"][0].as_py()
    top = np.uint64(s) << np.uint64(width - bits) if width > bits else np.uint64(0)
    mask = np.uint64((1 << (width - bits)) - 1) if width - bits < 48 else np.uint64((1 << 48) - 1)
    out, hs, flush, owner, known_h, known_n = [], [], [], [], [], []
    for f, kind, a, b in zip(*(t[c].to_pylist() for c in ("flush", "kind", "a", "b"))):
        if kind in (DOCS, KNOWN):
            out.append((s, f, kind, a, b))
        elif kind == POSTINGS:
            own = undelta(a)
            hs.append(from_low(b))
            owner.append(own)
            flush.append(np.full(len(own), f, np.int64))
        else:
            known_h.append(from_low(b))
            known_n.append(np.frombuffer(a, np.int64))
    if hs:
        h, flush, owner = np.concatenate(hs) & mask, np.concatenate(flush), np.concatenate(owner)
        order = np.argsort(h, kind="stable")
        h, flush, owner = h[order], flush[order], owner[order]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        count = np.diff(np.append(at, len(h)))
        if known_h:
            kh, kn = np.concatenate(known_h) & mask, np.concatenate(known_n)
            i = np.searchsorted(h[at], kh)
            ok = (i < len(at)) & (h[at][np.minimum(i, len(at) - 1)] == kh)
            np.add.at(count, i[ok], kn[ok])
        level = np.minimum(np.floor(np.log2(count)), LAST).astype(np.uint8)
        size = np.diff(np.append(at, len(h)))
        keep = np.repeat(count >= 2, size)
        level = np.repeat(level, size)[keep]
        h, flush, owner = h[keep] | top, flush[keep], owner[keep]
        order = np.lexsort([owner, flush])
        h, flush, owner, level = h[order], flush[order], owner[order], level[order]
        at = np.flatnonzero(np.diff(flush, prepend=-1))
        for a, b in zip(at, np.append(at[1:], len(flush))):
            out.append((s, int(flush[a]), POSTINGS, deltas(owner[a:b]) + level[a:b].tobytes(), low_planes(np.ascontiguousarray(h[a:b]))))
    return pa.Table.from_batches([_batch(out)])


def _assemble(t: pa.Table, bits: int) -> pa.Table:
    """Documents of one flush, and the classes that can link with their shared shingles in the global order."""
    width = min(64, bits + 48)
    doc_rows, n, key = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner, level, hs = [], [], []
    for s, kind, a, b in zip(*(t[c].to_pylist() for c in ("shard", "kind", "a", "b"))):
        if kind == DOCS:
            doc_rows = np.frombuffer(a, np.int64).reshape(3, -1)
            key, n = np.frombuffer(b, np.int64).reshape(2, -1)
        elif kind == KNOWN:
            owner.append(undelta(a))
            hs.append(from_planes(b, np.uint64))
            level.append(np.full(len(hs[-1]), LAST, np.uint8))
        else:
            size = len(a) // 5
            owner.append(undelta(a[:4 * size]))
            level.append(np.frombuffer(a[4 * size:], np.uint8))
            low = from_low(b)
            top = np.uint64(s) << np.uint64(width - bits)
            hs.append((low & np.uint64((1 << (width - bits)) - 1)) | top if width - bits < 48 else low | top)
    ids, local, size = doc_rows
    out = {"kind": [np.zeros(len(ids), np.int32)], "doc_id": [ids], "n": [size], "key": [np.where(local >= 0, key[np.maximum(local, 0)] if len(key) else 0, 0)],
           "plen": [np.zeros(len(ids), np.int32)]}
    blobs: list[bytes | None] = [None] * len(ids)
    if owner:
        owner, level, hs = np.concatenate(owner), np.concatenate(level), np.concatenate(hs)
        r = np.bincount(owner, minlength=len(n))
        live = 100 * r >= PERCENT * n
        keep = live[owner]
        owner, level, hs = owner[keep], level[keep], hs[keep]
        order = np.lexsort([hs, level, owner])
        owner, hs = owner[order], hs[order]
        u = np.flatnonzero(np.bincount(owner, minlength=len(n)))
        cut = np.searchsorted(owner, u), np.searchsorted(owner, u, side="right")
        need = -(-PERCENT * n[u] // 100)
        plen = (n[u] - need + 1) - (n[u] - r[u])
        blobs += [hs[a:b].tobytes() for a, b in zip(*cut)]
        for name, col in (("kind", np.ones(len(u), np.int32)), ("doc_id", np.zeros(len(u), np.int64)), ("n", n[u]), ("key", key[u]),
                          ("plen", plen.astype(np.int32))):
            out[name].append(col)
    cols = {k: np.concatenate(v) for k, v in out.items()}
    doc = pa.array(cols["doc_id"], mask=(cols["doc_id"] == NO_ID))
    return pa.table({"kind": cols["kind"], "doc_id": doc, "n": cols["n"], "key": cols["key"], "plen": cols["plen"], "hashes": pa.array(blobs, pa.binary())})


def shingle_sets(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """kind 0: (doc_id, n, key) of every row; kind 1: (key, n, plen, hashes) of the classes that can link."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bits = shard_bits(src, 4 << 20)

    def run(batches):
        part, k, flush = TaskContext.get().partitionId(), 0, None
        for b in batches:
            for s in W.slices(b, "text"):
                flush = flush or _Flush(bits, (part << 20) | k)
                ids = s.column(0).fill_null(NO_ID).to_numpy()
                flush.add(ids, s.column(1), size)
                if flush.held >= FLUSH:
                    yield _batch(flush.rows())
                    flush, k = None, k + 1
        if flush:
            yield _batch(flush.rows())

    sent = small_batches(src).mapInArrow(run, BLOB)
    back = sent.groupBy("shard").applyInArrow(lambda t: _fragment(t, bits), BLOB)
    return back.groupBy("flush").applyInArrow(lambda t: _assemble(t, bits), SETS)


def ties(sets: DataFrame) -> DataFrame:
    """(a, b): every class tied to the smallest class of each prefix shingle that it shares."""
    def run(batches):
        for b in batches:
            key, plen = b.column(0).to_numpy(), b.column(1).to_numpy()
            hs = [np.frombuffer(x, np.int64)[:max(0, p)] for x, p in zip(b.column(2).to_pylist(), plen)]
            yield pa.record_batch([pa.array(np.concatenate([*hs, np.zeros(0, np.int64)]).astype(np.int64)),
                                   pa.array(np.repeat(key, [len(x) for x in hs]))], names=["h", "a"])

    prefix = sets.select("key", "plen", "hashes").mapInArrow(run, "h long, a long")
    centre = prefix.groupBy("h").agg(F.min("a").alias("b"), F.max("a").alias("top")).where("b <> top").select("h", "b")
    return prefix.join(centre, "h").where("a <> b").select("a", "b").distinct()


def join_cell(key: np.ndarray, n: np.ndarray, plen: np.ndarray, sets: list[np.ndarray], part: np.ndarray, across: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among the classes of one cell.

    ``across``: classes of which only pairs of different ``part`` are wanted (cells of two parts).
    """
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    place = np.arange(len(flat)) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    order = np.lexsort([owner, flat])
    lists_h, lists_owner = flat[order], owner[order]
    in_prefix = (place < plen[owner])[order]
    pre_h, pre_owner = lists_h[in_prefix], lists_owner[in_prefix]
    root = np.arange(len(sets))
    out = []

    def gather(h: np.ndarray, hs: np.ndarray, owners: np.ndarray, below: int) -> np.ndarray:
        a, b = np.searchsorted(hs, h), np.searchsorted(hs, h, side="right")
        got = [owners[i:j] for i, j in zip(a, b) if j - i > 1]
        got = np.concatenate(got) if got else np.zeros(0, np.int64)
        return got[got < below]

    for x in range(len(sets)):
        p = int(max(0, plen[x]))
        cand = np.unique(gather(sets[x][:p], pre_h, pre_owner, x))
        cand = cand[(root[cand] != root[x]) & (100 * np.minimum(n[cand], n[x]) >= PERCENT * np.maximum(n[cand], n[x]))]
        if across[x]:
            cand = cand[part[cand] != part[x]]
        if not len(cand):
            continue
        need = -(-PERCENT * (n[cand] + n[x]) // (100 + PERCENT))
        overlap = np.zeros(len(cand), np.int64)
        edges = np.linspace(0, size[x], STEPS + 1).astype(int)
        for a, b in zip(edges[:-1], edges[1:]):  # fragments of the order, rarest first
            got = gather(sets[x][a:b], lists_h, lists_owner, x)
            at = np.searchsorted(cand, got)
            at = at[(at < len(cand)) & (cand[np.minimum(at, len(cand) - 1)] == got)]
            overlap += np.bincount(at, minlength=len(cand))
            fits = overlap + (size[x] - b) >= need
            cand, need, overlap = cand[fits], need[fits], overlap[fits]
            if not len(cand):
                break
        for y in cand[overlap >= need]:
            if root[y] != root[x]:
                root[root == root[y]] = root[x]
                out.append((int(key[x]), int(key[y])))
    return out


def links(sets: DataFrame, blocks: DataFrame) -> DataFrame:
    """(a, b): links that connect exactly the classes that all links connect."""
    members = sets.join(blocks.withColumnsRenamed({"node": "key", "root": "block"}), "key")
    sizes = blocks.groupBy("root").agg(F.count("*").alias("m")).withColumnRenamed("root", "block")
    total = blocks.count()
    spread = max(1, total // 1000)
    members = members.join(sizes, "block").withColumn("parts", F.expr(f"cast(ceil(m / {PART}) as int)"))
    members = members.withColumn("part", F.expr("cast(if(parts = 1, 0, pmod(xxhash64(key), parts)) as int)"))
    small = F.expr("parts = 1")
    members = members.withColumn("other", F.explode(F.expr("if(parts = 1, array(0), sequence(0, parts - 1))")))
    cells = members.select(
        F.when(small, F.expr(f"pmod(xxhash64(block), {spread})")).otherwise(F.col("block")).alias("g"),
        F.when(small, F.lit(-1)).otherwise(F.least("part", "other")).alias("i"),
        F.when(small, F.lit(-1)).otherwise(F.greatest("part", "other")).alias("j"), "key", "n", "plen", "hashes", "part")

    def run(t: pa.Table) -> pa.Table:
        across = (t["i"].to_numpy() >= 0) & (t["i"].to_numpy() != t["j"].to_numpy())
        found = join_cell(t["key"].to_numpy(), t["n"].to_numpy(), t["plen"].to_numpy(),
                          [np.frombuffer(x, np.int64) for x in t["hashes"].to_pylist()], t["part"].to_numpy(), across)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return cells.groupBy("g", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicate_components(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    table = materialize(shingle_sets(docs, size))
    rows = table.where("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), "key")
    sets = materialize(table.where("kind = 1").groupBy("key").agg(F.first("n").alias("n"), F.first("plen").alias("plen"), F.first("hashes").alias("hashes")))
    blocks = components(ties(sets))
    roots = components(links(sets, blocks)).withColumnsRenamed({"node": "key"})
    low = rows.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("low"))
    linked = roots.join(low, "key")
    # a component may hold a third of all classes: its name meets them in NAME_PARTS parts
    name = linked.groupBy("root").agg(F.min("low").alias("name")).select("root", "name", F.explode(F.sequence(F.lit(0), F.lit(NAME_PARTS - 1))).alias("s"))
    linked = linked.withColumn("s", F.pmod(F.xxhash64("key"), F.lit(NAME_PARTS)).cast("int")).join(name, ["root", "s"]).select("key", "name")
    # written, so that both sides of the last join are shuffled for it alone and AQE can split a class of many rows
    named = materialize(low.join(linked, "key", "left").select("key", F.coalesce("name", "low").alias("component_id")))
    return (rows.withColumn("key", F.when(F.col("n_shingles") > 0, F.col("key"))).join(named, "key", "left")
            .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def drop_near_duplicates(docs: DataFrame, size: int = SIZE, max_broadcast: int = 1_000_000) -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns.

    Rows without an id stay.  Rows that repeat an id: the id stays if any of its rows does, and equal
    texts under it are reduced to one.
    """
    found = materialize(near_duplicate_components(docs, size).where("doc_id is not null"))
    flags = found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(F.col("doc_id") == F.col("component_id")).alias("keep"))
    gone = broadcast_checked(flags.where("not keep").select(F.col("doc_id").alias("_gone")), max_broadcast)
    kept = docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    again = flags.where("keep and rows > 1").select(F.col("doc_id").alias("_again"))
    if again.limit(1).count() == 0:
        return kept
    again = broadcast_checked(again, max_broadcast)
    return (kept.join(again, kept["doc_id"] == again["_again"], "left_anti")
            .union(kept.join(again, kept["doc_id"] == again["_again"], "left_semi").dropDuplicates(["doc_id", "text"])))


@query("op9_vertical_jaccard")
def op9_vertical_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``."""
    return near_duplicate_components(load(spark, sf_dir, "documents"))
