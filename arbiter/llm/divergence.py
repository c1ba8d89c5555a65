"""Source divergence audit: how the words of each source differ from its language's other sources.

Two passes over whole texts.  The first counts, exactly, in how many documents of a language each term occurs and
keeps the terms of at least ``MIN_DOCS``.  The kept terms of a language are cut into shards of about ``KEYS``; each
shard gets a minimal perfect hash (levels of bits: a key owns a bit that no other key of its level hit, its slot is the
number of bits before it), built by one task.  Shards go to the workers in waves of at most about ``WAVE_BYTES``, which
is checked before they are collected; a wave is one broadcast.  The second pass (one for each wave) looks every distinct
term of a slice up, compares it with the key stored in its slot (terms over ``LONG_KEY`` bytes by a
256-bit digest), and increments dense counters, one array a (language, source) group; arrays are passed on when they
take ``DENSE_BYTES``.  Spark adds the counts up by (group, shard, slot), so a source of a third of all rows
sends what any other sends per task.

Shares: p = 1 + floor(1e9 (count + 2) / (N + 2 V)) in a group with N occurrences of the V kept terms of its language.
Two groups, or a group and its language, differ in a term by floor((p - q)^2 / (p + q)).  All arithmetic is on integers.

Nulls and odd input: null text, lang and source are empty strings; doc_id and other columns are ignored, and every row
counts as a document, repeated ones too.  An empty table has no rows; a language without kept terms has pairs of
value 0.  Values that tie are ranked by item.  Very long texts are a slice of their own, very long terms as any other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbiter.llm import words as W
from arbiter.llm.registry import query
from arbiter.llm.tables import broadcast_checked, by_slices, load, materialize, small_batches
from arbiter.operators.ordered import top_k

MIN_DOCS, TOP = 10, 10
KEYS = 4096                 # kept terms a shard
WAVE_BYTES = 24 << 20       # perfect hashes and stored keys in one broadcast
DENSE_BYTES = 64 << 20      # counters a task holds
SLICE = 4 << 20
BLOCK = 128                 # sources whose pairs one task compares
LONG_KEY, LEVELS = 48, 32
MAX_BROADCAST_ROWS = 100_000
_TERM = np.array([b >= 0x80 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256)])
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
_SHARD_SALT = np.uint64(0x6A09E667F3BCC908)


def terms(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Terms of a string column in order (A-Z lowered), and the row of each."""
    data, off = W.text_buffers(col)
    inside = _TERM[data]
    start, end = inside.copy(), inside.copy()
    if len(data):
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        cut = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(data))]
        start[cut] = inside[cut]
        end[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(start)
    ends = np.concatenate([[0], np.cumsum(np.flatnonzero(end) + 1 - starts)])
    values = pa.py_buffer(_LOWER[data[inside]])
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends.astype(np.int64)), values)
    return found, np.searchsorted(off, starts, side="right") - 1


def term_hashes(col: pa.Array) -> np.ndarray:
    """64-bit hashes of the strings of a column."""
    data, off = W.text_buffers(col)
    if not len(col):
        return np.zeros(0, np.uint64)
    return W.hashes(W.Words(data, off, off[:-1], off[1:], np.zeros(0, np.int64), np.zeros(0, np.int64), off))


def stored_keys(col: pa.Array) -> pa.Array:
    """What a slot keeps of its term: the bytes, or 0xFF (in no UTF-8 text) and a digest of long ones."""
    keys = col.cast(pa.large_binary())
    long = np.flatnonzero(pc.binary_length(keys).to_numpy(zero_copy_only=False) > LONG_KEY)
    if not len(long):
        return keys
    out = keys.to_pylist()
    for i in long:
        out[i] = b"\xff" + hashlib.blake2b(out[i], digest_size=32).digest()
    return pa.array(out, pa.large_binary())


def _position(h: np.ndarray, level: int, size: np.ndarray) -> np.ndarray:
    return (W.mix(h + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) % size).astype(np.int64)


def build_hash(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimal perfect hash of a shard: words of bits, words of each level, and the slot of every key.

    Keys that no level separates (equal hashes) get the last slots.
    """
    slot, left, bits, sizes = np.full(len(h), -1, np.int64), np.arange(len(h)), [], []
    at = 0
    for level in range(LEVELS):
        if not len(left):
            break
        words = -(-2 * len(left) // 64)
        pos = _position(h[left], level, np.uint64(words * 64))
        alone = np.bincount(pos, minlength=words * 64) == 1
        mine = alone[pos]
        slot[left[mine]] = (np.cumsum(alone) - 1)[pos[mine]] + at
        at += int(alone.sum())
        bits.append(np.packbits(alone, bitorder="little").view(np.uint64))
        sizes.append(words)
        left = left[~mine]
    slot[left] = at + np.arange(len(left))
    return np.concatenate(bits) if bits else np.zeros(0, np.uint64), np.array(sizes, np.int64), slot


class PerfectHashes:
    """The shards of one wave, looked up together: (lang, term) -> slot among the wave's slots."""

    def __init__(self, rows: list):
        """Rows (sid, lang, shard, shards, n, bits, sizes, keys), sorted by sid."""
        self.sid = np.array([r.sid for r in rows], np.int64)
        size = np.array([r.n for r in rows], np.int64)
        self.start = np.concatenate([[0], np.cumsum(size)])
        self.words = np.concatenate([np.frombuffer(r.bits, np.uint64) for r in rows])
        self.size = np.zeros((len(rows), LEVELS), np.int64)
        for k, r in enumerate(rows):
            s = np.frombuffer(r.sizes, np.int64)
            self.size[k, :len(s)] = s
        ends = np.cumsum(self.size.ravel()).reshape(self.size.shape)
        self.at = ends - self.size
        ones = np.bitwise_count(self.words).astype(np.int64)
        before = np.concatenate([[0], np.cumsum(ones)])
        first = self.at[:, 0]
        self.before = before[:-1] - np.repeat(before[first], ends[:, -1] - first)  # bits of the same shard before a word
        self.separated = before[ends[:, -1]] - before[first]
        self.keys = pa.array([k for r in rows for k in r.keys], pa.large_binary())
        self.langs: dict[str, tuple[int, np.ndarray]] = {}
        for k, r in enumerate(rows):
            self.langs.setdefault(r.lang, (int(self.start[k]), np.full(r.shards, -1, np.int64)))[1][r.shard] = k
        self.width = {lang: int(size[which[which >= 0]].sum()) for lang, (_, which) in self.langs.items()}

    def slots(self, lang: str, found: pa.Array) -> np.ndarray:
        """Slots of the distinct terms ``found`` of a language, -1 where the wave has no such term."""
        out = np.full(len(found), -1, np.int64)
        if lang not in self.langs or not len(found):
            return out
        which, h = self.langs[lang][1], term_hashes(found)
        shard = which[shard_of(h, len(which))]
        ask = np.flatnonzero(shard >= 0)
        for level in range(LEVELS):
            s = shard[ask]
            size = self.size[s, level]
            ask, s, size = ask[size > 0], s[size > 0], size[size > 0]
            if not len(ask):
                break
            pos = _position(h[ask], level, (size * 64).astype(np.uint64))
            word, bit = self.at[s, level] + (pos >> 6), (pos & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[ask[hit]] = (self.start[s] + self.before[word] + below)[hit]
            ask = ask[~hit]
        keys = stored_keys(found)
        some = np.flatnonzero(out >= 0)
        same = pc.equal(self.keys.take(pa.array(out[some])), keys.take(pa.array(some))).to_numpy(zero_copy_only=False)
        out[some[~same]] = -1
        for k in np.flatnonzero(np.diff(self.start) > self.separated):  # shards with keys of equal hashes
            a = int(self.start[k] + self.separated[k])
            at = pc.index_in(keys, self.keys.slice(a, int(self.start[k + 1]) - a))
            mine = np.flatnonzero(pc.is_valid(at).to_numpy(zero_copy_only=False) & (shard == k))
            out[mine] = a + at.to_numpy(zero_copy_only=False)[mine].astype(np.int64)
        return out


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (W.mix(h ^ _SHARD_SALT) % np.uint64(shards)).astype(np.int64)


def _lang_runs(batch: pa.RecordBatch, by: list[str]):
    """The batch sorted by ``by`` (first lang), and its runs of equal lang: (batch, [(lang, first row, end)])."""
    table = pa.Table.from_batches([batch])
    batch = table.take(pc.sort_indices(table, [(c, "ascending") for c in by])).combine_chunks().to_batches()[0]
    runs = pc.run_end_encode(batch.column("lang"))
    ends = runs.run_ends.to_pylist()
    return batch, list(zip(runs.values.to_pylist(), [0, *ends], ends))


def document_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, docs) of whole texts, exact."""
    def run(b: pa.RecordBatch):
        b, runs = _lang_runs(b, ["lang"])
        found, row = terms(b.column("text"))
        coded = found.dictionary_encode()
        code, n = coded.indices.to_numpy(), max(len(coded.dictionary), 1)
        for lang, lo, hi in runs:
            a, z = np.searchsorted(row, [lo, hi])
            once = pd.unique(row[a:z] * n + code[a:z]) % n
            term, times = np.unique(once, return_counts=True)
            if len(term):
                yield pa.record_batch([pa.array([lang]).take(pa.array(np.zeros(len(term), np.int32))),
                                       coded.dictionary.take(pa.array(term)).cast(pa.string()), pa.array(times, pa.int64())], names=["lang", "term", "docs"])

    sent = by_slices(docs.select("lang", "text"), "text", run, "lang string, term string, docs long", SLICE)
    return sent.groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def perfect_hashes(kept: DataFrame, keys: int = KEYS, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """One row a shard of (lang, term): sid, wave, lang, shard, shards, n, bits, sizes, keys, and its terms by slot."""
    size = kept.groupBy("lang").agg(F.ceil(F.count("*") / keys).cast("int").alias("shards"))
    rows = kept.select("lang", "term").join(broadcast_checked(size, MAX_BROADCAST_ROWS), "lang")

    def deal(batches):
        for b in batches:
            h, n = term_hashes(b.column("term")), b.column("shards").to_numpy()
            shard = (W.mix(h ^ _SHARD_SALT) % n.astype(np.uint64)).astype(np.int32) if len(h) else np.zeros(0, np.int32)
            yield pa.record_batch([*b.columns, pa.array(shard)], names=["lang", "term", "shards", "shard"])

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("term").combine_chunks()
        col = t["term"].combine_chunks()
        bits, sizes, slot = build_hash(term_hashes(col))
        order = pa.array(np.argsort(slot))
        by_slot = col.take(order)
        keys_of = stored_keys(by_slot)
        n_bytes = bits.nbytes + sizes.nbytes + sum(map(len, keys_of.to_pylist())) + 8 * len(keys_of)
        return pa.table({"lang": t["lang"].slice(0, 1), "shard": t["shard"].slice(0, 1), "shards": t["shards"].slice(0, 1), "n": pa.array([len(col)], pa.int32()),
                         "bytes": pa.array([n_bytes], pa.int64()), "bits": pa.array([bits.tobytes()], pa.binary()), "sizes": pa.array([sizes.tobytes()], pa.binary()),
                         "keys": pa.array([keys_of.to_pylist()], pa.list_(pa.binary())), "terms": pa.array([by_slot.to_pylist()], pa.list_(pa.string()))})

    dealt = small_batches(rows.select("lang", "term", "shards")).mapInArrow(deal, "lang string, term string, shards int, shard int")
    built = materialize(dealt.groupBy("lang", "shard").applyInArrow(
        build, "lang string, shard int, shards int, n int, bytes long, bits binary, sizes binary, keys array<binary>, terms array<string>"))
    # one narrow row a shard of thousands of terms: the order of all of them is a small table
    w = Window.orderBy("lang", "shard")
    place = built.select("lang", "shard", (F.row_number().over(w) - 1).alias("sid"),
                         F.floor((F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")) / wave_bytes).cast("int").alias("wave"))
    return materialize(built.join(broadcast_checked(place, MAX_BROADCAST_ROWS), ["lang", "shard"]))


def _recount(docs: DataFrame, hashes: PerfectHashes, dense_bytes: int) -> DataFrame:
    """(gid, sid, slot, count) of the terms of one wave, once a task and flush."""
    shipped = docs.sparkSession.sparkContext.broadcast(hashes)
    schema = "gid long, sid int, slot array<int>, count array<long>"

    def rows(held: dict, hashes: PerfectHashes) -> pa.RecordBatch:
        gid, sid, slots, counts = [], [], [], []
        for (lang, g), count in held.items():
            first = hashes.langs[lang][0]
            some = np.flatnonzero(count)
            shard = np.searchsorted(hashes.start, some + first, side="right") - 1
            for k in np.unique(shard):
                mine = some[shard == k]
                gid.append(g)
                sid.append(int(hashes.sid[k]))
                slots.append((mine + first - hashes.start[k]).astype(np.int32))
                counts.append(count[mine])
        return pa.record_batch([pa.array(gid, pa.int64()), pa.array(sid, pa.int32()), pa.array(slots, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                               names=["gid", "sid", "slot", "count"])

    def run(batches):
        hashes, held, used = shipped.value, {}, 0
        for whole in batches:
            for b in W.slices(whole, "text", SLICE):
                b, runs = _lang_runs(b, ["lang", "gid"])
                found, row = terms(b.column("text"))
                coded = found.dictionary_encode()
                code, gids = coded.indices.to_numpy(), b.column("gid").to_numpy()
                for lang, lo, hi in runs:
                    if lang not in hashes.langs:
                        continue
                    a, z = np.searchsorted(row, [lo, hi])
                    where, distinct = pd.factorize(code[a:z])
                    slot = hashes.slots(lang, coded.dictionary.take(pa.array(distinct)))[where]
                    first, width = hashes.langs[lang][0], hashes.width[lang]
                    cuts = [lo, *(np.flatnonzero(np.diff(gids[lo:hi])) + lo + 1), hi]
                    for c, d in zip(cuts, cuts[1:]):
                        x, y = np.searchsorted(row[a:z], [c, d])
                        mine = slot[x:y]
                        mine = mine[mine >= 0] - first
                        key = (lang, int(gids[c]))
                        if not len(mine):
                            continue
                        if key not in held:
                            if held and used + 8 * width > dense_bytes:
                                yield rows(held, hashes)
                                held, used = {}, 0
                            held[key] = np.zeros(width, np.int64)
                            used += 8 * width
                        np.add.at(held[key], mine, 1)
        if held:
            yield rows(held, hashes)

    sent = small_batches(docs.select("lang", "gid", "text")).mapInArrow(run, schema)
    return sent.select("gid", "sid", F.inline(F.arrays_zip("slot", "count")))


def group_ids(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` with a 64-bit number of its (lang, source), and the table (gid, lang, source) of all groups."""
    for seed in range(8):
        numbered = docs.withColumn("gid", F.xxhash64(F.lit(seed), "lang", "source"))
        groups = materialize(numbered.select("gid", "lang", "source").distinct())
        n = groups.agg(F.count("*").alias("n"), F.countDistinct("gid").alias("d")).first()
        if n.n == n.d:
            return numbered, groups
    raise RuntimeError("no seed gives every group a number of its own")


def _share(count: str, n: str, v: str) -> Column:
    return F.expr(f"1 + (cast({count} + 2 as decimal(20,0)) * 1000000000) div ({n} + 2 * {v})")


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(1e9 (count + 2) / total), exact for totals below 9e15: three digits at a time."""
    out, rest = np.divmod(count + 2, total)
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + step
    return out + 1


def _pair_sums(t: pa.Table) -> pa.Table:
    """Sums of one shard over the pairs of two blocks of groups."""
    gid, slot, count = (t[c].to_numpy() for c in ("gid", "slot", "count"))
    head = slot < 0  # one row for each group, with what is the same for all its terms
    order = np.argsort(gid[head])
    groups = gid[head][order]
    n, v, block = (t[c].to_numpy()[head][order] for c in ("n", "v", "block"))
    width, ba, bb = int(t["width"][0].as_py()), t["ba"][0].as_py(), t["bb"][0].as_py()
    total = np.maximum(n + 2 * v, 1)
    p = np.repeat(shares(np.zeros(len(groups), np.int64), total)[:, None], width, axis=1)
    at = np.searchsorted(groups, gid[~head])
    p[at, slot[~head]] = shares(count[~head], total[at])
    a, b, value = [], [], []
    for i in np.flatnonzero(block == ba):
        other = np.flatnonzero(block == bb)
        other = other[other > i] if ba == bb else other
        for some in np.array_split(other, max(1, len(other) * width >> 20)):
            d = p[some] - p[i]
            f = (d * d // (p[some] + p[i])).sum(1)
            a.append(np.full(len(some), groups[i]))
            b.append(groups[some])
            value.append(f)
    a, b, value = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, value))
    return pa.table({"a": a.astype(np.int64), "b": b.astype(np.int64), "value": value.astype(np.int64)})


def _pairs(counts: DataFrame, groups: DataFrame, shards: DataFrame, block: int) -> DataFrame:
    """(gid, other, value) of all ordered pairs of groups of one language."""
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    blocks = -(-most // block)
    g = groups.select("gid", "lang", "n", "v", F.pmod("gid", F.lit(blocks)).cast("int").alias("block"))
    cells = F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda j: F.struct(
        F.least(F.col("block"), j).alias("ba"), F.greatest(F.col("block"), j).alias("bb"))))
    heads = g.join(shards.select("lang", "sid", F.col("n").alias("width")), "lang", "left")
    heads = heads.select("lang", F.coalesce("sid", F.lit(-1)).alias("sid"), "gid", "n", "v", "block", F.coalesce("width", F.lit(0)).alias("width"),
                         F.lit(-1).alias("slot"), F.lit(0).cast("long").alias("count"))
    entries = counts.join(broadcast_checked(g.select("gid", "lang", "block"), MAX_BROADCAST_ROWS), "gid")
    entries = entries.select("lang", "sid", "gid", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("v"), "block",
                             F.lit(0).alias("width"), "slot", "count")
    rows = heads.unionByName(entries).select("*", cells.alias("_c")).select("*", "_c.ba", "_c.bb").drop("_c")

    def run(t: pa.Table) -> pa.Table:
        return _pair_sums(t.sort_by([("width", "descending"), ("slot", "ascending")]).combine_chunks())

    sums = small_batches(rows).groupBy("lang", "sid", "ba", "bb").applyInArrow(run, "a long, b long, value long")
    sums = sums.groupBy("a", "b").agg(F.sum("value").alias("value"))
    return sums.select(F.explode(F.array(F.struct(F.col("a").alias("gid"), F.col("b").alias("other")), F.struct(F.col("b").alias("gid"), F.col("a").alias("other")))).alias("_p"),
                       "value").select("_p.*", "value")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, keys: int = KEYS, wave_bytes: int = WAVE_BYTES,
          dense_bytes: int = DENSE_BYTES, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): all pairs of sources of a language, and the ``top`` terms that a group
    has more often than its language."""
    spark = docs.sparkSession
    src, groups = group_ids(docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]))
    kept = materialize(document_counts(src).where(F.col("docs") >= min_docs).select("lang", "term"))
    shards = perfect_hashes(kept, keys, wave_bytes)
    waves = shards.agg(F.max("wave")).first()[0]
    parts = []
    for wave in range(0 if waves is None else waves + 1):
        rows = shards.where(F.col("wave") == wave).drop("terms").orderBy("sid").collect()  # WAVE_BYTES and a shard at most
        parts.append(_recount(src, PerfectHashes(rows), dense_bytes))
    sent = spark.createDataFrame([], "gid long, sid int, slot int, count long")
    for p in parts:
        sent = sent.union(p)
    counts = materialize(sent.groupBy("gid", "sid", "slot").agg(F.sum("count").alias("count")))

    names = shards.select("sid", "lang", F.posexplode("terms").alias("slot", "term"))
    known = names.join(counts.groupBy("sid", "slot").agg(F.sum("count").alias("all")), ["sid", "slot"])
    langs = shards.groupBy("lang").agg(F.sum("n").cast("long").alias("v"))
    whole = counts.join(broadcast_checked(shards.select("sid", "lang"), MAX_BROADCAST_ROWS), "sid").groupBy("lang").agg(F.sum("count").alias("n_all"))
    groups = groups.join(counts.groupBy("gid").agg(F.sum("count").alias("n")), "gid", "left").join(langs, "lang", "left").join(whole, "lang", "left")
    groups = materialize(groups.select("gid", "lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "v", "n_all")]))
    facts = broadcast_checked(groups, MAX_BROADCAST_ROWS)

    by_term = counts.join(known.select("sid", "slot", "term", "all"), ["sid", "slot"]).join(facts, "gid")
    by_term = by_term.select("lang", "source", "gid", "term", _share("count", "n", "v").alias("p"), _share("`all`", "n_all", "v").alias("q")).where("p > q")
    by_term = by_term.select("lang", "source", "gid", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    by_term = top_k(by_term, ["gid"], [F.col("value").desc(), F.col("item")], top, "item")
    by_term = by_term.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))

    other = broadcast_checked(groups.select(F.col("gid").alias("other"), F.col("source").alias("item")), MAX_BROADCAST_ROWS)
    w = Window.partitionBy("gid").orderBy(F.col("value").desc(), "item")
    by_pair = _pairs(counts, groups, shards, block).join(facts.select("gid", "lang", "source"), "gid").join(other, "other")
    by_pair = by_pair.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(w).alias("rank"))
    return by_pair.unionByName(by_term)


_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
found AS (
  SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
                                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
kept AS (SELECT lang, term FROM found GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
cnt AS (SELECT lang, source, term, count(*) AS c FROM found JOIN kept USING (lang, term) GROUP BY lang, source, term),
grp AS (SELECT lang, source, coalesce(max(v), 0) AS v, coalesce(max(n), 0) AS n
        FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN size USING (lang)
        LEFT JOIN (SELECT lang, source, sum(c) AS n FROM cnt GROUP BY lang, source) USING (lang, source) GROUP BY lang, source),
p AS (
  SELECT lang, source, term, coalesce(c, 0) AS c, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c, 0) + 2) // (n + 2 * v) AS p
  FROM grp JOIN kept USING (lang) LEFT JOIN cnt USING (lang, source, term)),
q AS (
  SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (c + 2) // (n + 2 * v) AS q
  FROM (SELECT lang, term, sum(c) AS c FROM cnt GROUP BY lang, term) JOIN (SELECT lang, sum(c) AS n FROM cnt GROUP BY lang) USING (lang) JOIN size USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
scored AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM scored)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10"""


@query("op12_perfect_recount", _SQL)
def op12_perfect_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all (lang, source) groups of ``documents``."""
    return audit(load(spark, sf_dir, "documents"))
