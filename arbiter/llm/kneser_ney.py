"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash arrays in the
shared folder, memory-mapped by the workers that score.

Tokens of a text are its words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased) and one end; the first token's
context is a start symbol that is no token itself.  With c the bigram counts, ``N1+`` numbers of distinct
neighbours and D1, D2, D3+ the discounts of Chen and Goodman for each order,

    p(w|v) = (c(vw) - D(c(vw))) / c(v.) + g(v) p(w),   g(v) = (D1 n1(v) + D2 n2(v) + D3 n3+(v)) / c(v.)
    p(w)   = (N1+(.w) - D(N1+(.w))) / N1+(..) + g / (V + 1),

where one of the V + 1 uniform shares is for unknown words.  Unknown contexts back off to p(w).

Three passes over the texts, none of which gathers anything in one place:

1. words -> ``uni-*``: per flush of a task, distinct word hashes and counts go to the shard of their top
   bits; a shard sorts, sums and writes its arrays.  A word's id is its place in the global hash order.
2. bigrams -> ``bi-*``: id pairs, pre-summed per flush, go to the shard of their context; contexts that hold
   more than a quarter of a shard's mean tokens are dealt by the whole pair, so that no context can fill a
   shard.  Shards write sorted keys and counts and hand context and continuation sums on to the shard of
   the word, which writes them densely by id (``ctx-*``).
3. scoring: every worker maps the arrays and looks up a slice's distinct words and pairs in sorted order.

The number of shards follows the number of input partitions, so the memory of a task doesn't grow with
the input.  The model grows with the corpus (about 9 bytes a distinct bigram).

Nulls and odd input: a null text is empty (its only token is the end); documents with a null id are
treated as fold 0, so held out; repeated rows count as often as they occur; without training rows the model
is uniform over V + 1 = 1 symbols.  At most 2^32 - 2 distinct words are representable; more raise an error.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbiter.llm import words as W
from arbiter.llm.registry import query
from arbiter.llm.shared import ArrayStore, from_planes, pack_sorted, planes, sum_by_key, unpack_sorted
from arbiter.llm.tables import by_slices, fold, load, shard_bits, small_batches
from arbiter.session import scratch_path

END = np.uint64(0x656E64206F662074)  # hash value that stands for the end token
FLUSH = 4_000_000
BLOB = "shard int, kind int, keys binary, more binary"


@dataclass
class Model:
    """Where the arrays are, and the few numbers that every worker needs."""

    uri: str
    bits: int
    sizes: list[int] = field(default_factory=list)
    tokens: int = 0
    distinct_bigrams: int = 0
    discounts: tuple = (0.0, 0.0, 0.0)
    cont_discounts: tuple = (0.0, 0.0, 0.0)
    cont_backoff: float = 1.0

    @property
    def vocabulary(self) -> int:
        return int(sum(self.sizes))

    @property
    def bases(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)

    @property
    def hot(self) -> float:
        return self.tokens / 4 / (1 << self.bits)


def shard_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def token_hashes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows (words, then an end, per row) and the offsets of the rows."""
    w = W.split(col)
    n = len(w.counts)
    out = np.full(len(w.starts) + n, END, np.uint64)
    out[np.arange(len(w.starts)) + w.row] = W.hashes(w, lower=True)
    return out, w.first + np.arange(n + 1)


def _blobs(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
    """One row a shard: keys of count 1, then the others with their counts."""
    order = np.argsort(shard, kind="stable")
    keys, counts, shard = keys[order], counts[order], shard[order]
    at = np.flatnonzero(np.diff(shard, prepend=-1))
    ids, kinds, ks, ms = [], [], [], []
    for a, b in zip(at, np.append(at[1:], len(shard))):
        one = counts[a:b] == 1
        for kind, pick in ((0, one), (1, ~one)):
            k = keys[a:b][pick]
            if len(k):
                ids.append(int(shard[a]))
                kinds.append(kind)
                ks.append(pack_sorted(k))
                ms.append(planes(counts[a:b][pick].astype(np.uint32)) if kind else b"")
    return pa.record_batch([pa.array(ids, pa.int32()), pa.array(kinds, pa.int32()), pa.array(ks, pa.binary()), pa.array(ms, pa.binary())],
                           names=["shard", "kind", "keys", "more"])


def _merge(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [], []
    for kind, k, m in zip(t["kind"].to_pylist(), t["keys"].to_pylist(), t["more"].to_pylist()):
        if kind <= 1:
            keys.append(unpack_sorted(k))
            counts.append(from_planes(m, np.uint32).astype(np.int64) if kind else np.ones(len(keys[-1]), np.int64))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return sum_by_key(np.concatenate(keys), np.concatenate(counts))


def _gathered(df: DataFrame, keys_of) -> DataFrame:
    """Count keys of the slices, summed within a task as far as ``FLUSH`` keys, as blobs by shard."""
    def run(batches):
        held, n = [], 0
        for b in batches:
            for s in W.slices(b, "text"):
                k, shard_fn = keys_of(s.column(s.schema.get_field_index("text")))
                held.append(k)
                n += len(k)
                if n >= FLUSH:
                    k, c = np.unique(np.concatenate(held), return_counts=True)
                    yield _blobs(k, c, shard_fn(k))
                    held, n = [], 0
        if n:
            k, c = np.unique(np.concatenate(held), return_counts=True)
            yield _blobs(k, c, shard_fn(k))
    return small_batches(df).select("text").mapInArrow(run, BLOB)


def find(model: Model, q: np.ndarray) -> np.ndarray:
    """Ids of sorted distinct word hashes, -1 for unknown words."""
    store, out = ArrayStore(model.uri), np.full(len(q), -1, np.int64)
    bases, shard = model.bases, shard_of(q, model.bits)
    at = np.flatnonzero(np.diff(shard, prepend=-1)) if len(q) else np.zeros(0, np.int64)
    for a, b in zip(at, np.append(at[1:], len(q))):
        s = int(shard[a])
        if model.sizes[s]:
            keys = store.load(f"uni-{s}")
            i = np.searchsorted(keys, q[a:b])
            ok = keys[np.minimum(i, len(keys) - 1)] == q[a:b]
            out[a:b][ok] = bases[s] + i[ok]
    return out


def by_id(model: Model, name: str, ids: np.ndarray) -> np.ndarray:
    """Values of a dense per-word array at sorted ids."""
    store, bases = ArrayStore(model.uri), model.bases
    bases[-1] += 1  # the start symbol's id is V, in the last shard
    out = np.zeros(len(ids), np.int64)
    cut = np.searchsorted(ids, bases)
    for s in range(len(bases) - 1):
        a, b = cut[s], cut[s + 1]
        if b > a:
            out[a:b] = store.load(f"{name}-{s}")[ids[a:b] - bases[s]]
    return out


def route(model: Model, keys: np.ndarray) -> np.ndarray:
    """Shards of sorted bigram keys: by context, or by the whole pair for frequent contexts."""
    ctx = (keys >> np.uint64(32)).astype(np.int64)
    u, back = np.unique(ctx, return_inverse=True)
    known = u < model.vocabulary
    count = np.full(len(u), model.tokens, np.int64)  # the start symbol counts as frequent
    count[known] = by_id(model, "cnt", u[known])
    hot = (count > model.hot)[back]
    return shard_of(W.mix(np.where(hot, keys, ctx.astype(np.uint64) * W._STEP) + W._C2), model.bits)


def pair_keys(model: Model, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context << 32 | word) of every token, and whether both are known."""
    prev = np.empty_like(ids)
    prev[1:] = ids[:-1]
    prev[offsets[:-1][offsets[:-1] < len(ids)]] = model.vocabulary
    return (prev.astype(np.uint64) << np.uint64(32)) | (ids.astype(np.uint64) & np.uint64(0xFFFFFFFF)), (prev >= 0) & (ids >= 0)


def ids_of(model: Model, h: np.ndarray) -> np.ndarray:
    u, back = np.unique(h, return_inverse=True)
    return find(model, u)[back]


def _discounts(n: list[float]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of items seen once to four times; in [0, count]."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(float(min(max(d, 0.05), k - 0.05)) for d, k in zip(raw, (1, 2, 3)))


def train(docs: DataFrame) -> Model:
    """Count the texts of ``docs`` (column ``text``) and write the model's arrays."""
    spark = docs.sparkSession
    docs = docs.select("text")
    bits = shard_bits(docs)
    model = Model(scratch_path(spark, "kneser-ney"), bits)
    uri = model.uri

    def unigram(t: pa.Table) -> pa.Table:
        s = t["shard"][0].as_py()
        keys, counts = _merge(t)
        store = ArrayStore(uri)
        store.save(f"uni-{s}", keys)
        store.save(f"cnt-{s}", counts.astype(np.uint32 if counts.max() < 2**32 else np.int64))
        return pa.table({"shard": pa.array([s], pa.int32()), "n": [len(keys)], "tokens": [int(counts.sum())]})

    uni = _gathered(docs, lambda col: (token_hashes(col)[0], lambda k: shard_of(k, bits)))
    done = {r.shard: r for r in uni.groupBy("shard").applyInArrow(unigram, "shard int, n long, tokens long").collect()}
    model.sizes = [done[s].n if s in done else 0 for s in range(1 << bits)]
    model.tokens = sum(r.tokens for r in done.values())
    if model.vocabulary >= 2**32 - 1:
        raise ValueError("more than 2^32 - 2 distinct words")
    if not model.tokens:
        return model
    counted = model

    def pairs(col):
        h, off = token_hashes(col)
        keys, _ = pair_keys(counted, ids_of(counted, h), off)
        return keys, lambda k: route(counted, k)

    def bigram(t: pa.Table) -> pa.Table:
        s = t["shard"][0].as_py()
        keys, counts = _merge(t)
        store = ArrayStore(uri)
        store.save(f"bi-{s}", keys)
        store.save(f"bc-{s}", np.minimum(counts, 255).astype(np.uint8))
        big = np.flatnonzero(counts >= 255)
        store.save(f"bx-{s}", np.stack([big, counts[big]]).astype(np.int64))
        ctx, word = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at = np.flatnonzero(np.diff(ctx, prepend=-1))
        sums = [np.add.reduceat(x, at) for x in (counts, counts == 1, counts == 2, counts >= 3)]
        out = [(*r, 2) for r in _dense_parts(counted, ctx[at], sums)]
        w, n = np.unique(word, return_counts=True)
        out += [(*r, 3) for r in _dense_parts(counted, w, [n])]
        coc = np.array([int((counts == k).sum()) for k in (1, 2, 3, 4)] + [len(keys)], np.int64)
        out.append((s, b"", coc.tobytes(), 4))
        return pa.table({"shard": pa.array([r[0] for r in out], pa.int32()), "kind": pa.array([r[3] for r in out], pa.int32()),
                         "keys": pa.array([r[1] for r in out], pa.binary()), "more": pa.array([r[2] for r in out], pa.binary())})

    def dense(t: pa.Table) -> pa.Table:
        s = t["shard"][0].as_py()
        last = s == len(counted.sizes) - 1
        size = counted.sizes[s] + last
        sums = np.zeros((5, size), np.int64)  # c(v.), n1(v), n2(v), n3+(v), N1+(.w)
        coc = np.zeros(5, np.int64)
        for kind, k, m in zip(t["kind"].to_pylist(), t["keys"].to_pylist(), t["more"].to_pylist()):
            if kind == 4:
                coc += np.frombuffer(m, np.int64)
                continue
            at = np.cumsum(from_planes(k, np.uint32), dtype=np.int64)
            vals = from_planes(m, np.uint32).reshape(-1, len(at))
            for row, v in zip((0, 1, 2, 3) if kind == 2 else (4,), vals):
                sums[row, at] += v
        store = ArrayStore(uri)
        for name, row in zip(("tot", "n1", "n2", "n3", "con"), sums):
            store.save(f"{name}-{s}", row.astype(np.uint32 if row.size == 0 or row.max() < 2**32 else np.int64))
        con = sums[4]
        cont = [int((con == k).sum()) for k in (1, 2, 3, 4)] + [int((con >= 3).sum())]
        return pa.table({"coc": pa.array([coc.tolist()], pa.list_(pa.int64())), "cont": pa.array([cont], pa.list_(pa.int64()))})

    # every word shard gets a row, so that each writes its arrays
    parts = _gathered(docs, pairs).groupBy("shard").applyInArrow(bigram, BLOB)
    every = spark.range(1 << bits).select(F.col("id").cast("int").alias("shard"), F.lit(4).alias("kind"), F.lit(b"").alias("keys"),
                                          F.lit(np.zeros(5, np.int64).tobytes()).alias("more"))
    got = parts.unionByName(every).groupBy("shard").applyInArrow(dense, "coc array<long>, cont array<long>")
    total = got.select(*[F.sum(F.col("coc")[i]).alias(f"a{i}") for i in range(5)],
                       *[F.sum(F.col("cont")[i]).alias(f"b{i}") for i in range(5)]).first()
    coc, cont = list(total[:5]), list(total[5:])
    model.distinct_bigrams = coc[4]
    model.discounts, model.cont_discounts = _discounts(coc[:4]), _discounts(cont[:4])
    d = model.cont_discounts
    model.cont_backoff = (d[0] * cont[0] + d[1] * cont[1] + d[2] * cont[4]) / coc[4]
    return model


def _dense_parts(model: Model, ids: np.ndarray, sums: list[np.ndarray]) -> list[tuple]:
    """Sums at sorted ids as (word shard, differences of the places, values)."""
    bases = model.bases
    bases[-1] += 1
    cut = np.searchsorted(ids, bases)
    out = []
    for s in range(len(bases) - 1):
        a, b = cut[s], cut[s + 1]
        if b > a:
            at = (ids[a:b] - bases[s]).astype(np.uint32)
            out.append((s, planes(np.diff(at, prepend=np.uint32(0)).astype(np.uint32)),
                        planes(np.concatenate([x[a:b] for x in sums]).astype(np.uint32))))
    return out


def bigram_counts(model: Model, keys: np.ndarray) -> np.ndarray:
    """Counts of sorted distinct bigram keys, 0 if not seen."""
    store, out = ArrayStore(model.uri), np.zeros(len(keys), np.int64)
    if not len(keys):
        return out
    shard = route(model, keys)
    order = np.argsort(shard, kind="stable")
    ordered = shard[order]
    at = np.flatnonzero(np.diff(ordered, prepend=-1))
    for a, b in zip(at, np.append(at[1:], len(keys))):
        pick, s = order[a:b], int(ordered[a])
        try:
            stored = store.load(f"bi-{s}")
        except FileNotFoundError:
            continue  # a shard without pairs
        i = np.searchsorted(stored, keys[pick])
        ok = (i < len(stored)) & (stored[np.minimum(i, len(stored) - 1)] == keys[pick])
        c = np.where(ok, store.load(f"bc-{s}")[np.minimum(i, len(stored) - 1)], 0).astype(np.int64)
        if (c == 255).any():
            where, big = store.load(f"bx-{s}")
            full = c == 255
            c[full] = big[np.searchsorted(where, i[full])]
        out[pick] = c
    return out


def _less(c: np.ndarray, d: tuple) -> np.ndarray:
    """Counts after their discounts."""
    return np.maximum(c - np.select([c == 1, c == 2, c >= 3], d, 0.0), 0.0)


def log10_probabilities(model: Model, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """log10 p of every token."""
    v1 = model.vocabulary + 1
    if not model.tokens:
        return np.full(len(ids), -np.log10(v1))
    u, back = np.unique(ids, return_inverse=True)
    con = np.zeros(len(u), np.int64)
    known = u >= 0
    con[known] = by_id(model, "con", u[known])
    lower = (_less(con, model.cont_discounts) / model.distinct_bigrams + model.cont_backoff / v1)[back]
    keys, both = pair_keys(model, ids, offsets)
    uk, kback = np.unique(keys[both], return_inverse=True)
    c = np.zeros(len(ids), np.int64)
    c[both] = bigram_counts(model, uk)[kback]
    prev = (keys >> np.uint64(32)).astype(np.int64)
    start = np.zeros(len(ids), bool)
    start[offsets[:-1]] = True
    prev_known = start | np.concatenate([[False], ids[:-1] >= 0])
    pu, pback = np.unique(prev[prev_known], return_inverse=True)
    tot, n1, n2, n3 = (by_id(model, x, pu)[pback].astype(float) for x in ("tot", "n1", "n2", "n3"))
    d = model.discounts
    p = lower.copy()
    seen = tot > 0
    t = np.where(seen, tot, 1.0)
    high = _less(c[prev_known], d) / t + (d[0] * n1 + d[1] * n2 + d[2] * n3) / t * lower[prev_known]
    p[prev_known] = np.where(seen, high, lower[prev_known])
    return np.log10(p)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row."""
    schema = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
              "score double, perplexity double")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        h, off = token_hashes(b.column(2))
        u, back = np.unique(h, return_inverse=True)
        uid = find(model, u)
        count = np.zeros(len(u), np.int64)
        count[uid >= 0] = by_id(model, "cnt", uid[uid >= 0])
        ids = uid[back]
        base = np.log10((count + 0.1) / (model.tokens + 0.1 * (model.vocabulary + 1)))[back]
        lp = log10_probabilities(model, ids, off)
        at = off[:-1]
        n = np.diff(off)
        total = np.add.reduceat(lp, at)
        return pa.record_batch([
            b.column(0), b.column(1), pa.array(n), pa.array(np.add.reduceat((count > 0)[back].astype(np.int64), at)),
            pa.array(np.full(len(at), model.tokens, np.int64)), pa.array(np.add.reduceat(base, at)), pa.array(total),
            pa.array(10.0 ** np.minimum(-total / n, 300.0))], names=[x.split()[0] for x in schema.split(", ")])

    return by_slices(docs.select("doc_id", "held_out", "text"), "text", run, schema)


@query("op2_kneser_ney")
def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from nine tenths of ``documents`` (by id), score all of them."""
    docs = load(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", 10) == 0).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return score(docs, train(docs.where("not held_out")))
