"""Vector code compression: product codes whose entries are found on a trie of the distinct parts.

Components become integers, floor(256 x); a vector is cut into ``PARTS`` equal parts, each of which is replaced by
the number of the nearest entry of its position's codebook.  The parts of a chunk of vectors are made distinct per
position and sorted: their order is the depth-first order of the trie whose edges are the components.  A node's
vector of squared distances to all entries is its parent's plus one component's, so it is computed once, however
many parts share the prefix; leaves take the smallest (ties: the lowest entry) and add their components, weighted
by their number of copies, to that entry's sum.

One round of training is one pass over the vectors without a shuffle: a task passes on at most parts x entries
sums, which Spark adds up, and the driver gets parts x entries rows.  Encoding is one more pass.

Nulls and odd input: vectors that are null or hold null, NaN or infinite components are dropped.  Vectors shorter
than the longest one, rounded up to a multiple of ``PARTS``, count as followed by zeros.  Rows without vec_id stay and come
after all others when the first entries are chosen; rows with equal vec_id are taken in the order of their
components.  Fewer kept vectors than entries: as many entries; none: no rows.  Repeated rows weigh as often as they
occur.  Labels that are null are one label.  Other columns are ignored.  Components of a magnitude over 2^27 after
scaling raise an error, as their squared distances would not fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbiter.llm.registry import query
from arbiter.llm.tables import broadcast_checked, materialize, small_batches

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LEAVES = 4096               # leaves whose distance vectors are held at a time
CHUNK_BYTES = 32 << 20      # integers of the vectors among which parts are made distinct
LARGEST = 1 << 27
MAX_LABELS, SALTS = 100_000, 32


@dataclass
class Codebooks:
    """``entries[part, entry, component]``, and how vectors become integers."""

    entries: np.ndarray
    scale: int = SCALE

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        """Digest of all components in decimal, by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Approximate vectors of codes (rows x parts): the middles of the integers' intervals."""
        return (np.concatenate([e[codes[:, k]] for k, e in enumerate(self.entries)], 1) + 0.5) / self.scale


def usable(vector: Column) -> Column:
    """True for a vector without null, NaN or infinite components."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, lambda x: finite(x.cast("double")))


def integers(col: pa.Array, width: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of the vectors, one a row, padded with zeros."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = np.diff(col.offsets.to_numpy())
    flat = np.floor(col.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(flat) and np.abs(flat).max() > LARGEST:
        raise ValueError(f"a vector has a component beyond {LARGEST / scale:g}: distances would not fit 64 bits")
    out = np.zeros((len(col), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat.astype(np.int64)
    return out


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of lexicographically sorted distinct parts (rows x components).

    Leaves are visited in depth-first order, ``LEAVES`` at a time, level by level; the path of the last leaf is
    carried over, so a prefix that reaches into the next leaves is not computed again.
    """
    n, depth = parts.shape
    if not depth or not n:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    fresh = np.ones((n, depth), bool)  # fresh[i, j]: leaf i is the first below its node of level j
    fresh[1:] = np.logical_or.accumulate(parts[1:] != parts[:-1], axis=1)
    code, distance = np.empty(n, np.int64), np.empty(n, np.int64)
    path: list[np.ndarray] = [np.zeros(0, np.int64)] * depth
    for a in range(0, n, LEAVES):
        b = min(a + LEAVES, n)
        above, parent = np.zeros((1, len(entries)), np.int64), np.zeros(b - a, np.int64)
        for j in range(depth):
            new = fresh[a:b, j]
            first = np.flatnonzero(new)
            step = parts[a + first, j][:, None] - entries[:, j]
            step *= step
            step += above[parent[first]]
            node = np.cumsum(new)
            if new[0]:
                node -= 1
            else:  # the first leaves hang on the last node of the leaves before
                step = np.concatenate([path[j][None, :], step])
            path[j] = step[-1].copy()
            above, parent = step, node
        best = above.argmin(1)
        code[a:b] = best[parent]
        distance[a:b] = above[np.arange(len(best)), best][parent]
    return code, distance


def distinct_parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct rows, the row of each input row among them, and their numbers of copies."""
    order = np.lexsort(x.T[::-1]) if x.shape[1] else np.arange(len(x))
    s = x[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]).any(1)
    number = np.cumsum(new) - 1
    where = np.empty(len(x), np.int64)
    where[order] = number
    return s[new], where, np.bincount(number, minlength=int(new.sum()))


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.Table]:
    """Batches joined until their integers take ``CHUNK_BYTES``; a longer batch is cut."""
    rows = max(1, CHUNK_BYTES // (8 * max(width, 1)))
    held, n = [], 0
    for b in batches:
        for at in range(0, b.num_rows, rows):
            s = b.slice(at, rows)
            if held and n + s.num_rows > rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
            held.append(s)
            n += s.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _kept(vectors: DataFrame, *more: Column) -> DataFrame:
    return vectors.where(usable(F.col("embedding"))).select(*more, F.col("embedding").cast("array<double>").alias("embedding"))


def _round(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """Entries moved to the floors of the means of their parts."""
    n_parts, n_entries, size = books.entries.shape
    width, scale = books.width, books.scale
    shipped = vectors.sparkSession.sparkContext.broadcast(books.entries)

    def run(batches):
        total, count = np.zeros((n_parts, n_entries, size), object), np.zeros((n_parts, n_entries), np.int64)
        for t in _chunks(batches, width):
            x = integers(t["embedding"], width, scale)
            for k, entries in enumerate(shipped.value):
                leaf, _, copies = distinct_parts(x[:, k * size:(k + 1) * size])
                code, _ = nearest(leaf, entries)
                add = np.zeros((n_entries, size), np.int64)  # a chunk's sums fit: at most 4 million times 2^27
                np.add.at(add, code, leaf * copies[:, None])
                total[k] += add
                count[k] += np.bincount(code, copies, n_entries).astype(np.int64)
        part, entry = np.nonzero(count)
        yield pa.record_batch([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry], pa.int64()),
                               pa.array(total[part, entry].tolist(), pa.list_(pa.decimal128(38, 0)))],
                              names=["part", "entry", "copies", "total"])

    sums = small_batches(_kept(vectors)).mapInArrow(run, "part int, entry int, copies long, total array<decimal(38,0)>")
    rows = sums.groupBy("part", "entry").agg(F.sum("copies").alias("copies"), *[F.sum(F.get("total", F.lit(j))).alias(f"s{j}") for j in range(size)])
    entries = books.entries.copy()
    for r in rows.collect():  # parts x entries rows at most
        entries[r.part, r.entry] = [int(r[f"s{j}"]) // int(r.copies) for j in range(size)]
    return Codebooks(entries, scale)


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks of (vec_id, embedding); they start as the parts of the ``entries`` smallest vec_ids."""
    kept = vectors.where(usable(F.col("embedding")))
    longest = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = -(-longest // parts) * parts
    order = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    first = _kept(kept, order.alias("_order"), "vec_id").orderBy(F.col("vec_id").asc_nulls_last(), "_order").limit(entries)
    seeds = integers(pa.array([r.embedding for r in first.collect()], pa.list_(pa.float64())), width, scale)  # 64 rows
    books = Codebooks(seeds.reshape(len(seeds), parts, width // parts).transpose(1, 0, 2).copy(), scale)
    for _ in range(rounds if len(seeds) else 0):
        books = _round(vectors, books)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) of every kept vector; error is the squared distance to the decoded integers."""
    n_parts, n_entries, size = books.entries.shape
    width, scale, digits = books.width, books.scale, max(2, len(f"{max(n_entries - 1, 0):x}"))
    shipped = vectors.sparkSession.sparkContext.broadcast(books.entries)
    names = np.array([f"{k:0{digits}x}" for k in range(max(n_entries, 1))], object)

    def run(batches):
        for t in _chunks(batches, width):
            x = integers(t["embedding"], width, scale)
            error, code = np.zeros(len(x), np.int64), np.full(len(x), "", object)
            for k, entries in enumerate(shipped.value):
                leaf, where, _ = distinct_parts(x[:, k * size:(k + 1) * size])
                best, distance = nearest(leaf, entries)
                error += distance[where]
                code += names[best][where]
            yield from pa.table([t["vec_id"], t["label"], pa.array(code, pa.string()), pa.array(error, pa.int64())],
                                names=["vec_id", "label", "code", "error"]).combine_chunks().to_batches()

    src = _kept(vectors, F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"))
    if not n_entries:
        return src.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0)
    return small_batches(src).mapInArrow(run, "vec_id long, label string, code string, error long")


def with_label_error(coded: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """``coded`` with the errors' sum over rows of equal label.

    Sums are pre-aggregated; up to ``max_labels`` of them are broadcast, more meet their rows in a join salted
    over ``SALTS`` cells, so that a label of a third of all rows is no single task.
    """
    total = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    small = broadcast_checked(total, max_labels)
    if small is not total:
        return coded.join(small, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    salted = total.withColumn("_cell", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_cell"))).drop("_label", "_cell", "_salt")


_FIT_SQL = """
WITH raw AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, len(embedding) // 16 AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
  SELECT vec_id, label, p.p AS part, list_slice(v, p.p * w + 1, p.p * w + w) AS x FROM raw, range(0, 16) p(p)),
uniq AS (SELECT part, x, count(*) AS n FROM parts GROUP BY part, x),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM raw ORDER BY vec_id LIMIT 64),
c0 AS (SELECT part, entry, x AS e FROM parts JOIN seeds USING (vec_id)),"""


def _assign_sql(k: int) -> str:
    return f"""
a{k} AS (
  SELECT part, x, n, min(d) AS d, min(entry) AS entry FROM (
    SELECT *, min(d) OVER (PARTITION BY part, x) AS least FROM (
      SELECT u.part, u.x, u.n, c.entry,
             list_sum(list_transform(list_zip(u.x, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
      FROM uniq u JOIN c{k} c USING (part)))
  WHERE d = least GROUP BY part, x, n)"""


def _move_sql(k: int) -> str:
    return f"""
m{k} AS (
  SELECT part, entry, i, sum(v * n) AS s, sum(n) AS n
  FROM (SELECT part, entry, n, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS i FROM a{k}) GROUP BY part, entry, i),
f{k} AS (
  SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS e FROM m{k} GROUP BY part, entry),
c{k + 1} AS (SELECT c.part, c.entry, coalesce(f.e, c.e) AS e FROM c{k} c LEFT JOIN f{k} f USING (part, entry))"""


_SQL = _FIT_SQL + ",".join([_assign_sql(0), _move_sql(0), _assign_sql(1), _move_sql(1), _assign_sql(2)]) + """,
books AS (
  SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(e) AS v, unnest(range(1, len(e) + 1)) AS i FROM c2)),
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM parts JOIN a2 USING (part, x) GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded, books"""


@query("op13_trie_codes", _SQL)
def op13_trie_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all kept rows of ``embeddings`` after two rounds of training on all of them."""
    vectors = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet").select("vec_id", "embedding", "label")
    books = train(vectors)
    coded = with_label_error(materialize(encode(vectors, books)))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
