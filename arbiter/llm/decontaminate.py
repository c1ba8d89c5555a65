"""Benchmark decontamination in DataFrame operations only (no Python on executors).

A-Z are lower-cased; words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  A benchmark item's windows are its runs
of ``n`` consecutive words; an item of fewer words, but not none, is one window.  Document words inside
any occurrence of a window are hit.

Main path, while the benchmark has at most ``max_set`` distinct windows (counted first): the windows'
hashes are a literal hash set that travels with the task binary, a broadcast of proven size.  Each
document's token windows are scanned inside its own row, first by the hash of their leading words, then by
the hash of the whole window, and candidate positions are verified by their text against the literal set
of windows.  No shuffle carries texts or token windows.  The scan uses upper case of all letters, which
can be computed fast and which equal windows share; the verification uses the exact rule.

Beyond ``max_set`` windows: token windows are exploded to (row key, position, hash) and equi-joined to the
windows' hashes by a shuffle (AQE splits hot windows), candidate positions are grouped by row and
joined back, and the same verification follows.

Nulls and odd input: a null text has no words; a null or empty item has no windows; an item
without an id still hits, but is not listed; repeated rows and ids
are each reported; null doc_ids stay null; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbiter.llm.registry import query
from arbiter.llm.tables import broadcast_checked, load, once

WINDOW = 10
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HITS = "array<struct<pos:int,len:int,win:string>>"


def exact_words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, ABC, ABC.lower()), SEPARATOR), "")


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """(win, len, items): distinct windows with the sorted ids (as strings) of the items that hold them."""
    words = benchmark.select(F.col(item).cast("string").alias("item"), exact_words(F.col(text)).alias("w")).where("size(w) > 0")
    wins = words.select("item", F.expr(f"least(size(w), {n})").alias("len"), F.expr(
        f"if(w is null, null, transform(sequence(0, greatest(size(w) - {n}, 0)), i -> array_join(slice(w, i + 1, {n}), ' ')))").alias("wins"))
    return (wins.select("item", "len", F.explode("wins").alias("win")).groupBy("win", "len")
            .agg(F.array_sort(F.collect_set("item")).alias("items")))


def _hash(array: str, at: str, n: int) -> str:
    return "xxhash64(" + ", ".join(f"{array}[{at} + {j}]" for j in range(n)) + ")"


def with_hits(docs: DataFrame, windows: DataFrame, n: int = WINDOW, max_set: int = 50_000,
              text: str = "text") -> DataFrame:
    """Add ``_n_words`` and ``_hits`` (verified window occurrences: first word, length, window)."""
    sep = SEPARATOR.replace("\\", "\\\\")
    rows = windows.select("win", "len").limit(max_set + 1).collect()
    docs = once(docs, _u=F.array_remove(F.split(F.upper(F.coalesce(F.col(text), F.lit(""))), SEPARATOR), ""))
    docs = docs.withColumn("_n_words", F.size("_u").cast("long"))
    if len(rows) <= max_set:
        scans = []
        for size in sorted({r.len for r in rows}):
            wins = windows.where(F.col("len") == size).select(F.split(F.upper("win"), " ").alias("w"))
            lead = min(2, size)
            sets = wins.select(F.expr(_hash("w", "0", lead)).alias("a"), F.expr(_hash("w", "0", size)).alias("b")).collect()
            first, whole = (", ".join(f"{x}L" for x in sorted({r[k] for r in sets})) for k in (0, 1))
            scans.append(f"if(size(_u) < {size}, cast(array() as array<struct<pos:int,len:int>>), transform(filter(sequence(0, size(_u) - {size}), "
                         f"i -> {_hash('_u', 'i', lead)} in ({first}) and {_hash('_u', 'i', size)} in ({whole})), "
                         f"i -> struct(i as pos, {size} as len)))")
        found = f"concat({', '.join(scans)})" if scans else "cast(array() as array<struct<pos:int,len:int>>)"
        docs = once(docs, _cand=F.expr(found)).drop("_u")
        literals = ", ".join("'" + r.win + "'" for r in rows) or "''"  # words hold no quotes or backslashes
        check = f"x.win in ({literals})"
    else:
        docs = docs.withColumn("_key", F.xxhash64(F.col(text)))
        wins = windows.select(F.xxhash64(F.upper("win")).alias("_h"), F.col("len").alias("_len"), F.col("win").alias("_win"))
        found = None
        for (size,) in sorted(tuple(r) for r in windows.select("len").distinct().collect()):
            at = docs.where(F.size("_u") >= size).select("_key", F.posexplode(F.expr(
                f"if(_u is null, null, transform(sequence(0, size(_u) - {size}), i -> xxhash64(array_join(slice(_u, i + 1, {size}), ' '))))"
            )).alias("_pos", "_h"))
            part = at.join(wins.where(F.col("_len") == size), "_h").select("_key", F.struct(
                F.col("_pos").cast("int").alias("pos"), F.lit(size).alias("len"), F.col("_win").alias("win")).alias("_c"))
            found = part if found is None else found.unionByName(part)
        found = found.groupBy("_key").agg(F.collect_set("_c").alias("_found"))
        docs = docs.drop("_u").join(found, "_key", "left").drop("_key")
        docs = docs.withColumn("_cand", F.coalesce("_found", F.expr(f"cast(array() as {HITS})")))
        docs = docs.drop("_found")
        check = None
    docs = once(docs, _w=F.expr(f"if(size(_cand) = 0, null, array_remove(split(translate({_q(text)}, '{ABC}', '{ABC.lower()}'), '{sep}'), ''))"))
    win = "array_join(slice(_w, c.pos + 1, c.len), ' ')"
    if check:
        hits = f"filter(transform(_cand, c -> struct(c.pos as pos, c.len as len, {win} as win)), x -> {check})"
    else:
        hits = f"filter(_cand, c -> {win} = c.win)"
    return once(docs, _hits=F.expr(f"if(_w is null, cast(array() as {HITS}), {hits})")).drop("_w", "_cand")


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


#: Words covered by a document's hits.
COVERED = """aggregate(array_sort(_hits), named_struct('e', 0, 't', 0L),
  (a, x) -> named_struct('e', greatest(a.e, x.pos + x.len), 't', a.t + greatest(0, x.pos + x.len - greatest(a.e, x.pos))),
  a -> a.t)"""


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_set: int = 50_000) -> DataFrame:
    """One row a document row: doc_id, n_words, n_hit, spans of hit words, item ids."""
    windows = benchmark_windows(benchmark, n)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    found = with_hits(src, windows, n, max_set)
    spans = F.expr("transform(_hits, x -> struct(x.pos as start, x.pos + x.len as end))")
    rows = found.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.col("_n_words").alias("n_words"),
                        F.expr(COVERED).alias("n_hit"), spans.alias("spans"),
                        F.expr("array_distinct(transform(_hits, x -> x.win))").alias("wins"))
    one = rows.select("_row", "doc_id", "n_words", "n_hit", "spans", F.explode_outer("wins").alias("win"))
    items = broadcast_checked(windows.select("win", "items"), max_set)
    return (one.join(items, "win", "left").groupBy("_row")
            .agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("n_hit").alias("n_hit"),
                 F.first("spans").alias("spans"),
                 F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).drop("_row"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_set: int = 50_000) -> DataFrame:
    """The documents without any benchmark window, with all their columns (whatever their names)."""
    packed = docs.select(F.struct("*").alias("_row"), F.col("text").alias("text"))
    return with_hits(packed, benchmark_windows(benchmark, n), n, max_set).where(F.size("_hits") == 0).select("_row.*")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bp AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM bp),
sizes AS (SELECT DISTINCT n FROM bw),
dp AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM dp),
hit AS (SELECT r, dw.n, i, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
item AS (SELECT r, count(id) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN item USING (r)
"""


@query("op6_decontaminate", SQL)
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` against all of ``benchmark``."""
    found = contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), F.expr("n_hit > 0").alias("contaminated"))
