"""Small helpers on DataFrames shared by the operators of this subpackage."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbiter.llm.words import SLICE_BYTES, slices
from arbiter.operators.common import materialize
from arbiter.session import ship_package
from arbiter.sources.tables import load

__all__ = ["load", "materialize", "fold", "by_slices", "broadcast_checked", "one_label", "once", "release", "shard_bits", "small_batches"]


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (a null id counts as 0)."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n)), F.lit(0))


BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"),
         "spark.sql.execution.arrow.maxBytesPerBatch": (str(64 << 20), str(8 << 20))}


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Python workers have this package and that cuts Arrow batches to 2,000 rows and 8 MB where it has Spark's defaults:
    rows are whole texts here, and both the JVM and the Python worker hold a batch several times over."""
    ship_package(df.sparkSession)
    conf = df.sparkSession.conf
    for key, (default, ours) in BATCH.items():
        if conf.get(key, default).rstrip("b") == default:
            conf.set(key, ours)
    return df


def by_slices(df: DataFrame, text: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]],
              schema: str, limit: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` over slices of about 2 MB of text, so that memory doesn't follow the batch size."""
    def run(batches):
        for b in batches:
            for s in slices(b, text, limit):
                out = fn(s)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
    return small_batches(df).mapInArrow(run, schema)


def broadcast_checked(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` if it has at most ``max_rows`` rows; else leave the join to Spark."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def one_label(labels: DataFrame, value: str, key: str = "doc_id") -> DataFrame:
    """One label a key: rows without key or label go, and of several labels the smallest stays."""
    return (labels.select(F.col(key).alias("_key"), F.col(value).alias("_label"))
            .where("_key is not null and _label is not null").groupBy("_key").agg(F.min("_label").alias("_label")))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once a row.

    A plain projection may be inlined by the optimizer: a later filter on the column is pushed below it, and
    an expression that a lambda mentions is then computed for every element.  Neither passes a generator.
    """
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once")
    return df.select("*", made).select(*[f"`{c}`" for c in df.columns], *[F.col(f"_once.{n}").alias(n) for n in columns])


def release(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote, once everything that reads them has been written itself."""
    for t in tables:
        spark, files = t.sparkSession, t.inputFiles()
        if files:
            folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(files[0])).getParent()
            if not folder.getName().startswith("mat-"):
                raise ValueError(f"not a materialized table: {folder}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def shard_bits(df: DataFrame, texts_a_shard: int = 8 << 20) -> int:
    """log2 of a number of shards of which each gets about ``texts_a_shard`` bytes of ``df``'s input files at most.

    It follows the scan's partitions and their largest size, both of which the driver knows without a job.
    """
    size = str(df.sparkSession.conf.get("spark.sql.files.maxPartitionBytes", "128m")).lower().rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(size[-1], 1)
    limit = int(float(size.rstrip("kmg")) * unit)
    return max(4, math.ceil(math.log2(max(1, df.rdd.getNumPartitions() * max(1, limit / texts_a_shard)))))
