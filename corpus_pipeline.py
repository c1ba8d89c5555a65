"""From raw documents to token ids: five stages, each an operator of ``arbiter.llm``.

A stage is a function (spark, docs, sf_dir) -> DataFrame.  Its result is written as Parquet and read again as the
next one's ``docs``; all stages but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arbiter.llm import credentials, decontaminate, factorization, jaccard_join, pieces
from arbiter.llm.tables import load, materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine rejects go."""
    return factorization.keep_predicted(docs, factorization.train(docs, load(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays."""
    return jaccard_join.drop_near_duplicates(docs)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark windows go."""
    return decontaminate.remove_contaminated(docs, load(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; no document goes."""
    return credentials.redact(docs, credentials.learn(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts, with digests of the ids and of the decoded text.

    Workers remember a quarter of the segments that they do by default: the stages before leave them less memory.
    """
    return pieces.encode_documents(docs, pieces.default_path(), with_ids=True, keep=100_000, slice_bytes=2 << 20)


STAGES = [("quality_classifier", quality), ("near_duplicates", near_duplicates), ("decontamination", contaminated),
          ("secrets", secrets), ("sentencepiece", encode)]

#: A fitted classifier, redaction and merge-type encoding aren't expressible in SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
