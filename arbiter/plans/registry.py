"""Query registry: name -> Spark binding, and name -> DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arbiter.plans.util import round_doubles, sql_round

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, doubles: tuple[str, ...] | list[str] = ()):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    Double columns are rounded on the Spark side (all of them) and on the
    SQL side (the listed ones) so engine-specific summation order does not
    change the compared values.
    """
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql_round(sql, list(doubles))
        return fn
    return deco
