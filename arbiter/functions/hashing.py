"""Deterministic hash-uniforms: the engine's replacement for seeded RNGs.

A value in [0, 1) is derived from the first 8 hex digits of ``md5`` of a
key string, so the same row always draws the same number on every executor
and after any recomputation (unlike ``rand()`` after a lost task), and the
same number can be computed in plain SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def key_string(*parts) -> Column:
    """``part1:part2:...`` with every part cast to string."""
    cols = []
    for i, p in enumerate(parts):
        if i:
            cols.append(F.lit(":"))
        cols.append(p.cast("string") if isinstance(p, Column) else F.lit(str(p)))
    return F.concat(*cols)


def hash_hex(*parts) -> Column:
    return F.md5(key_string(*parts))


def hash_uniform(*parts) -> Column:
    """Uniform in [0, 1) from md5 of the joined parts."""
    h = F.substring(hash_hex(*parts), 1, 8)
    return F.conv(h, 16, 10).cast("double") / F.lit(TWO_32)


def sql_hash_uniform(expr: str) -> str:
    """DuckDB form of :func:`hash_uniform` for a string expression."""
    return f"(CAST(('0x' || substr(md5({expr}), 1, 8)) AS BIGINT) / 4294967296.0)"
