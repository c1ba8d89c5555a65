"""Output hygiene shared by Spark bindings and SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

DIGITS = 6
EXACT_BELOW = 1e6  # doubles below this hold nine decimal places


def round_doubles(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column (sum order differs between engines).

    A first rounding three digits finer removes the noise of the summation order, so that both engines hold the
    same double; the second is arithmetic on that double (the engines' own functions treat ties differently), so
    it gives the same one again.
    """
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            x = F.col(f.name).cast("double")
            near, unit = F.round(x, digits + 3), F.lit(float(10 ** digits))
            # + 0.0 folds -0.0 into 0.0 so both engines print the same zero
            cols.append((F.when(F.abs(x) < EXACT_BELOW, F.floor(near * unit + 0.5) / unit)
                         .otherwise(F.round(near, digits)) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def sql_round(sql: str, doubles: list[str], digits: int = DIGITS) -> str:
    """Wrap a DuckDB query so the listed double columns are rounded as ``round_doubles`` does."""
    if not doubles:
        return sql
    unit = f"CAST({10 ** digits} AS DOUBLE)"

    def rounded(c: str) -> str:
        x = f"CAST({c} AS DOUBLE)"
        near = f"round({x}, {digits + 3})"
        return (f"(CASE WHEN abs({x}) < {EXACT_BELOW!r} THEN floor({near} * {unit} + CAST(0.5 AS DOUBLE)) / {unit} "
                f"ELSE round({near}, {digits}) END + 0.0) AS {c}")

    return f"SELECT * REPLACE ({', '.join(map(rounded, doubles))}) FROM (\n{sql}\n) AS _q"


def with_ctes(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body}"
