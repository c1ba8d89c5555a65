"""Scalar display helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: name tokens deciding the display format, first match wins
CURRENCY_TOKENS = ("charge", "cost", "price", "payment", "bill", "amount", "salary", "income", "fee")
PERCENT_TOKENS = ("percent", "rate", "pct", "ratio")
COUNT_TOKENS = ("count", "quantity", "num", "total_charges", "times", "calls", "contracts", "months")
DURATION_TOKENS = ("age", "tenure", "year", "month", "day", "length")


def _has(name: Column, tokens) -> Column:
    cond = F.lit(False)
    for t in tokens:
        cond = cond | name.contains(t)
    return cond


def human_readable(feature: Column, value: Column) -> Column:
    """Currency -> percent -> integer count -> months/years -> 2 dp, by feature name."""
    n = F.lower(feature)
    v = value.cast("double")
    whole = F.bround(v, 0).cast("long").cast("string")
    return (F.when(_has(n, CURRENCY_TOKENS), F.concat(F.lit("$"), F.format_number(v, 2)))
            .when(_has(n, PERCENT_TOKENS), F.concat(F.format_string("%.1f", v), F.lit("%")))
            .when(_has(n, COUNT_TOKENS), whole)
            .when(_has(n, DURATION_TOKENS),
                  F.concat(whole, F.when(n.contains("tenure") | n.contains("month"), F.lit(" months"))
                           .otherwise(F.lit(" years"))))
            .otherwise(F.format_string("%.2f", v)))


def title_case(c: Column) -> Column:
    """``logistic_regression`` -> ``Logistic Regression``."""
    return F.initcap(F.regexp_replace(c, "_", " "))
