"""Synthetic churn table keyed on an existing table's rows (S3).

The reference draws 500 rows from a seeded RNG.  Here every column of a row
is a hash-uniform of ``(key, column)``, so the table is reproducible on any
cluster, grows with its key table, and has an identical SQL definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbiter.functions.hashing import hash_uniform

# fixed values of the generator
REGIONS = ["North", "South", "East", "West"]
CATEGORIES = ["Electronics", "Clothing", "Home", "Sports"]
PAYMENTS = ["Credit Card", "Debit Card", "PayPal"]


def _u(key: Column, col: str) -> Column:
    return hash_uniform(key, col)


def _int_range(key, col, lo, hi) -> Column:
    """Integer in ``[lo, hi)``."""
    return (F.lit(lo) + F.floor(_u(key, col) * (hi - lo))).cast("int")


def _choice(key, col, values) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]),
                        (F.floor(_u(key, col) * len(values)) + 1).cast("int"))


def churn_table(keys: DataFrame, key: str) -> DataFrame:
    """One synthetic customer per key row, columns as the reference generator."""
    k = F.col(key)
    order_value = -50.0 * F.log(1.0 - _u(k, "order_value")) + 10.0
    age = _int_range(k, "customer_age", 18, 75)
    prev = _int_range(k, "num_previous_orders", 0, 50)
    disc = (_u(k, "discount_applied") >= 0.7).cast("int")
    base = keys.select(
        k.cast("long").alias("id"),
        order_value.alias("order_value"), age.alias("customer_age"),
        _int_range(k, "days_since_signup", 1, 365).alias("days_since_signup"),
        prev.alias("num_previous_orders"),
        _choice(k, "customer_region", REGIONS).alias("customer_region"),
        _choice(k, "product_category", CATEGORIES).alias("product_category"),
        _choice(k, "payment_method", PAYMENTS).alias("payment_method"),
        (-10.0 * F.log(1.0 - _u(k, "time_on_site_minutes")) + 1.0).alias("time_on_site_minutes"),
        _int_range(k, "items_in_cart", 1, 10).alias("items_in_cart"),
        disc.alias("discount_applied"), _u(k, "churn").alias("_uc"))
    p = (F.lit(0.3) - 0.01 * (F.col("order_value") - 10) / 100 - 0.02 * F.col("num_previous_orders") / 10
         - 0.001 * F.col("customer_age") / 10 + 0.05 * (1 - F.col("discount_applied")))
    p = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    return base.withColumn("churn", (F.col("_uc") < p).cast("int")).drop("_uc")
