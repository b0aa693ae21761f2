"""Stand-in tables for sources that cannot be reached.

Every value is a hash of its row number, so the tables are the same on any cluster, however
they are split, and a lost task rebuilds exactly what it had.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from covermap import fixed_values as fixed
from covermap.sources.spec import Source

_BITS = 1 << 52


class _Draw:
    """Reproducible random columns for one table; each call draws from a stream of its own."""

    def __init__(self, seed: int):
        self._seed, self._stream = seed, 0

    def _bits(self) -> Column:
        self._stream += 1
        return F.pmod(F.xxhash64("id", F.lit(self._seed), F.lit(self._stream)), F.lit(_BITS))

    def integer(self, low: int, high: int) -> Column:
        """Uniform whole numbers from ``low`` to ``high - 1``."""
        return F.lit(low) + F.pmod(self._bits(), F.lit(high - low))

    def choice(self, labels: Sequence[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, labels)), (self.integer(1, len(labels) + 1)).cast("int"))

    def normal(self, mean: float, deviation: float) -> Column:
        """Box-Muller from two uniform draws, rounded to whole units."""
        radius = F.sqrt(-2 * F.log((self._bits() + 1) / _BITS))
        angle = F.cos(2 * F.pi() * self._bits() / _BITS)
        return F.round(mean + deviation * radius * angle, 0)


def _day(offset: Column) -> Column:
    base = F.lit(fixed.SYNTHETIC_BASE_DAY).cast("date")
    return F.date_add(base, offset.cast("int")).cast("timestamp")


def orders(spark: SparkSession, rows: int = fixed.SYNTHETIC_ROWS["orders"]) -> DataFrame:
    draw = _Draw(fixed.SYNTHETIC_SEEDS["orders"])
    return spark.range(rows).select(
        (F.col("id") + 1).alias("order_id"),
        draw.integer(*fixed.ORDER_CUSTOMERS).alias("customer_id"),
        _day(draw.integer(*fixed.ORDER_DAYS)).alias("order_date"),
        draw.normal(*fixed.ORDER_AMOUNT).alias("order_amount"),
        draw.integer(*fixed.ORDER_DELAYS).alias("shipping_delay_days"),
        draw.choice(fixed.PRODUCT_CATEGORIES).alias("product_category"))


def customers(spark: SparkSession, rows: int = fixed.SYNTHETIC_ROWS["customers"]) -> DataFrame:
    draw = _Draw(fixed.SYNTHETIC_SEEDS["customers"])
    return spark.range(rows).select(
        (F.col("id") + fixed.FIRST_CUSTOMER).alias("customer_id"),
        _day(-draw.integer(*fixed.SIGNUP_DAYS_AGO)).alias("signup_date"),
        F.format_string("user%d@example.com", "id").alias("email"),
        _day(-draw.integer(*fixed.LOGIN_DAYS_AGO)).alias("last_login_at"),
        draw.normal(*fixed.CUSTOMER_SPEND).alias("total_spend"),
        draw.choice(fixed.REGIONS).alias("region"))


def inventory(spark: SparkSession, rows: int = fixed.SYNTHETIC_ROWS["inventory"]) -> DataFrame:
    draw = _Draw(fixed.SYNTHETIC_SEEDS["inventory"])
    return spark.range(rows).select(
        F.format_string("SKU-%05d", "id").alias("sku"),
        draw.integer(*fixed.WAREHOUSES).alias("warehouse_id"),
        draw.integer(*fixed.STOCK).alias("stock_qty"),
        draw.integer(*fixed.REORDER_POINTS).alias("reorder_point"),
        draw.normal(*fixed.UNIT_COST).alias("unit_cost"))


_TABLES = {"orders": orders, "customers": customers, "inventory": inventory}


def synthetic_source(spark: SparkSession, name: str) -> Source:
    """A stand-in under the label its real table would carry, marked ``is_synthetic``."""
    return Source(name, fixed.SYNTHETIC_LABELS[name], name, _TABLES[name](spark), is_synthetic=True)


def synthetic_fallbacks(spark: SparkSession) -> dict[str, Callable[[], Source]]:
    return {name: partial(synthetic_source, spark, name) for name in _TABLES}
