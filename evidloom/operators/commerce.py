"""Catalog, cart and listing reports."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidloom.functions.scalars import price_parse


def distinct_names(df: DataFrame, name: str) -> DataFrame:
    """Distinct trimmed names that are not blank, sorted."""
    return df.select(F.trim(name).alias("name")).where(F.col("name") != "").distinct().orderBy("name")


def catalog_union(names: DataFrame, extra: DataFrame) -> DataFrame:
    """Names followed by the extra items, without removing items that are in both."""
    return names.select("name", F.lit(0).alias("part")).unionByName(extra.select("name", F.lit(1).alias("part")))


def cart_lines(lines: DataFrame) -> DataFrame:
    """One row per cart and product with the summed quantity of ``(cart_id, product_id, qty)``."""
    return lines.groupBy("cart_id", "product_id").agg(F.sum("qty").alias("qty"))


def cart_totals(lines: DataFrame, products: DataFrame) -> DataFrame:
    """``(cart_id, cart_total, cart_count)`` from quantities and the price texts of the products.

    Sums do not need the lines of a cart merged by product first, so this is one join and one aggregation.
    """
    prices = products.select("product_id", price_parse(F.col("price")).alias("unit"))
    priced = lines.join(prices, "product_id", "left")
    return priced.groupBy("cart_id").agg(
        F.sum(F.coalesce("unit", F.lit(0)) * F.col("qty")).alias("cart_total"), F.sum("qty").alias("cart_count"))


def cart_adjust(deltas: DataFrame, keys: list[str], order: list[str], block: Column) -> DataFrame:
    """Quantity after applying ``delta`` in order, never below zero after any step; lines that end at zero are dropped.

    A run of steps acts on a quantity q as max(q + total, floor), with floor = total - least running sum (or 0), and
    two runs in a row combine to one of the same form. So every ``block`` of a key (any function of the first order
    column that keeps its order) is reduced on its own, and only one row per block goes into the final pass: a key
    with very many steps is spread over its blocks.
    """
    rows = deltas.withColumn("_block", block)
    steps = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    runs = rows.withColumn("_sum", F.sum("delta").over(steps)).groupBy(*keys, "_block").agg(
        F.sum("delta").alias("_total"), F.min("_sum").alias("_low"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_low", F.col("_low") + F.coalesce(F.sum("_total").over(before), F.lit(0)))
    ends = runs.groupBy(*keys).agg(F.sum("_total").alias("_end"), F.min("_low").alias("_least"))
    return ends.withColumn("qty", F.col("_end") - F.least(F.col("_least"), F.lit(0))).where(F.col("qty") > 0).drop(
        "_end", "_least")


def listing(df: DataFrame, ts: str, ties: list[str], fmt: str = "yyyy-MM-dd HH:mm") -> DataFrame:
    """Newest first, with the time as text; ties keep a fixed order."""
    return df.orderBy(F.desc(ts), *[F.asc(t) for t in ties]).withColumn(ts, F.date_format(ts, fmt))
