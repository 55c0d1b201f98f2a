"""Small helpers shared by the operators."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns that later filters use, without evaluating them again in the filter.

    A filter is not pushed below a generator, so the expressions run once per row.
    """
    packed = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    kept = [F.col(c) for c in df.columns]
    return df.select(*kept, packed.alias("_once")).select(*kept, *[F.col(f"_once.{n}").alias(n) for n in columns])


def top_k(df: DataFrame, keys: list, order: list, k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per key. The rank filter is also applied before the shuffle (window group limit),
    so a hot key sends at most ``k`` rows per task."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def first_by(df: DataFrame, keys: list, order: list) -> DataFrame:
    return top_k(df, keys, order, 1)
