"""Size checks for small inputs.

A lexicon or rule base is turned into literals, or broadcast, only after counting it. Every caller has another
plan for a side that is larger than the bound.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

LITERAL_ROWS = 200
HIT_ROWS = 2_000
BROADCAST_ROWS = 20_000


def local_table(spark: SparkSession, rows: list, schema: str | StructType) -> DataFrame:
    """Small in-memory table (a local relation, so that the planner knows its size)."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    names = schema.fieldNames()
    records = [dict(zip(names, r)) for r in rows]
    df = spark.createDataFrame(pa.Table.from_pylist(records, schema=to_arrow_schema(schema)), schema)
    df._known_rows = [Row(**r) for r in records]
    return df


def small_rows(df: DataFrame, limit: int) -> list[Row] | None:
    """Rows of ``df`` when it has at most ``limit`` of them, else None. Rows of a local table are known already."""
    rows = df.__dict__.get("_known_rows")
    if rows is None:
        rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint when it is counted to be small, else for a shuffled join.

    The larger one carries a hint, since the planner's own guess is far too low for exploded and collected rows. Rows
    come as an Arrow table, not as Python objects.
    """
    rows = df.__dict__.get("_known_rows")
    if rows is not None:
        return F.broadcast(local_table(df.sparkSession, [tuple(r) for r in rows], df.schema)) if len(rows) <= limit else df.hint("merge")
    found = df.limit(limit + 1).toArrow()
    if found.num_rows > limit:
        return df.hint("merge")
    return F.broadcast(df.sparkSession.createDataFrame(found, df.schema))


def sql_text(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_array(values: list[str]) -> str:
    return f"array({', '.join(sql_text(v) for v in values)})" if values else "cast(array() as array<string>)"


def string_array(values: list[str]) -> Column:
    """Array literal; parsed from SQL, since long column expressions are slow to build call by call."""
    return F.expr(sql_array(values))


def spread(df: DataFrame) -> DataFrame:
    """Use every core for CPU-heavy text work on an input with fewer splits than cores.

    An input of normal size has more splits than cores and is returned without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
