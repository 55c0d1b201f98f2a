"""Connected components of a link table by alternating stars.

Each round joins a table of links with the smallest neighbour of every vertex, which Spark pre-aggregates before it
shuffles; a vertex with very many links is only a skewed join key, which adaptive execution splits. Nothing is collected.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidloom.llm.storage import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour larger than u is linked with the smallest vertex around u."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked with the smallest of them; links run from larger to smaller."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(u, v) links to (id, component): the smallest id reachable from each linked id. Ids without links have no row.

    Nulls and links of an id with itself are ignored. Rounds are written to the shared folder.
    """
    now = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                 .where("u > v").distinct(), name)
    before = None
    while True:
        now = stored(_small_star(_large_star(now)), name)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    tops = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(tops)
