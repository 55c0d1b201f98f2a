"""Joins with a table of unique keys when one key of the other side may hold a large share of its rows."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: a key with more than this share of the rows is hot, so that there are fewer than 1,000 hot keys in a table of any size
HOT_SHARE = 1000


def join_hot(rows: DataFrame, keyed: DataFrame, keys: list[str], counts: DataFrame, how: str = "left") -> DataFrame:
    """``rows`` joined with ``keyed``, which has each key once; ``counts`` has the keys of ``rows`` and their number ``n``.

    Hot keys (fewer than HOT_SHARE, whatever the data) are broadcast; the others are shuffled, and none of them has more
    than one in HOT_SHARE of the rows. Keys must not be null.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") * HOT_SHARE > F.lit(total)).select(*keys)
    marked = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), keys, "left")
    few = keyed.join(F.broadcast(hot), keys)
    first = marked.where("__hot").drop("__hot").join(F.broadcast(few), keys, how)
    return first.unionByName(marked.where("__hot is null").drop("__hot").join(keyed.hint("shuffle_merge"), keys, how))
