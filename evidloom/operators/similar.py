"""Similarity joins: all pairs at or above a cutoff, and the best match per string."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom.bounds import LITERAL_ROWS, broadcast_if_small, small_rows, string_array
from evidloom.functions import similarity as sim
from evidloom.operators.common import first_by


def similar_pairs(left: DataFrame, right: DataFrame, cutoff: int, scorer: str = "indel",
                  literal_rows: int = LITERAL_ROWS) -> DataFrame:
    """``(a, b, score)`` for the distinct strings ``left.a`` and ``right.b`` whose score reaches the cutoff.

    A small right side becomes literals, one narrow pass over the left. Otherwise candidates share a piece of text:

    * ``indel``: a pair at the cutoff differs by at most d single-character edits, d following from the lengths. Cut
      into d + 1 pieces, one piece of ``b`` is left unchanged in ``a``, so an equality join on pieces misses no pair.
    * ``weighted``: every positive score needs a common letter or digit.
    """
    rows = small_rows(right, literal_rows)
    if rows is None:
        pairs = _piece_pairs(left, right, cutoff) if scorer == "indel" else _letter_pairs(left, right)
    else:
        names = string_array(list(dict.fromkeys(r.b for r in rows)))
        if scorer == "indel":
            names = F.filter(names, lambda b: sim.could_reach(F.col("a"), b, cutoff))
        pairs = left.select("a", F.explode(names).alias("b"))
    score = sim.indel_ratio("a", "b") if scorer == "indel" else sim.weighted_ratio("a", "b")
    return pairs.withColumn("score", score).where(F.col("score") >= cutoff)


def _substrings(text: Column, sizes: Column) -> Column:
    """All substrings with the given lengths."""
    return F.array_distinct(F.flatten(F.transform(
        F.filter(sizes, lambda n: n <= F.length(text)),
        lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n)),
    )))


def _piece_pairs(left: DataFrame, right: DataFrame, cutoff: int) -> DataFrame:
    need = sim.needed_overlap(cutoff)
    size = F.length("b")
    longest_a = F.floor(size * (2 - need) / need + 1e-9)
    edits = F.floor((longest_a + size) * (1 - need) + 1e-9)
    count = F.least(edits + 1, size).cast("int")
    cuts = F.transform(F.sequence(F.lit(0), count), lambda i: F.floor(i * size / count).cast("int"))
    pieces = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(
        F.col("b"), F.get(cuts, i) + 1, F.get(cuts, i + 1) - F.get(cuts, i)))
    index = right.select("b").distinct().where(size > 0).select("b", F.explode(F.array_distinct(pieces)).alias("_piece"))
    largest = index.agg(F.max(F.length("_piece"))).first()[0] or 1
    sizes = F.sequence(F.lit(1), F.lit(largest))
    at = left.where(F.length("a") > 0).select("a", F.explode(_substrings(F.col("a"), sizes)).alias("_piece"))
    near = at.join(broadcast_if_small(index), "_piece").where(
        sim.could_reach(F.col("a"), F.col("b"), cutoff))
    return near.select("a", "b").distinct()


def _letter_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    def letters(name: str) -> Column:
        return F.array_distinct(F.regexp_extract_all(F.lower(name), F.lit(r"[\p{L}\p{N}]"), F.lit(0)))

    index = broadcast_if_small(right.select("b", F.explode(letters("b")).alias("_c")))
    return left.select("a", F.explode(letters("a")).alias("_c")).join(index, "_c").select("a", "b").distinct()


def fuzzy_best_match(left: DataFrame, keys: DataFrame, cutoff: int, scorer: str = "indel",
                     literal_rows: int = LITERAL_ROWS) -> DataFrame:
    """``(a, key, score)``: the best key per distinct string, the first key on a tie, NULL below the cutoff.

    ``keys`` has ``(key_ord, key)``.
    """
    distinct = left.select("a").distinct()
    pairs = similar_pairs(distinct, keys.select(F.col("key").alias("b")).distinct(), cutoff, scorer, literal_rows)
    ranked = pairs.join(keys.select("key_ord", F.col("key").alias("b")), "b")
    best = first_by(ranked, ["a"], [F.desc("score"), F.asc("key_ord")])
    return distinct.join(best.select("a", F.col("b").alias("key"), "score"), "a", "left")
