"""Lexicon matching on DataFrames, with a plan for lexicons of any size.

Up to ``LITERAL_ROWS`` entries a lexicon becomes literals in one narrow projection (no shuffle, no explode). A larger
one is an automaton that reads each text once, in the same projection (``scanning``).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidloom.bounds import LITERAL_ROWS, small_rows
from evidloom.functions import lexicon as lx
from evidloom.operators.scanning import occurring


def match_terms(df: DataFrame, keys: list[str], low: str, lexicon: DataFrame, term: str, order: str, mode: str,
                out: str, literal_rows: int = LITERAL_ROWS, fold: bool | None = None) -> DataFrame:
    """Add array ``out`` with the terms found in ``low`` (a column of lower-case text), in lexicon order.

    ``mode`` is ``substring`` or ``word``. Terms are lower-cased before the comparison with ``fold``, else compared as
    given; substrings are folded and words are not unless it is set. No plan shuffles the rows, so ``keys`` are not used.
    """
    fold = mode == "substring" if fold is None else fold
    rows = small_rows(lexicon, literal_rows)
    if rows is None:
        return _match_scanned(df, low, lexicon, term, order, mode, out, fold)
    terms = [r[term] for r in sorted(rows, key=lambda r: r[order])]
    find = lx.substring_terms if mode == "substring" else lx.word_terms
    return df.withColumn(out, find(F.col(low), terms, fold))


def _match_scanned(df: DataFrame, low: str, lexicon: DataFrame, term: str, order: str, mode: str, out: str,
                   fold: bool) -> DataFrame:
    compared = F.lower(term) if fold else F.col(term)
    hit = F.array(F.struct(F.col(order).cast("long").alias("ord"), F.col(term).alias("value")))
    entries = lexicon.select(compared.alias("_low"), hit.alias("_found"))
    found = occurring(low, entries, "_low", "_found", mode == "word")
    return df.withColumn(out, F.transform(found, lambda s: s["value"]))
