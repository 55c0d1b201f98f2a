"""Input columns that an operator only passes on, held as one struct so that no name of theirs can clash."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def carried(df: DataFrame, replaced: list[str], *more) -> DataFrame:
    """``row`` (the columns of ``df`` but those in ``replaced``) and further columns."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in replaced]).alias("row"), *more)
