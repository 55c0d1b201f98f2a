"""Column expressions on feature sets and score arrays."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidloom.bounds import string_array


def feature_array(features: Column, vocab: list[str]) -> Column:
    """0/1 array in vocabulary order; features outside the vocabulary are ignored."""
    return F.array(*[F.array_contains(features, v).cast("double") for v in vocab])


def let(value: Column, build) -> Column:
    """``build(value)`` with the value computed once for each row, however often ``build`` uses it."""
    return F.get(F.transform(F.array(value), build), 0)


def _total(scores: Column) -> Column:
    return F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + x)


def softmax_rescale(p: Column, temperature: float = 1.0) -> Column:
    """exp(p/t) divided by its sum."""
    powers = F.transform(p, lambda x: F.exp(x / F.lit(temperature)))
    return let(powers, lambda e: let(_total(e), lambda total: F.transform(e, lambda x: x / total)))


def argmax(p: Column) -> Column:
    """Zero-based position of the largest score, the first one on a tie."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def mask_scores(p: Column, masked: Column) -> Column:
    """Scores with the masked positions set to zero."""
    return F.zip_with(p, masked, lambda x, m: F.when(m, F.lit(0.0)).otherwise(x))


def mask_renorm(p: Column, masked: Column, final: Column) -> Column:
    """struct(top, confidence): on a final check masked classes score zero and the top is renormalised."""
    def picked(scores: Column) -> Column:
        top = F.array_max(scores)
        return F.struct(
            argmax(scores).alias("top"),
            F.when(final, top / (_total(scores) + F.lit(1e-9))).otherwise(top).alias("confidence"),
        )

    return let(p, lambda q: let(F.when(final, mask_scores(q, masked)).otherwise(q), picked))


def mean_scores(members: list[Column]) -> Column:
    """Element-wise mean of score arrays of the same length."""
    total = members[0]
    for m in members[1:]:
        total = F.zip_with(total, m, lambda x, y: x + y)
    return F.transform(total, lambda x: x / F.lit(float(len(members))))


def suggest(known: Column, pool: list[str], vocab: list[str], limit: int, min_fill: int = 4) -> Column:
    """Unknown pool members of the vocabulary in pool order, filled from the vocabulary to ``min_fill``."""
    members = set(vocab)
    first = F.array_except(string_array([p for p in pool if p in members]), known)
    rest = F.array_except(F.array_except(string_array(vocab), known), first)
    missing = F.greatest(F.lit(min_fill) - F.size(first), F.lit(0))
    return F.slice(F.concat(first, F.slice(rest, F.lit(1), missing)), 1, limit)
