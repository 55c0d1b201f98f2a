"""String similarity on a 0-100 scale.

``indel_ratio`` is native: the longest common subsequence comes from a bit-vector recurrence (Hyyro 2004) over one
64-bit integer, one step per character, so no table is built per pair. Strings over 62 characters take a row-by-row
dynamic programme instead.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from evidloom.shipping import ship_by_value

ship_by_value(__name__)
WORD_BITS = 62


def _lcs_bits(a: str, b: str) -> str:
    """SQL for the common subsequence length; ``b`` has at most WORD_BITS characters."""
    full = f"(shiftleft(1L, length({b})) - 1L)"
    mask = (f"aggregate(transform(split({b}, ''), (x, i) -> if(x = c, shiftleft(1L, i), 0L)), 0L, "
            "(acc, x) -> acc | x)")
    masks = f"transform(split({a}, ''), c -> {mask})"
    left = f"aggregate({masks}, {full}, (v, m) -> ((v + (v & m)) | (v - (v & m))) & {full})"
    return f"length({b}) - bit_count({left})"


def _lcs_table(a: str, b: str) -> str:
    """SQL for the common subsequence length of strings of any size, one table row at a time."""
    cell = (f"if(get(split({b}, ''), j - 1) = c, get(above, j - 1) + 1, greatest(get(above, j), get(row, j - 1)))")
    row = f"aggregate(sequence(1, length({b})), array(0), (row, j) -> array_append(row, {cell}))"
    return (f"try_element_at(aggregate(split({a}, ''), array_repeat(0, length({b}) + 1), (above, c) -> {row}), -1)")


def indel_ratio_sql(a: str, b: str) -> str:
    lcs = (f"CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 WHEN length({b}) <= {WORD_BITS} THEN {_lcs_bits(a, b)} "
           f"WHEN length({a}) <= {WORD_BITS} THEN {_lcs_bits(b, a)} ELSE {_lcs_table(a, b)} END")
    total = f"(length({a}) + length({b}))"
    return f"CASE WHEN {total} = 0 THEN 100 ELSE int(bround(200.0D * ({lcs}) / nullif({total}, 0), 0)) END"


def indel_ratio(a: str, b: str) -> Column:
    """round(200 * LCS / (length a + length b)) of two columns, half to even; 100 for two empty strings.

    Written as one SQL expression, because a tree of this size is slow to build call by call.
    """
    return F.expr(indel_ratio_sql(a, b))


def needed_overlap(cutoff: int) -> float:
    """Smallest 2*LCS/(la+lb) that still rounds to ``cutoff``."""
    return (cutoff - 0.5) / 100.0


def could_reach(a: Column, b: Column, cutoff: int) -> Column:
    """Cheap native test that every pair at or above the cutoff passes.

    LCS is at most the shorter length, and the edit distance with replacements is at most the one without, which the
    cutoff bounds by a share of the total length.
    """
    total = F.length(a) + F.length(b)
    edits = F.floor(total * (1 - needed_overlap(cutoff)) + 1e-9).cast("int")
    return (F.least(F.length(a), F.length(b)) * 2.0 >= total * needed_overlap(cutoff)) & (
        F.call_function("levenshtein", a, b, edits) >= 0)


# --- weighted ratio -------------------------------------------------------------------------------------------------

_KNOWN_MASKS: dict[str, dict[str, int]] = {}
_KNOWN_LIMIT = 65536


def _masks(s: str) -> dict[str, int]:
    """Positions of every character as bits, remembered within a worker."""
    masks = _KNOWN_MASKS.get(s)
    if masks is None:
        masks = {}
        for i, c in enumerate(s):
            masks[c] = masks.get(c, 0) | (1 << i)
        if len(_KNOWN_MASKS) >= _KNOWN_LIMIT:
            _KNOWN_MASKS.clear()
        _KNOWN_MASKS[s] = masks
    return masks


def _lcs(a: str, b: str) -> int:
    full, masks = (1 << len(b)) - 1, _masks(b)
    v = full
    for c in a:
        u = v & masks.get(c, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


def _plain(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * _lcs(a, b) / total if total else 100.0


def _partial(a: str, b: str) -> float:
    """Best ratio of the shorter string with any window of the longer one that is at most as long."""
    short, long = sorted((a, b), key=len)
    n = len(short)
    if not n or not _lcs(long, short):
        return 0.0
    return max(_plain(long[max(0, i): i + n], short) for i in range(1 - n, len(long)))


def _forms(s: str) -> tuple[str, str, frozenset]:
    """Processed text, its tokens in sorted order, and the set of its tokens."""
    text = "".join(c if c.isalnum() else " " for c in s.lower()).strip()
    tokens = text.split()
    return text, " ".join(sorted(tokens)), frozenset(tokens)


def _token_set(x: frozenset, y: frozenset) -> float:
    both = " ".join(sorted(x & y))
    only_x, only_y = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 100.0
    with_x, with_y = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
    best = _plain(with_x, with_y)
    return max(best, _plain(both, with_x), _plain(both, with_y)) if both else best


def _partial_token_set(x: frozenset, y: frozenset) -> float:
    return 100.0 if x & y else _partial(" ".join(sorted(x)), " ".join(sorted(y)))


def weighted_ratio_value(a: str | None, b: str | None) -> int:
    """Weighted ratio of one pair, 0 when either side is empty after processing."""
    return _weighted(_forms(a or ""), _forms(b or ""))


def _weighted(a: tuple[str, str, frozenset], b: tuple[str, str, frozenset]) -> int:
    text_a, sorted_a, set_a = a
    text_b, sorted_b, set_b = b
    if not text_a or not text_b:
        return 0
    spread = max(len(text_a), len(text_b)) / min(len(text_a), len(text_b))
    best = _plain(text_a, text_b)
    single = len(set_a) == len(set_b) == 1 and sorted_a == text_a and sorted_b == text_b
    if spread < 1.5:
        if single:  # One token on each side: the token variants equal the plain ratio.
            return round(best)
        return round(max(best, 0.95 * _plain(sorted_a, sorted_b), 0.95 * _token_set(set_a, set_b)))
    scale = 0.9 if spread <= 8 else 0.6
    best = max(best, scale * _partial(text_a, text_b))
    if single:
        return round(best)
    return round(max(best, scale * 0.95 * max(_partial(sorted_a, sorted_b), _partial_token_set(set_a, set_b))))


@F.pandas_udf(IntegerType())
def weighted_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Arrow-batched ``weighted_ratio_value``; call it on distinct pairs only.

    An approximation of the usual weighted scorer: the partial variants slide one window of the shorter length.
    """
    forms = {s: _forms(s or "") for s in {*a, *b}}
    return pd.Series([_weighted(forms[x], forms[y]) for x, y in zip(a, b)], dtype="int32")
