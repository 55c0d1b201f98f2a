"""Large lexicons: all entries that occur in a text, by a multi-pattern automaton in Arrow batches.

The entries are collected and broadcast in parts of bounded size; each part becomes one automaton (a trie with failure
links) in every task, which reads a text once whatever the number of entries. Texts are neither exploded nor shuffled.
"""
from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom.shipping import ship_by_value

#: entries and bytes of an automaton; a larger lexicon is several automata, one after another over each batch
PART_ROWS, PART_BYTES = 200_000, 16 << 20
_FOUND = "array<struct<ord:bigint,value:string>>"


def is_word(c: str) -> bool:
    """Letters and numbers of any script, and the underscore."""
    return c == "_" or unicodedata.category(c)[0] in "LN"


class Automaton:
    """``entries``: pattern -> list of (ord, value). With ``words``, a hit must begin and end where a word does."""

    def __init__(self, entries: dict[str, list], words: bool):
        self.words, self.always = words, [] if words else entries.get("", [])
        self.machine = ahocorasick.Automaton()
        for pattern in entries:
            if pattern:
                self.machine.add_word(pattern, pattern)
        self.entries = entries
        if len(self.machine):
            self.machine.make_automaton()

    def found(self, text: str | None) -> list[tuple]:
        if text is None:
            return []
        seen = set()
        if len(self.machine):
            for end, pattern in self.machine.iter(text):
                if pattern not in seen and (not self.words or self._apart(text, end + 1 - len(pattern), end + 1)):
                    seen.add(pattern)
        return sorted({tuple(x) for p in seen for x in self.entries[p]} | {tuple(x) for x in self.always})

    @staticmethod
    def _apart(text: str, low: int, high: int) -> bool:
        before = low > 0 and is_word(text[low - 1])
        after = high < len(text) and is_word(text[high])
        return before != is_word(text[low]) and after != is_word(text[high - 1])


def parts(table: DataFrame, key: str, *more: str) -> Iterator[list]:
    """Rows of ``table`` in parts of bounded size, each part with all rows of its keys."""
    rows = table.where(F.col(key).isNotNull()).select(key, *more)
    size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(key)), F.lit(0))).first()
    number = max(1, -(-size[0] // PART_ROWS), -(-size[1] // PART_BYTES))
    for k in range(number):
        yield rows.where(F.pmod(F.xxhash64(key), F.lit(number)) == k).collect()


def occurring(text: str | Column, lexicon: DataFrame, pattern: str, found: str, words: bool = False) -> Column:
    """Sorted, distinct array of (ord, value): ``found`` of all entries of the lexicon whose ``pattern`` occurs in the text.

    ``found`` is an array of (ord, value). A null text has none; an empty pattern occurs in every text, but is no word.
    """
    context = lexicon.sparkSession.sparkContext
    column = F.col(text) if isinstance(text, str) else text
    hits = []
    for rows in parts(lexicon, pattern, found):
        entries: dict[str, list] = {}
        for r in rows:
            entries.setdefault(r[pattern], []).extend((x["ord"], x["value"]) for x in r[found] or [])
        hits.append(_scanner(context.broadcast(entries), words)(column))
    return hits[0] if len(hits) == 1 else F.array_sort(F.array_distinct(F.concat(*hits)))


def _scanner(sent, words: bool):
    @F.pandas_udf(_FOUND)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = Automaton(sent.value, words)
        for texts in batches:
            yield pd.Series([[{"ord": o, "value": v} for o, v in machine.found(t)] for t in texts], dtype=object)

    return scan


def pair_values(found: Column, pairs: DataFrame) -> Column:
    """Sorted, distinct ``feature`` of every pair (w1, w2, feature) of which both words are in the array ``found``."""
    context = pairs.sparkSession.sparkContext
    hits = []
    for rows in parts(pairs, "w1", "w2", "feature"):
        by_first: dict[str, list] = {}
        for r in rows:
            by_first.setdefault(r["w1"], []).append((r["w2"], r["feature"]))
        hits.append(_joiner(context.broadcast(by_first))(found))
    return F.array_sort(F.array_distinct(F.concat(*hits)))


def _joiner(sent):
    @F.pandas_udf("array<string>")
    def join(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for arrays in batches:
            out = []
            for words in arrays:
                have = set(words if words is not None else [])
                out.append(sorted({f for w in have for other, f in sent.value.get(w, ()) if other in have and f is not None}))
            yield pd.Series(out, dtype=object)

    return join


ship_by_value(__name__)
