"""Column expressions for matching a bounded lexicon; the text must already be lower-case."""
from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidloom.bounds import string_array
from evidloom.fixed_values import (
    CONSTRAINT_PATTERNS, HIGH_SEVERITY_WORDS, LOW_SEVERITY_WORDS, SENTENCE_HIGH_WORDS, SENTENCE_LOW_WORDS,
)
from evidloom.functions.text import any_whole_word, quote, whole_word

#: terms that are tried as substrings one by one before their regex
FEW_TERMS = 8


def _keep(pairs: list[tuple[Column, str]]) -> Column:
    if not pairs:
        return string_array([])
    return F.array_compact(F.array(*[F.when(cond, F.lit(value)) for cond, value in pairs]))


def substring_terms(low: Column, terms: list[str], fold: bool = True) -> Column:
    """Terms that occur in the text, in list order; compared in lower case with ``fold``."""
    return _keep([(F.contains(low, F.lit(t.lower() if fold else t)), t) for t in terms])


def has_substring_term(low: Column, terms: list[str]) -> Column:
    """One alternation instead of one test per term, which keeps the generated code small."""
    return F.rlike(low, F.lit("|".join(quote(t.lower()) for t in terms))) if terms else F.lit(False)


def word_terms(low: Column, terms: list[str], fold: bool = False) -> Column:
    """Terms that occur as whole words, in list order; the cheap substring test runs before the regex."""
    pairs = [(t.lower() if fold else t, t) for t in terms]
    return _keep([(F.contains(low, F.lit(c)) & F.rlike(low, F.lit(whole_word(c))), t) for c, t in pairs])


def has_word_term(low: Column, terms: list[str]) -> Column:
    """One alternation; for a few terms the cheap substring tests run before it."""
    if not terms:
        return F.lit(False)
    found = F.rlike(low, F.lit(any_whole_word(terms)))
    return reduce(or_, [F.contains(low, F.lit(t)) for t in terms]) & found if len(terms) <= FEW_TERMS else found


def hint_class(low: Column, hints: list[tuple[str, list[str]]], default: str) -> Column:
    """Class with the most distinct hints in the text; the first class of the list wins a tie."""
    counts = []
    for _, words in hints:
        total = F.lit(0)
        for w in words:
            total = total + F.contains(low, F.lit(w)).cast("int")
        counts.append(total)
    best = F.greatest(*counts) if len(counts) > 1 else counts[0]
    out = F.when(best == 0, F.lit(default))
    for (name, _), count in zip(hints, counts):
        out = out.when(count == best, F.lit(name))
    return out


def severity_by_priority(low: Column, high: list[str] = SENTENCE_HIGH_WORDS,
                         low_words: list[str] = SENTENCE_LOW_WORDS) -> Column:
    """Whole-word severity cue; high beats low, medium when there is none."""
    return F.when(has_word_term(low, high), "high").when(has_word_term(low, low_words), "low").otherwise("medium")


def severity_by_last_cue(tokens: Column, high: list[str] = HIGH_SEVERITY_WORDS,
                         low_words: list[str] = LOW_SEVERITY_WORDS) -> Column:
    """Severity of the last cue word in token order."""
    last = F.try_element_at(F.filter(tokens, lambda w: w.isin(*high, *low_words)), F.lit(-1))
    return F.when(last.isin(*high), "high").when(last.isin(*low_words), "low").otherwise("medium")


def constraint_flags(low: Column, patterns: dict[str, str] = CONSTRAINT_PATTERNS) -> Column:
    """One flag per pattern, true when the pattern does not match."""
    return F.struct(*[(~F.rlike(low, F.lit(p))).alias(name) for name, p in patterns.items()])
