"""Evidence extraction: sentences to relation rows of topics and terms."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidloom import fixed_values as fv
from evidloom.bounds import LITERAL_ROWS, small_rows, string_array
from evidloom.functions import lexicon as lx
from evidloom.functions.scalars import confidence
from evidloom.operators.matching import match_terms


@dataclass
class EvidenceLexicon:
    """Inputs of the extraction. ``topics(topic_ord, topic)`` and ``terms(term_ord, term)`` are tables of any size."""

    topics: DataFrame
    terms: DataFrame
    class_hints: list[tuple[str, list[str]]]
    default_class: str = fv.DEFAULT_CLASS
    high_words: list[str] = field(default_factory=lambda: fv.SENTENCE_HIGH_WORDS)
    low_words: list[str] = field(default_factory=lambda: fv.SENTENCE_LOW_WORDS)
    constraints: dict[str, str] = field(default_factory=lambda: fv.CONSTRAINT_PATTERNS)


def filter_entities(entities: DataFrame, keys: list[str], min_score: float = fv.ENTITY_MIN_SCORE,
                    min_chars: int = fv.ENTITY_MIN_CHARS) -> DataFrame:
    """Entity rows ``(keys, word, score)`` to one sorted term array per sentence: sure, long enough, ASCII words.

    The score is tested last, since it may be an expression, and the regex only for words with longer characters.
    """
    word = F.lower(F.trim("word"))
    ascii_only = (F.octet_length(word) == F.length(word)) | F.rlike(word, F.lit(r"^[\x00-\x7F]*$"))
    kept = entities.where((F.length(word) >= min_chars) & ascii_only & (F.col("score") >= min_score))
    return kept.groupBy(*keys).agg(F.array_sort(F.collect_set(word)).alias("entity_terms"))


def extractions(sents: DataFrame, lexicon: EvidenceLexicon, keys: list[str], entities: DataFrame | None = None) -> DataFrame:
    """Relation rows: sentences (rows of ``corpus.sentences``) with at least one topic and one term.

    ``entities`` may bring further terms per sentence (output of ``filter_entities``). With bounded lexicons two cheap
    filters run first and the arrays are built only for the sentences that pass.
    """
    low = F.col("low")
    rows = sents
    topics = small_rows(lexicon.topics, LITERAL_ROWS)
    if topics is not None:
        rows = rows.where(lx.has_substring_term(low, [r.topic for r in topics]))
    terms = None
    if entities is None:
        terms = small_rows(lexicon.terms, LITERAL_ROWS)
        if terms is not None:
            rows = rows.where(lx.has_word_term(low, [r.term for r in terms]))
    rows = match_terms(rows, keys, "low", lexicon.topics, "topic", "topic_ord", "substring", "topics")
    if topics is None:
        rows = rows.where(F.size("topics") > 0)
    rows = match_terms(rows, keys, "low", lexicon.terms, "term", "term_ord", "word", "terms")
    if entities is not None:
        rows = rows.join(entities, keys, "left").withColumn(
            "terms", F.array_union("terms", F.coalesce("entity_terms", string_array([])))).drop("entity_terms")
    rows = rows.withColumn("terms", F.array_sort(F.array_distinct("terms")))
    if entities is not None or terms is None:
        rows = rows.where(F.size("terms") > 0)
    return (
        rows.withColumn("class", lx.hint_class(low, lexicon.class_hints, lexicon.default_class))
        .withColumn("severity", lx.severity_by_priority(low, lexicon.high_words, lexicon.low_words))
        .withColumn("constraints", lx.constraint_flags(low, lexicon.constraints))
        .withColumn("confidence_score", confidence(F.col("terms")))
    )
