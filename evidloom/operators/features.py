"""Canonical features of free-text messages."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom import fixed_values as fv
from evidloom.bounds import HIT_ROWS, LITERAL_ROWS, broadcast_if_small, local_table, small_rows, sql_array, sql_text, string_array
from evidloom.functions import text as tx
from evidloom.functions.lexicon import severity_by_last_cue
from evidloom.operators.common import compute_once, first_by
from evidloom.operators.scanning import occurring, pair_values
from evidloom.operators.similar import similar_pairs


@dataclass
class IntakeLexicon:
    """Lexicon tables, of any size.

    ``vocab(ord, feature)``, ``phrases/keywords/conditions(entry, features)``, ``pairs(w1, w2, feature)``,
    ``lemmas(token, lemma)``, ``stop(token)``. Without lemmas, phrases match exact tokens. ``typo_scorer`` is
    ``indel`` or ``weighted``.
    """

    vocab: DataFrame
    phrases: DataFrame
    keywords: DataFrame
    pairs: DataFrame
    conditions: DataFrame
    lemmas: DataFrame
    stop: DataFrame
    fuzzy_cutoff: int = fv.FUZZY_WORD_CUTOFF
    typo_cutoff: int = fv.FUZZY_WORD_CUTOFF
    typo_scorer: str = "weighted"
    high_words: list[str] = field(default_factory=lambda: fv.HIGH_SEVERITY_WORDS)
    low_words: list[str] = field(default_factory=lambda: fv.LOW_SEVERITY_WORDS)
    literal_rows: int = LITERAL_ROWS
    hit_rows: int = HIT_ROWS


BETWEEN = "\x01"
_TEXT_COLUMNS = ["low", "words", "lemma_seq", "lemma_text", "haystack"]


def _collected(df: DataFrame, found: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Attach exploded values ``found(keys, value)`` to their rows as a sorted set."""
    sets = found.groupBy(*keys).agg(F.array_sort(F.collect_set("value")).alias("_set"))
    return df.join(sets, keys, "left").withColumn(out, F.coalesce("_set", string_array([]))).drop("_set")


def lemmatize(messages: DataFrame, keys: list[str], lex: IntakeLexicon, text: str = "text") -> DataFrame:
    """Add ``lemma_seq`` (all tokens) and ``lemma_text`` (alphabetic tokens that are not stop words) in token order.

    Of several lemmas of a token the first in sorted order counts.
    """
    table_of_lemmas = lex.lemmas.groupBy("token").agg(F.min("lemma").alias("lemma"))
    lemmas, stop = small_rows(table_of_lemmas, lex.literal_rows), small_rows(lex.stop.select("token").distinct(), lex.literal_rows)
    if lemmas is not None and stop is not None:
        table = F.create_map(*[x for r in lemmas for x in (F.lit(r.token), F.lit(r.lemma))]) if lemmas else None
        stops = string_array([r.token for r in stop])

        def lemma(t: Column) -> Column:
            return t if table is None else F.coalesce(F.try_element_at(table, t), t)

        toks = tx.tokens(F.col(text))
        content = F.filter(toks, lambda t: ~F.array_contains(stops, t) & F.rlike(t, F.lit(r"^\p{L}+$")))
        return compute_once(messages, lemma_seq=F.array_join(F.transform(toks, lemma), " "),
                            lemma_text=F.array_join(F.transform(content, lemma), " "))
    rows = messages.select(*keys, F.posexplode(tx.tokens(F.col(text))).alias("pos", "token"))
    rows = rows.join(broadcast_if_small(table_of_lemmas), "token", "left")
    rows = rows.join(broadcast_if_small(lex.stop.select("token", F.lit(True).alias("is_stop")).distinct()), "token", "left")
    used = F.coalesce("lemma", "token")
    content = F.when(F.col("is_stop").isNull() & F.rlike("token", F.lit(r"^\p{L}+$")), used)
    seqs = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct("pos", used.alias("lemma"), content.alias("content")))).alias("_toks"))
    joined = messages.join(seqs, keys, "left")
    texts = {
        "lemma_seq": F.array_join(F.transform("_toks", lambda s: s["lemma"]), " "),
        "lemma_text": F.array_join(F.transform("_toks", lambda s: s["content"]), " "),
    }
    return joined.withColumns({k: F.coalesce(v, F.lit("")) for k, v in texts.items()}).drop("_toks")


def prepare_messages(messages: DataFrame, keys: list[str], lex: IntakeLexicon, text: str = "text") -> DataFrame:
    """Add the forms of the text that the lexicon steps look at, each computed once."""
    rows = lemmatize(messages, keys, lex, text)
    low = F.lower(text)
    rows = compute_once(rows, low=low, words=tx.clean_words(F.col(text)),
                        haystack=F.concat("lemma_text", F.lit(BETWEEN), low))
    return rows.withColumn("lemma_seq", F.concat(F.lit(" "), "lemma_seq", F.lit(" ")))


def lexicon_features(df: DataFrame, keys: list[str], text: str, lexicon: DataFrame, out: str,
                     literal_rows: int = LITERAL_ROWS) -> DataFrame:
    """Add the features of every entry that is a substring of ``text``, sorted and distinct."""
    rows = small_rows(lexicon, literal_rows)
    if rows is not None:
        none = sql_array([])
        hits = [f"if(contains({text}, {sql_text(r.entry)}), {sql_array(list(r.features))}, {none})" for r in rows]
        found = f"concat({', '.join(hits)})" if hits else none
        return df.withColumn(out, F.expr(f"array_sort(array_distinct({found}))"))
    named = F.transform("features", lambda f: F.struct(F.lit(0).cast("long").alias("ord"), f.alias("value")))
    found = occurring(text, lexicon.select("entry", named.alias("found")), "entry", "found")
    return df.withColumn(out, F.transform(found, lambda x: x["value"]))


def phrase_features(df: DataFrame, keys: list[str], lex: IntakeLexicon) -> DataFrame:
    """Features of the phrases whose tokens occur in sequence (both sides as lemmas)."""
    phrases = lemmatize(lex.phrases.select(F.col("entry").alias("text"), "features"), ["text"], lex)
    padded = phrases.select(F.concat(F.lit(" "), "lemma_seq", F.lit(" ")).alias("entry"), "features")
    return lexicon_features(df, keys, "lemma_seq", padded, "phrase_features", lex.literal_rows)


def keyword_features(df: DataFrame, keys: list[str], lex: IntakeLexicon) -> DataFrame:
    return lexicon_features(df, keys, "haystack", lex.keywords, "keyword_features", lex.literal_rows)


def cooc_features(df: DataFrame, keys: list[str], lex: IntakeLexicon) -> DataFrame:
    """Features of the word pairs of which both words occur, in any order and at any distance."""
    rows = small_rows(lex.pairs, lex.literal_rows)
    out = "cooc_features"
    if rows is not None:
        hits = [f"if(contains(haystack, {sql_text(r.w1)}) AND contains(haystack, {sql_text(r.w2)}), "
                f"{sql_text(r.feature)}, null)" for r in rows]
        found = f"array_compact(array({', '.join(hits)}))" if hits else sql_array([])
        return df.withColumn(out, F.expr(f"array_sort(array_distinct({found}))"))
    words = lex.pairs.select(F.col("w1").alias("w")).union(lex.pairs.select("w2")).distinct()
    named = F.array(F.struct(F.lit(0).cast("long").alias("ord"), F.col("w").alias("value")))
    found = occurring("haystack", words.select("w", named.alias("found")), "w", "found")
    return df.withColumn(out, pair_values(F.transform(found, lambda x: x["value"]), lex.pairs))


def word_hits(df: DataFrame, keys: list[str], hits: DataFrame, out: str, hit_rows: int = HIT_ROWS) -> DataFrame:
    """Add the ``value`` of every ``hits(word, value)`` whose word is among ``words``, sorted and distinct.

    ``hits`` is a result over the distinct words, usually tiny: it is counted, and then tested as literals in place,
    so the messages are not shuffled. A larger one is joined on the exploded words.
    """
    rows = small_rows(hits, hit_rows)
    if rows is None:
        found = df.select(*keys, F.explode(F.array_distinct("words")).alias("word")).join(hits, "word")
        return _collected(df, found.select(*keys, "value"), keys, out)
    by_value: dict[str, list[str]] = {}
    for r in rows:
        by_value.setdefault(r.value, []).append(r.word)
    cases = [f"if(arrays_overlap(words, {sql_array(sorted(ws))}), {sql_text(v)}, null)" for v, ws in by_value.items()]
    found = f"array_compact(array({', '.join(cases)}))" if cases else sql_array([])
    return df.withColumn(out, F.expr(f"array_sort({found})"))


def distinct_words(df: DataFrame, min_chars: int) -> DataFrame:
    """Distinct words as column ``a``. They are few next to the messages but costly to score, so they are spread over
    all shuffle partitions instead of the few that their bytes alone would give."""
    words = df.select(F.explode(F.array_distinct("words")).alias("a")).where(F.length("a") >= min_chars).distinct()
    return words.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a")


def condition_hits(words: DataFrame, lex: IntakeLexicon) -> DataFrame:
    """``(word, value)``: features of the conditions to which a word is similar."""
    rows = small_rows(lex.conditions, lex.literal_rows)
    if rows is not None:
        named = [(r.entry, r.features) for r in rows if len(r.entry) >= fv.FUZZY_WORD_MIN_CHARS]
        fuzzy = local_table(words.sparkSession, named, "b string, features array<string>")
    else:
        fuzzy = lex.conditions.where(F.length("entry") >= fv.FUZZY_WORD_MIN_CHARS).select(
            F.col("entry").alias("b"), "features")
    pairs = similar_pairs(words, fuzzy, lex.fuzzy_cutoff, literal_rows=lex.literal_rows)
    return pairs.join(fuzzy, "b").select(F.col("a").alias("word"), F.explode("features").alias("value")).distinct()


def scored_words(df: DataFrame, lex: IntakeLexicon) -> tuple[DataFrame, DataFrame]:
    """Condition hits and typo hits of the distinct words, from one pass over the messages.

    Words are scored once each, whatever their frequency. The hits are counted and kept as local tables when few.
    """
    words = distinct_words(df, fv.FUZZY_WORD_MIN_CHARS)
    both = condition_hits(words, lex).withColumn("kind", F.lit("condition")).unionByName(
        typo_hits(words, lex).withColumn("kind", F.lit("typo")))
    rows = small_rows(both.select("word", "value", "kind"), lex.hit_rows)
    if rows is None:
        return tuple(both.where(F.col("kind") == k).drop("kind") for k in ("condition", "typo"))
    return tuple(
        local_table(df.sparkSession, [(r.word, r.value) for r in rows if r.kind == k], "word string, value string")
        for k in ("condition", "typo"))


def condition_features(df: DataFrame, keys: list[str], lex: IntakeLexicon, hits: DataFrame | None = None) -> DataFrame:
    """Features of the conditions that occur in the text, or to which a word of it is similar."""
    rows = lexicon_features(df, keys, "low", lex.conditions, "_exact", lex.literal_rows)
    if hits is None:
        hits = condition_hits(distinct_words(df, fv.FUZZY_WORD_MIN_CHARS), lex)
    rows = word_hits(rows, keys, hits, "_fuzzy", lex.hit_rows)
    return rows.withColumn("condition_features", F.array_sort(F.array_union("_exact", "_fuzzy"))).drop(
        "_exact", "_fuzzy")


def vocab_features(df: DataFrame, keys: list[str], lex: IntakeLexicon) -> DataFrame:
    """Vocabulary names that occur in the text as they are or with spaces."""
    rows = small_rows(lex.vocab, lex.literal_rows)
    if rows is not None:
        entries = [(e, [r.feature]) for r in rows for e in sorted({r.feature, r.feature.replace("_", " ")})]
        names = local_table(df.sparkSession, entries, "entry string, features array<string>")
        return lexicon_features(df, keys, "low", names, "vocab_features", 2 * lex.literal_rows)
    names = lex.vocab.select(
        F.explode(F.array_distinct(F.array("feature", F.replace("feature", F.lit("_"), F.lit(" "))))).alias("entry"),
        F.array("feature").alias("features"))
    return lexicon_features(df, keys, "low", names, "vocab_features", 2 * lex.literal_rows)


def typo_hits(words: DataFrame, lex: IntakeLexicon) -> DataFrame:
    """``(word, value)``: the most similar vocabulary name at or above the cutoff, else the most similar spaced one."""
    rows = small_rows(lex.vocab, lex.literal_rows)
    if rows is not None:
        both = [(r.ord, r.feature, i, b) for r in rows for i, b in enumerate((r.feature, r.feature.replace("_", " ")))]
        names = local_table(words.sparkSession, both, "ord int, feature string, spaced int, b string")
    else:
        names = lex.vocab.select("ord", "feature", F.posexplode(F.array(
            "feature", F.replace("feature", F.lit("_"), F.lit(" ")))).alias("spaced", "b"))
    pairs = similar_pairs(words, names, lex.typo_cutoff, lex.typo_scorer, 2 * lex.literal_rows)
    best = first_by(pairs.join(names, "b"), ["a"], [F.asc("spaced"), F.desc("score"), F.asc("ord")])
    return best.select(F.col("a").alias("word"), F.col("feature").alias("value"))


def typo_features(df: DataFrame, keys: list[str], lex: IntakeLexicon, found: str, hits: DataFrame) -> DataFrame:
    """Features of misspelt words, only for rows where no other step found anything (``found`` is empty)."""
    long = hits.where(F.length("word") >= fv.TYPO_WORD_MIN_CHARS)
    rows = word_hits(df, keys, long, "_typo", lex.hit_rows)
    return rows.withColumn("typo_features", F.when(F.size(found) == 0, F.col("_typo")).otherwise(
        string_array([]))).drop("_typo")


def keep_vocabulary(df: DataFrame, keys: list[str], column: str, lex: IntakeLexicon) -> DataFrame:
    rows = small_rows(lex.vocab, lex.hit_rows)
    if rows is not None:
        return df.withColumn(column, F.array_intersect(column, string_array([r.feature for r in rows])))
    known = df.select(*keys, F.explode(column).alias("feature")).join(
        broadcast_if_small(lex.vocab.select("feature").distinct()), "feature")
    return _collected(df.drop(column), known.select(*keys, F.col("feature").alias("value")), keys, column)


def extract_features(messages: DataFrame, keys: list[str], lex: IntakeLexicon, text: str = "text") -> DataFrame:
    """Add the sorted ``features`` of every message and its ``detected_severity``."""
    rows = prepare_messages(messages, keys, lex, text)
    words = messages.select(tx.clean_words(F.col(text)).alias("words"))
    if lex.typo_scorer == "indel":
        near, typos = scored_words(words, lex)
    else:
        near, typos = condition_hits(distinct_words(words, fv.FUZZY_WORD_MIN_CHARS), lex), None
    for step in (phrase_features, keyword_features, cooc_features, vocab_features):
        rows = step(rows, keys, lex)
    rows = condition_features(rows, keys, lex, near)
    parts = ["phrase_features", "keyword_features", "cooc_features", "condition_features", "vocab_features"]
    rows = compute_once(rows.drop("haystack", "lemma_seq", "lemma_text"),
                        _found=F.array_sort(F.array_distinct(F.concat(*parts)))).drop(*parts)
    if typos is None:  # A costly scorer sees only the words of the rows that need it.
        empty = rows.where(F.size("_found") == 0)
        typos = typo_hits(distinct_words(empty, fv.TYPO_WORD_MIN_CHARS), lex)
    rows = typo_features(rows, keys, lex, "_found", typos)
    rows = rows.withColumn("features", F.array_sort(F.array_union("_found", "typo_features")))
    rows = keep_vocabulary(rows, keys, "features", lex)
    return rows.withColumn(
        "detected_severity", severity_by_last_cue(tx.tokens(F.col(text)), lex.high_words, lex.low_words)
    ).drop("_found", "typo_features", "low", "words")
