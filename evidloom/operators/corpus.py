"""Corpus building: pages to gated documents, links, coverage and fallback documents."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom import fixed_values as fv
from evidloom.functions import text as tx
from evidloom.operators.common import compute_once, top_k
from evidloom.operators.matching import match_terms


def gate_corpus(docs: DataFrame, text: str = "text", min_chars: int = fv.MIN_TEXT_CHARS,
                max_chars: int = fv.MAX_TEXT_CHARS) -> DataFrame:
    """Drop short documents, cut long ones; ``chars`` keeps the length before the cut."""
    gated = docs.where(F.length(text) >= min_chars).withColumn("chars", F.length(text).cast("long"))
    return gated.withColumn(text, F.substring(text, 1, max_chars))


def corpus_from_pages(pages: DataFrame, min_chars: int = fv.MIN_TEXT_CHARS, max_chars: int = fv.MAX_TEXT_CHARS,
                      main_content: bool = False) -> DataFrame:
    """Pages ``(…, url, html)`` to corpus rows ``(…, url, domain, text, chars)``; pages without a body are dropped."""
    clean = tx.page_main_text if main_content else tx.html_to_text
    kept = [c for c in pages.columns if c != "html"]
    docs = compute_once(pages.where(F.col("html").isNotNull()), text=clean(F.col("html"))).select(*kept, "text")
    return gate_corpus(docs, "text", min_chars, max_chars).withColumn("domain", tx.url_authority(F.col("url")))


def priority_union(parts: list[DataFrame]) -> DataFrame:
    """Union of sources with ``prio`` by position, so that a sort by it gives the scan order."""
    tagged = [p.withColumn("prio", F.lit(i)) for i, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def corpus_union(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Base documents followed by extra ones; columns on one side only are NULL on the other."""
    return base.unionByName(extra, allowMissingColumns=True)


def page_links(pages: DataFrame, prefix: str, blocked: list[str], k: int, must_start: str = "") -> DataFrame:
    """First ``k`` link targets per page in document order: the part of the link between the prefix and ``&``."""
    hrefs = F.regexp_extract_all("html", F.lit(r'<a[^>]*href="([^"]*)"'), F.lit(1))
    under = F.filter(hrefs, lambda h: F.startswith(h, F.lit(prefix)))
    targets = F.transform(under, lambda h: F.substring_index(F.substring(h, len(prefix) + 1, 2147483647), "&", 1))

    def wanted(t: Column) -> Column:
        out = F.startswith(t, F.lit(must_start))
        for b in blocked:
            out = out & ~F.contains(t, F.lit(b))
        return out

    first = F.slice(F.filter(targets, wanted), 1, k)
    kept = [c for c in pages.columns if c != "html"]
    return pages.select(*kept, F.posexplode(first).alias("link_ord", "target"))


def sentences(docs: DataFrame, keys: list[str], text: str = "text",
              min_chars: int = fv.MIN_SENTENCE_CHARS) -> DataFrame:
    """One row per sentence longer than ``min_chars``, with its position and its lower-case form ``low``.

    White space is collapsed first. ``low`` is made next to the sentence, so that later filters do not redo it.
    """
    parts = F.transform(
        tx.split_sentences(tx.normalize_whitespace(F.col(text))),
        lambda s: F.named_struct(F.lit("sentence"), F.trim(s), F.lit("low"), F.lower(F.trim(s))),
    )
    out = docs.select(*keys, F.posexplode(parts).alias("sent_ord", "_s"))
    return out.select(*keys, "sent_ord", "_s.sentence", "_s.low").where(F.length("sentence") > min_chars)


def topic_coverage(docs: DataFrame, topics: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``(topic_ord, topic, covered)``: whether any document contains the topic, ignoring case."""
    lowered = compute_once(docs.select(*keys, text), _low=F.lower(text)).drop(text)
    hits = match_terms(lowered, keys, "_low", topics, "topic", "topic_ord", "substring", "found")
    seen = hits.select(F.explode("found").alias("topic")).distinct().withColumn("covered", F.lit(True))
    return topics.select("topic_ord", "topic").join(seen, "topic", "left").select(
        "topic_ord", "topic", F.coalesce("covered", F.lit(False)).alias("covered"))


def uncovered_topics(coverage: DataFrame) -> DataFrame:
    return coverage.where(~F.col("covered")).select("topic_ord", "topic")


def fallback_candidates(base: DataFrame, candidates: DataFrame, topics: DataFrame, base_keys: list[str],
                        per_topic: int = 5, min_chars: int = fv.MIN_TEXT_CHARS,
                        max_chars: int = fv.MAX_TEXT_CHARS) -> DataFrame:
    """Documents added for topics that the base corpus does not mention.

    Topics are taken in order. A topic is skipped when the base or a document added before mentions it; its first
    ``per_topic`` candidates are tried unless their URL was tried before; an accepted one passes the length gate.
    ``candidates`` has ``(topic_ord, rank, url, text)``, ``base`` has ``url`` and ``text`` and counts as it is: a corpus that
    passed ``gate_corpus``, so that what the gate drops neither mentions a topic nor holds a URL.

    The heavy parts (coverage of the base, top candidates, their URLs and mentions) are set-based. Only the decision
    in topic order is sequential; it folds at most ``per_topic`` small structs per topic, without their texts.
    """
    todo = uncovered_topics(topic_coverage(base, topics, base_keys))
    tried = top_k(candidates.join(todo, "topic_ord"), ["topic_ord"], ["rank"], per_topic)
    tried = tried.join(base.select("url").distinct(), "url", "left_anti")
    cut = F.substring("text", 1, max_chars)
    tried = tried.withColumn("ok", F.length("text") >= min_chars).withColumn("chars", F.length("text").cast("long"))
    tried = compute_once(tried.withColumn("text", cut), _low=F.lower("text"))
    tried = match_terms(tried, ["topic_ord", "rank"], "_low", topics, "topic", "topic_ord", "substring", "mentions")
    facts = tried.agg(F.array_sort(F.collect_list(F.struct("topic_ord", "rank", "url", "topic", "ok", "mentions")))
                      .alias("facts"))
    none = F.expr("cast(array() as array<string>)")
    start = F.struct(none.alias("urls"), none.alias("covered"), F.lit(-1).alias("open"), none.alias("taken"))

    def step(s: Column, c: Column) -> Column:
        # A topic stays open for all its candidates once its first one was reached while it was not covered.
        is_open = (s["open"] == c["topic_ord"]) | ~F.array_contains(s["covered"], c["topic"])
        fresh = is_open & ~F.array_contains(s["urls"], c["url"])
        added = fresh & c["ok"]
        key = F.concat_ws("|", c["topic_ord"], c["rank"])
        return F.named_struct(
            F.lit("urls"), F.when(fresh, F.array_append(s["urls"], c["url"])).otherwise(s["urls"]),
            F.lit("covered"), F.when(added, F.array_union(s["covered"], c["mentions"])).otherwise(s["covered"]),
            F.lit("open"), F.when(is_open, c["topic_ord"]).otherwise(s["open"]).cast("int"),
            F.lit("taken"), F.when(added, F.array_append(s["taken"], key)).otherwise(s["taken"]),
        )

    taken = facts.select(F.explode(F.aggregate("facts", start, step)["taken"]).alias("_key"))
    keyed = tried.withColumn("_key", F.concat_ws("|", "topic_ord", "rank"))
    return keyed.join(taken, "_key", "left_semi").select(
        "topic_ord", F.col("topic").alias("disease_hint"), "rank", "url", "text", "chars")


def corpus_totals(corpus: DataFrame) -> DataFrame:
    return corpus.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("chars"), F.lit(0)).alias("total_chars"))
