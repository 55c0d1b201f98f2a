"""Registered queries on pages and documents: corpus building, links, coverage, fallback."""
from __future__ import annotations

from pyspark.sql import functions as F

from evidloom import fixed_values as fv
from evidloom.functions import text as tx
from evidloom.operators import corpus
from evidloom.plans import fixtures as fx
from evidloom.plans.sql import lit, normalized, query
from evidloom.sources.tables import table, text_table

LINK_PREFIX = "/"
LINK_BLOCKED = ["que", "the"]
LINK_COUNT = 3


def _pages(spark, folder):
    return text_table(spark, folder, "pages", "page_id", "url", "html")


def html_to_text(spark, folder):
    return _pages(spark, folder).select("page_id", tx.html_to_text(F.col("html")).alias("text"))


def page_main_text(spark, folder):
    return _pages(spark, folder).select("page_id", tx.page_main_text(F.col("html")).alias("text"))


def url_authority(spark, folder):
    return table(spark, folder, "pages").select("page_id", tx.url_authority(F.col("url")).alias("domain"))


def corpus_from_pages(spark, folder):
    return corpus.corpus_from_pages(_pages(spark, folder))


def corpus_main_content(spark, folder):
    return corpus.corpus_from_pages(_pages(spark, folder), main_content=True)


def corpus_totals(spark, folder):
    return corpus.corpus_totals(corpus.corpus_from_pages(_pages(spark, folder)))


def page_links(spark, folder):
    return corpus.page_links(_pages(spark, folder), LINK_PREFIX, LINK_BLOCKED, LINK_COUNT).select(
        "page_id", "link_ord", "target")


def priority_union(spark, folder):
    """Documents by language group in priority order, gated."""
    docs = text_table(spark, folder, "documents", "doc_id", "text", "lang", "source")
    first = corpus.gate_corpus(docs.where(F.col("lang") == "en"))
    rest = corpus.gate_corpus(docs.where(F.col("lang") != "en")).withColumn("hint", F.col("lang"))
    return corpus.priority_union([first, rest]).select(
        "doc_id", "source", "hint", "chars", F.length("text").alias("kept"), "prio").orderBy("prio", "doc_id")


def topic_coverage(spark, folder):
    docs = text_table(spark, folder, "documents", "doc_id", "text")
    return corpus.topic_coverage(docs, fx.topics_table(spark), ["doc_id"])


def uncovered_topics(spark, folder):
    base = corpus.gate_corpus(fx.fallback_base(spark, folder))
    return corpus.uncovered_topics(corpus.topic_coverage(base, fx.topics_table(spark), ["doc_id"]))


def _fallback(spark, folder):
    return corpus.fallback_candidates(corpus.gate_corpus(fx.fallback_base(spark, folder)), fx.fallback_pool(spark, folder),
                                      fx.topics_table(spark), ["doc_id"])


def fallback_candidates(spark, folder):
    return _fallback(spark, folder).select(
        "topic_ord", "disease_hint", "rank", "url", "chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def corpus_union(spark, folder):
    base = corpus.gate_corpus(fx.fallback_base(spark, folder)).select("url", "text", "chars")
    extra = _fallback(spark, folder).select("url", "text", "chars", "disease_hint")
    return corpus.corpus_union(base, extra).select(
        "url", "chars", "disease_hint", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_NAMED = "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in tx.NAMED.items()) + "}"
_CODE = "(CASE WHEN starts_with(lower(e), '&#x') THEN '0x' || substr(e, 4, length(e) - 4) ELSE substr(e, 3, length(e) - 3) END)::INT"
_CHAR = (f"CASE WHEN starts_with(e, '&#') THEN CASE WHEN {_CODE} BETWEEN 1 AND 1114111 AND {_CODE} NOT BETWEEN 55296 AND 57343 THEN "
         f"chr({_CODE}) ELSE chr(65533) END ELSE coalesce({_NAMED}[e], e) END")


def _html_text(html: str) -> str:
    out = f"regexp_replace({html}, {lit(tx.dropped_parts())}, ' ', 'g')"
    out = f"regexp_replace({out}, '(?s)<[^>]*>', ' ', 'g')"
    chars = f"list_transform(regexp_extract_all({out}, {lit(tx.REFERENCE)}), lambda e: {_CHAR})"
    pieces = f"list_zip(string_split_regex({out}, {lit(tx.REFERENCE)}), {chars})"
    return normalized(f"array_to_string(list_transform({pieces}, lambda z: z[1] || coalesce(z[2], '')), '')")


_NO_TABLES = "regexp_replace(html, '(?is)<table(\\s[^>]*)?>.*?</table\\s*>', ' ', 'g')"
_MAIN_TEXT = "coalesce(" + ", ".join(
    f"nullif({_html_text(f'regexp_extract({_NO_TABLES}, {lit(f"(?is)<{t}(?:{chr(92)}s[^>]*)?>(.*)</{t}{chr(92)}s*>")}, 1)')}, '')"
    for t in ("article", "main")) + f", {_html_text('html')})"
_DOMAIN = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)"


def _gated(text: str) -> list[tuple[str, str]]:
    return [
        ("cleaned", f"SELECT page_id, url, {text} AS t FROM pages"),
        ("corpus", f"SELECT page_id, url, {_DOMAIN} AS domain, substr(t, 1, {fv.MAX_TEXT_CHARS}) AS text, "
                   f"length(t) AS chars FROM cleaned WHERE length(t) >= {fv.MIN_TEXT_CHARS}"),
    ]


def _covers(topic: str, source: str) -> str:
    return f"EXISTS (SELECT 1 FROM {source} WHERE contains(lower(text), {lit(topic)}))"


def _fallback_ctes() -> list[tuple[str, str]]:
    """One step per topic: candidates of an uncovered topic whose URL no earlier step tried."""
    case = "CASE lang " + " ".join(f"WHEN {lit(k)} THEN {fx.TOPICS.index(t)}"
                                   for k, t in fx.CANDIDATE_TOPICS.items()) + " END"
    ctes = [
        ("base", f"SELECT doc_id, substr(text, 1, {fv.MAX_TEXT_CHARS}) AS text, length(text) AS full_chars, CASE WHEN doc_id % 40 = "
                 f"0 THEN source ELSE 'base/' || source END AS url FROM documents WHERE lang = 'en' AND length(text) >= {fv.MIN_TEXT_CHARS}"),
        ("pool", f"SELECT {case} AS topic_ord, doc_id AS rank, source AS url, text FROM documents"),
        ("first_five", "SELECT * FROM pool WHERE topic_ord IS NOT NULL "
                       "QUALIFY row_number() OVER (PARTITION BY topic_ord ORDER BY rank) <= 5"),
        ("start", "SELECT topic_ord, '' AS disease_hint, rank, url, text, 0::BIGINT AS chars FROM pool WHERE false"),
    ]
    steps = ["start"]
    for i, topic in enumerate(fx.TOPICS):
        before = " UNION ALL ".join(f"SELECT * FROM {s}" for s in steps)
        ctes.append((f"before_{i}", before))
        ctes.append((f"step_{i}", (
            f"SELECT topic_ord, {lit(topic)} AS disease_hint, rank, url, substr(text, 1, {fv.MAX_TEXT_CHARS}) AS text, "
            f"length(text) AS chars FROM first_five WHERE topic_ord = {i} AND NOT {_covers(topic, 'base')} "
            f"AND NOT EXISTS (SELECT 1 FROM before_{i} b WHERE b.chars >= {fv.MIN_TEXT_CHARS} AND "
            f"contains(lower(b.text), {lit(topic)})) AND url NOT IN (SELECT url FROM base) "
            f"AND url NOT IN (SELECT url FROM before_{i}) "
            "QUALIFY row_number() OVER (PARTITION BY url ORDER BY rank) = 1")))
        steps.append(f"step_{i}")
    ctes.append(("tried", " UNION ALL ".join(f"SELECT * FROM {s}" for s in steps)))
    ctes.append(("added", f"SELECT * FROM tried WHERE chars >= {fv.MIN_TEXT_CHARS}"))
    return ctes


_COVER_ROWS = " UNION ALL ".join(
    f"SELECT {i} AS topic_ord, {lit(t)} AS topic, coalesce(bool_or(contains(lower(text), {lit(t)})), false) AS covered "
    "FROM {source}" for i, t in enumerate(fx.TOPICS))
_HREFS = "regexp_extract_all(html, '<a[^>]*href=\"([^\"]*)\"', 1)"
_TARGETS = (f"list_transform(list_filter({_HREFS}, lambda h: starts_with(h, {lit(LINK_PREFIX)})), "
            f"lambda h: split_part(substr(h, {len(LINK_PREFIX) + 1}), '&', 1))")
_WANTED = (f"list_filter({_TARGETS}, lambda t: " + " AND ".join(f"NOT contains(t, {lit(b)})" for b in LINK_BLOCKED)
           + f")[1:{LINK_COUNT}]")

QUERIES = {
    "html_to_text": html_to_text,
    "page_main_text": page_main_text,
    "url_authority": url_authority,
    "corpus_from_pages": corpus_from_pages,
    "corpus_main_content": corpus_main_content,
    "corpus_totals": corpus_totals,
    "page_links": page_links,
    "priority_union": priority_union,
    "topic_coverage": topic_coverage,
    "uncovered_topics": uncovered_topics,
    "fallback_candidates": fallback_candidates,
    "corpus_union": corpus_union,
}
ORACLE = {
    "html_to_text": f"SELECT page_id, {_html_text('html')} AS text FROM pages",
    "page_main_text": f"SELECT page_id, {_MAIN_TEXT} AS text FROM pages",
    "url_authority": f"SELECT page_id, {_DOMAIN} AS domain FROM pages",
    "corpus_from_pages": query(_gated(_html_text("html")), "SELECT page_id, url, domain, text, chars FROM corpus"),
    "corpus_main_content": query(_gated(_MAIN_TEXT), "SELECT page_id, url, domain, text, chars FROM corpus"),
    "corpus_totals": query(_gated(_html_text("html")),
                           "SELECT count(*) AS docs, coalesce(sum(chars), 0) AS total_chars FROM corpus"),
    "page_links": query(
        [("found", f"SELECT page_id, {_WANTED} AS t FROM pages")],
        "SELECT page_id, generate_subscripts(t, 1) - 1 AS link_ord, unnest(t) AS target FROM found"),
    "priority_union": (
        "SELECT doc_id, source, CASE WHEN lang <> 'en' THEN lang END AS hint, length(text) AS chars, "
        f"least(length(text), {fv.MAX_TEXT_CHARS}) AS kept, (lang <> 'en')::INT AS prio FROM documents "
        f"WHERE length(text) >= {fv.MIN_TEXT_CHARS} ORDER BY prio, doc_id"),
    "topic_coverage": _COVER_ROWS.format(source="documents"),
    "uncovered_topics": query([("base", f"SELECT substr(text, 1, {fv.MAX_TEXT_CHARS}) AS text FROM documents WHERE lang = 'en' AND length(text) >= "
                                        f"{fv.MIN_TEXT_CHARS}"),
                               ("cover", _COVER_ROWS.format(source="base"))],
                              "SELECT topic_ord, topic FROM cover WHERE NOT covered"),
    "fallback_candidates": query(_fallback_ctes(), "SELECT topic_ord, disease_hint, rank, url, chars, md5(text) AS "
                                                   "text_md5 FROM added"),
    "corpus_union": query(
        _fallback_ctes(),
        "SELECT url, full_chars AS chars, NULL AS disease_hint, "
        f"md5(substr(text, 1, {fv.MAX_TEXT_CHARS})) AS text_md5 FROM base WHERE length(text) >= {fv.MIN_TEXT_CHARS} "
        "UNION ALL SELECT url, chars, disease_hint, md5(text) FROM added"),
}
