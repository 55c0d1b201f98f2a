"""Registered queries on documents: text preparation, evidence, profile and knowledge base."""
from __future__ import annotations

from pyspark.sql import functions as F

from evidloom import fixed_values as fv
from evidloom.functions import lexicon as lx
from evidloom.functions import scalars as sc
from evidloom.functions import text as tx
from evidloom.operators import evidence, profile
from evidloom.operators.evidence import filter_entities
from evidloom.operators.matching import match_terms
from evidloom.plans import fixtures as fx
from evidloom.plans.sql import has_word, lit, normalized, query, sentence_array, values
from evidloom.session import stored
from evidloom.sources.tables import text_table


def topic_profile(spark, folder):
    return fx.document_profile(spark, folder).select(
        "topic_ord", "topic", "medicine_name", "formulation_type", F.array_join("top_terms", ",").alias("top_terms"),
        "class", "source", "confidence_score", "constraints.*", "evidence_count")


SENTENCES = [
    ("split_docs", f"SELECT doc_id, source, {sentence_array('text')} AS parts FROM documents"),
    ("numbered", "SELECT doc_id, source, generate_subscripts(parts, 1) - 1 AS sent_ord, unnest(parts) AS raw "
                 "FROM split_docs"),
    ("sents", f"SELECT doc_id, source, sent_ord, trim(raw) AS sentence, lower(trim(raw)) AS low FROM numbered "
              f"WHERE length(trim(raw)) > {fv.MIN_SENTENCE_CHARS}"),
]


def _filtered(items: list[str], conditions: list[str]) -> str:
    cases = ", ".join(f"CASE WHEN {c} THEN {lit(i)} END" for i, c in zip(items, conditions))
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


TOPIC_LIST = _filtered(fx.TOPICS, [f"contains(low, {lit(t)})" for t in fx.TOPICS])
TERM_LIST = _filtered(fx.TERMS, [has_word("low", t) for t in fx.TERMS])
_COUNTS = [" + ".join(f"contains(low, {lit(h)})::INT" for h in hints) for _, hints in fx.CLASS_HINTS]
_BEST = f"greatest({', '.join(_COUNTS)})"
CLASS_CASE = (f"CASE WHEN {_BEST} = 0 THEN {lit(fx.DEFAULT_CLASS)} "
              + " ".join(f"WHEN {c} = {_BEST} THEN {lit(n)}" for (n, _), c in zip(fx.CLASS_HINTS, _COUNTS)) + " END")
SEVERITY_CASE = (f"CASE WHEN {' OR '.join(has_word('low', w) for w in fx.HIGH_WORDS)} THEN 'high' "
                 f"WHEN {' OR '.join(has_word('low', w) for w in fx.LOW_WORDS)} THEN 'low' ELSE 'medium' END")
FLAGS = ", ".join(f"NOT regexp_matches(low, {lit(p)}) AS {n}" for n, p in fx.CONSTRAINTS.items())

EVIDENCE = SENTENCES + [
    ("found", f"SELECT *, {TOPIC_LIST} AS topics, list_sort({TERM_LIST}) AS terms FROM sents"),
    ("ext", f"SELECT *, {CLASS_CASE} AS class, {SEVERITY_CASE} AS severity, {FLAGS}, "
            f"round(least({fv.CONFIDENCE_TOP}, {fv.CONFIDENCE_BASE} + {fv.CONFIDENCE_STEP} * len(terms)), 3) "
            "AS confidence_score FROM found WHERE len(topics) > 0 AND len(terms) > 0"),
    ("topic_list", values(list(enumerate(fx.TOPICS)), "topic_ord", "topic")),
    ("by_topic", "SELECT *, unnest(topics) AS topic FROM ext"),
]

PROFILE = EVIDENCE + [
    ("term_rows", "SELECT topic, doc_id, sent_ord, unnest(terms) AS term FROM by_topic"),
    ("term_counts", "SELECT topic, term, count(*) AS n, min((doc_id, sent_ord)) AS seen FROM term_rows GROUP BY 1, 2"),
    ("ranked_terms", "SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, seen, term) AS rank "
                     "FROM term_counts"),
    ("lists", f"SELECT topic, list(term ORDER BY rank) AS top_terms FROM ranked_terms WHERE rank <= {fv.TOP_TERMS} "
              "GROUP BY 1"),
    ("source_counts", "SELECT topic, source, count(*) AS n, min((doc_id, sent_ord)) AS seen FROM by_topic GROUP BY 1, 2"),
    ("sources", "SELECT topic, source FROM source_counts "
                "QUALIFY row_number() OVER (PARTITION BY topic ORDER BY n DESC, seen) = 1"),
    ("class_counts", "SELECT topic, class, count(*) AS n, min((doc_id, sent_ord)) AS seen FROM by_topic GROUP BY 1, 2"),
    ("classes", "SELECT topic, class FROM class_counts "
                "QUALIFY row_number() OVER (PARTITION BY topic ORDER BY n DESC, seen) = 1"),
    ("totals", "SELECT topic, count(*) AS evidence_count, "
               "(sum(confidence_score::DECIMAL(20,6)) / count(*))::DOUBLE AS avg_conf, "
               "bool_and(child_safe) AS child_safe, bool_and(elderly_safe) AS elderly_safe, "
               "bool_and(pregnant_safe) AS pregnant_safe FROM by_topic GROUP BY 1"),
    ("joined", f"SELECT t.topic_ord, t.topic, coalesce(l.top_terms, {fv.DEFAULT_TERMS}) AS top_terms, "
               f"coalesce(c.class, {lit(fx.DEFAULT_CLASS)}) AS class, coalesce(s.source, {lit(fv.DEFAULT_SOURCE)}) "
               "AS source, round(coalesce(a.avg_conf, 0.0), 3) AS confidence_score, "
               "coalesce(a.child_safe, true) AS child_safe, coalesce(a.elderly_safe, true) AS elderly_safe, "
               "coalesce(a.pregnant_safe, true) AS pregnant_safe, coalesce(a.evidence_count, 0) AS evidence_count "
               "FROM topic_list t LEFT JOIN lists l USING (topic) LEFT JOIN sources s USING (topic) "
               "LEFT JOIN classes c USING (topic) LEFT JOIN totals a USING (topic)"),
    ("profile", "SELECT *, topic || ' Protocol' AS medicine_name, CASE WHEN len(top_terms) >= 5 THEN 'kwatha' "
                "WHEN len(top_terms) >= 3 THEN 'churna' ELSE 'vati' END AS formulation_type FROM joined"),
]


def normalize_whitespace(spark, folder):
    docs = text_table(spark, folder, "documents", "doc_id", "text")
    return docs.select("doc_id", tx.normalize_whitespace(F.col("text")).alias("text"))


def sentences(spark, folder):
    return fx.document_sentences(spark, folder).select("doc_id", "sent_ord", "sentence")


def contains_any(spark, folder):
    docs = text_table(spark, folder, "documents", "doc_id", "text")
    return docs.select("doc_id", tx.contains_any(F.col("text"), fx.TERMS).alias("hit"))


def clean_words(spark, folder):
    docs = text_table(spark, folder, "documents", "doc_id", "text")
    return docs.select("doc_id", F.array_join(tx.clean_words(F.col("text")), "|").alias("words"))


def topic_mentions(spark, folder):
    sents = fx.document_sentences(spark, folder)
    hits = match_terms(sents, ["doc_id", "sent_ord"], "low", fx.topics_table(spark), "topic", "topic_ord",
                       "substring", "topics")
    return hits.select("doc_id", "sent_ord", F.array_join("topics", ",").alias("topics"))


def term_mentions(spark, folder):
    sents = fx.document_sentences(spark, folder)
    hits = match_terms(sents, ["doc_id", "sent_ord"], "low", fx.evidence_lexicon(spark).terms, "term", "term_ord",
                       "word", "terms")
    return hits.select("doc_id", "sent_ord", F.array_join("terms", ",").alias("terms"))


def _shown(ext):
    return ext.select(
        "doc_id", "sent_ord", "source", "sentence", F.array_join("topics", ",").alias("topics"),
        F.array_join("terms", ",").alias("terms"), "class", "severity", "constraints.*", "confidence_score")


def extractions(spark, folder):
    return _shown(fx.document_evidence(spark, folder))


def entity_filter(spark, folder):
    entities = fx.sentence_entities(fx.document_sentences(spark, folder))
    return filter_entities(entities, ["doc_id", "sent_ord"]).select(
        "doc_id", "sent_ord", F.array_join("entity_terms", ",").alias("entity_terms"))


def extractions_with_entities(spark, folder):
    """Sentences are split once and stored, for the matching and for the entities."""
    sents = stored(fx.document_sentences(spark, folder, "source").drop("low"), "sentences")
    sents = sents.withColumn("low", F.lower("sentence")).withColumn("doc_ord", F.col("doc_id"))
    lexicon, keys = fx.evidence_lexicon(spark), ["doc_id", "sent_ord"]
    found = filter_entities(fx.sentence_entities(sents.select(*keys, "low")), keys)
    return _shown(evidence.extractions(sents, lexicon, keys, found))


def severity_priority(spark, folder):
    sents = fx.document_sentences(spark, folder)
    return sents.select("doc_id", "sent_ord", lx.severity_by_priority(F.col("low"), fx.HIGH_WORDS, fx.LOW_WORDS)
                        .alias("severity"))


def hint_class(spark, folder):
    sents = fx.document_sentences(spark, folder)
    return sents.select("doc_id", "sent_ord", lx.hint_class(F.col("low"), fx.CLASS_HINTS, fx.DEFAULT_CLASS)
                        .alias("class"))


def constraint_flags(spark, folder):
    sents = fx.document_sentences(spark, folder)
    return sents.select("doc_id", "sent_ord", lx.constraint_flags(F.col("low"), fx.CONSTRAINTS).alias("c")).select(
        "doc_id", "sent_ord", "c.*")


def top_terms(spark, folder):
    return profile.top_terms(fx.document_evidence(spark, folder))


def topic_modes(spark, folder):
    return profile.topic_modes(fx.document_evidence(spark, folder))


def kb_flat(spark, folder):
    return fx.document_kb(spark, folder).select(
        "topic_ord", "topic", "combo_ord", "age_group", "gender", "severity", "medicine_name",
        F.array_join("top_terms", ",").alias("top_terms"), "formulation_type", "class", "dosage",
        F.array_join("contraindications", ";").alias("contraindications"), "source", "confidence_score",
        "evidence_count")


def kb_nested(spark, folder):
    nested = profile.kb_nested(fx.document_kb(spark, folder))
    entry = F.transform(F.array_sort(F.map_entries("buckets")), lambda e: F.concat_ws(
        "=", e["key"], F.array_join(F.transform(e["value"], lambda r: F.concat_ws("/", r["medicine_name"],
                                                                                  r["dosage"])), ",")))
    return nested.select("topic_ord", "topic", F.array_join(entry, "|").alias("buckets"))


def kb_quality(spark, folder):
    report = profile.kb_quality(fx.document_kb(spark, folder))
    return report.withColumn("zero_evidence_examples", F.array_join("zero_evidence_examples", "|"))


def remedy_rules(spark, folder):
    rules = profile.remedy_rules(fx.document_profile(spark, folder))
    lists = ["herb_sanskrit", "allowed_ages", "allowed_genders", "allowed_severities"]
    return rules.withColumns({c: F.array_join(c, ",") for c in lists})


def remedy_name(spark, folder):
    rows = fx.document_profile(spark, folder).select(
        "topic", "top_terms", F.explode(F.array("medicine_name", "source")).alias("medicine_name"))
    return rows.select("topic", "medicine_name", sc.remedy_name(F.col("medicine_name"), F.col("top_terms"))
                       .alias("remedy"))


KB = PROFILE + [
    ("combos", values([(i, a, g, s) for i, (a, g, s) in enumerate(profile.PatientDims().combos())],
                      "combo_ord", "age_group", "gender", "severity")),
    ("kb", "SELECT p.*, c.*, (CASE WHEN age_group = 'young' AND NOT child_safe THEN "
           f"{lit(fv.DOSAGE_YOUNG_PREFIX)} WHEN age_group = 'elder' THEN {lit(fv.DOSAGE_ELDER_PREFIX)} ELSE '' END) || "
           f"(CASE c.severity WHEN 'high' THEN {lit(fv.DOSAGE_HIGH)} WHEN 'low' THEN {lit(fv.DOSAGE_LOW)} ELSE "
           f"{lit(fv.DOSAGE_STANDARD)} END) AS dosage, "
           f"list_filter([CASE WHEN NOT child_safe THEN {lit(fv.CONTRAINDICATION_CHILD)} END, "
           f"CASE WHEN NOT elderly_safe THEN {lit(fv.CONTRAINDICATION_ELDER)} END, "
           f"CASE WHEN NOT pregnant_safe THEN {lit(fv.CONTRAINDICATION_PREGNANT)} END], lambda x: x IS NOT NULL) "
           "AS contraindications FROM profile p CROSS JOIN combos c"),
]
ENTITIES = [
    ("words", "SELECT doc_id, sent_ord, trim(unnest(string_split(low, ' '))) AS word FROM sents"),
    ("entity_words", "SELECT doc_id, sent_ord, word FROM words WHERE "
                     "(('0x' || substr(md5(word), 1, 6))::BIGINT % 100) / 100.0 >= 0.65 AND length(word) >= 3 "
                     "AND regexp_matches(word, '^[\\x00-\\x7F]*$')"),
    ("entities", "SELECT doc_id, sent_ord, list_sort(list_distinct(list(word))) AS entity_terms FROM entity_words "
                 "GROUP BY 1, 2"),
]
EVIDENCE_ENTITIES = SENTENCES + ENTITIES + [
    ("found", f"SELECT s.*, {TOPIC_LIST} AS topics, list_sort(list_distinct(list_concat({TERM_LIST}, "
              "coalesce(e.entity_terms, []::VARCHAR[])))) AS terms FROM sents s LEFT JOIN entities e "
              "USING (doc_id, sent_ord)"),
    EVIDENCE[4],
]
_SHOWN = ("SELECT doc_id, sent_ord, source, sentence, array_to_string(topics, ',') AS topics, "
          "array_to_string(terms, ',') AS terms, class, severity, child_safe, elderly_safe, pregnant_safe, "
          "confidence_score FROM ext")
_EXAMPLES = ("coalesce((SELECT string_agg(e, '|' ORDER BY topic_ord, combo_ord) FROM (SELECT topic_ord, combo_ord, "
             "topic || ':' || age_group || '_' || gender || '_' || severity AS e FROM kb WHERE evidence_count = 0 "
             f"ORDER BY topic_ord, combo_ord LIMIT {fv.QUALITY_EXAMPLES})), '')")
TITLED = ("list_transform(list_filter(top_terms, lambda t: NOT regexp_matches(t, '[0-9]') AND NOT contains(t, 'days') "
           "AND NOT contains(t, 'times') AND length(t) > 2), lambda t: upper(t[1]) || lower(t[2:]))")

QUERIES = {
    "topic_profile": topic_profile,
    "normalize_whitespace": normalize_whitespace,
    "sentences": sentences,
    "contains_any": contains_any,
    "clean_words": clean_words,
    "topic_mentions": topic_mentions,
    "term_mentions": term_mentions,
    "extractions": extractions,
    "entity_filter": entity_filter,
    "extractions_with_entities": extractions_with_entities,
    "severity_priority": severity_priority,
    "hint_class": hint_class,
    "constraint_flags": constraint_flags,
    "top_terms": top_terms,
    "topic_modes": topic_modes,
    "kb_flat": kb_flat,
    "kb_nested": kb_nested,
    "kb_quality": kb_quality,
    "remedy_rules": remedy_rules,
    "remedy_name": remedy_name,
}
ORACLE = {
    "topic_profile": query(
        PROFILE,
        "SELECT topic_ord, topic, medicine_name, formulation_type, array_to_string(top_terms, ',') AS top_terms, "
        "class, source, confidence_score, child_safe, elderly_safe, pregnant_safe, evidence_count FROM profile"),
    "normalize_whitespace": f"SELECT doc_id, {normalized('text')} AS text FROM documents",
    "sentences": query(SENTENCES, "SELECT doc_id, sent_ord, sentence FROM sents"),
    "contains_any": "SELECT doc_id, " + " OR ".join(f"contains(lower(text), {lit(t)})" for t in fx.TERMS)
                    + " AS hit FROM documents",
    "clean_words": "SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(translate(lower(text), '.,', ''), "
                   f"{lit(tx.SPACE + '+')}), lambda w: w <> ''), '|') AS words FROM documents",
    "topic_mentions": query(SENTENCES, f"SELECT doc_id, sent_ord, array_to_string({TOPIC_LIST}, ',') AS topics "
                                       "FROM sents"),
    "term_mentions": query(SENTENCES, f"SELECT doc_id, sent_ord, array_to_string({TERM_LIST}, ',') AS terms "
                                      "FROM sents"),
    "extractions": query(EVIDENCE, _SHOWN),
    "entity_filter": query(SENTENCES + ENTITIES, "SELECT doc_id, sent_ord, array_to_string(entity_terms, ',') AS "
                                                 "entity_terms FROM entities"),
    "extractions_with_entities": query(EVIDENCE_ENTITIES, _SHOWN),
    "severity_priority": query(SENTENCES, f"SELECT doc_id, sent_ord, {SEVERITY_CASE} AS severity FROM sents"),
    "hint_class": query(SENTENCES, f"SELECT doc_id, sent_ord, {CLASS_CASE} AS class FROM sents"),
    "constraint_flags": query(SENTENCES, f"SELECT doc_id, sent_ord, {FLAGS} FROM sents"),
    "top_terms": query(PROFILE, "SELECT topic, rank, term, n FROM ranked_terms WHERE rank <= 6"),
    "topic_modes": query(PROFILE, "SELECT topic, source, class FROM sources JOIN classes USING (topic)"),
    "kb_flat": query(
        KB, "SELECT topic_ord, topic, combo_ord, age_group, gender, severity, medicine_name, "
            "array_to_string(top_terms, ',') AS top_terms, formulation_type, class, dosage, "
            "array_to_string(contraindications, ';') AS contraindications, source, confidence_score, evidence_count "
            "FROM kb"),
    "kb_nested": query(
        KB, "SELECT topic_ord, topic, string_agg(age_group || '_' || gender || '_' || severity || '=' || "
            "medicine_name || '/' || dosage, '|' ORDER BY age_group || '_' || gender || '_' || severity) AS buckets "
            "FROM kb GROUP BY 1, 2"),
    "kb_quality": query(
        KB, "SELECT count(DISTINCT topic) AS topic_count, count(DISTINCT topic) * 18 AS total_combos_expected, "
            "count(*) AS total_records, count(*) FILTER (evidence_count = 0) AS zero_evidence_combos, "
            f"{_EXAMPLES} AS zero_evidence_examples FROM kb"),
    "remedy_rules": query(
        PROFILE, "SELECT topic_ord, topic, medicine_name, formulation_type, array_to_string(top_terms, ',') AS "
                 f"herb_sanskrit, class AS dosha_type, {lit(fv.DOSAGE_STANDARD)} AS dosage, 'all' AS allowed_ages, "
                 "'all' AS allowed_genders, 'low,medium,high' AS allowed_severities, child_safe, elderly_safe, "
                 "pregnant_safe FROM profile"),
    "remedy_name": query(
        PROFILE + [("named", "SELECT topic, medicine_name, top_terms FROM profile UNION ALL "
                             "SELECT topic, source, top_terms FROM profile"),
                   ("titled", f"SELECT topic, medicine_name, {TITLED} AS t FROM named")],
        "SELECT topic, medicine_name, CASE WHEN len(t) = 0 THEN medicine_name WHEN contains(medicine_name, 'Protocol') "
        "THEN array_to_string(t[1:5], ', ') ELSE medicine_name || ' (' || array_to_string(t[1:3], ', ') || ')' END "
        "AS remedy FROM titled"),
}
