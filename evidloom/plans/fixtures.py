"""Lexicons, rules and derived inputs with which the registered queries run over the driver's tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidloom.bounds import local_table, string_array
from evidloom.fixed_values import AGES, GENDERS, SEVERITIES
from evidloom.functions import scalars as sc
from evidloom.functions.lexicon import word_terms
from evidloom.operators.common import compute_once
from evidloom.operators.corpus import sentences
from evidloom.operators.evidence import EvidenceLexicon, extractions
from evidloom.operators.commerce import listing
from evidloom.operators.ensemble import VotingModel, fit_voting
from evidloom.operators.features import IntakeLexicon, extract_features
from evidloom.operators.profile import expand_kb, topic_profile
from evidloom.operators.rules import rule_match
from evidloom.operators.triage import TriageConfig, best_score, triage, triage_log_rows
from evidloom.session import stored
from evidloom.sources.tables import table, text_table

# Evidence extraction.
TOPICS = ["that", "with", "this", "from", "pour", "dans", "avec", "sich", "nicht", "para", "mente", "zzqx"]
TERMS = ["than", "thon", "thes", "thed", "erin", "tion", "ther", "ment", "elle", "ouai", "keit", "lich", "heit",
         "eine", "anea", "thre"]
CLASS_HINTS = [("a", ["the", "ing"]), ("b", ["que", "ou"]), ("c", ["ung", "der"])]
DEFAULT_CLASS = "none"
HIGH_WORDS = ["was", "are"]
LOW_WORDS = ["for"]
CONSTRAINTS = {
    "child_safe": "(that|with).{0,20}(the)",
    "elderly_safe": "(from).{0,20}(and)",
    "pregnant_safe": "(this|that).{0,20}(ing)",
}


def ordered(spark: SparkSession, values: list[str], name: str) -> DataFrame:
    return local_table(spark, list(enumerate(values)), f"{name}_ord int, {name} string")


def topics_table(spark: SparkSession) -> DataFrame:
    return ordered(spark, TOPICS, "topic")


def evidence_lexicon(spark: SparkSession) -> EvidenceLexicon:
    return EvidenceLexicon(topics_table(spark), ordered(spark, TERMS, "term"), CLASS_HINTS, DEFAULT_CLASS, HIGH_WORDS,
                           LOW_WORDS, CONSTRAINTS)


def document_sentences(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    docs = text_table(spark, folder, "documents", "doc_id", "text", *extra)
    return sentences(docs, ["doc_id", *extra])


def document_evidence(spark: SparkSession, folder: str) -> DataFrame:
    sents = document_sentences(spark, folder, "source").withColumn("doc_ord", F.col("doc_id"))
    return extractions(sents, evidence_lexicon(spark), ["doc_id", "sent_ord"])


def document_profile(spark: SparkSession, folder: str) -> DataFrame:
    return topic_profile(document_evidence(spark, folder), topics_table(spark), default_class=DEFAULT_CLASS)


def document_kb(spark: SparkSession, folder: str) -> DataFrame:
    return expand_kb(document_profile(spark, folder))


def sentence_entities(sents: DataFrame) -> DataFrame:
    """Entity rows: every token of a sentence with a score from its hash."""
    rows = sents.select("doc_id", "sent_ord", F.explode(F.split("low", " ")).alias("word"))
    digits = F.conv(F.substring(F.md5(F.col("word").cast("binary")), 1, 6), 16, 10).cast("long")
    return rows.withColumn("score", digits % 100 / F.lit(100.0))


# Fallback corpus: English documents are the base, the other languages are candidates for one topic each.
CANDIDATE_TOPICS = {"fr": "pour", "de": "avec", "es": "zzqx"}


def fallback_base(spark: SparkSession, folder: str) -> DataFrame:
    docs = text_table(spark, folder, "documents", "doc_id", "text", "lang", "source").where(F.col("lang") == "en")
    url = F.when(F.col("doc_id") % 40 == 0, F.col("source")).otherwise(F.concat(F.lit("base/"), "source"))
    return docs.select("doc_id", url.alias("url"), "text")


def fallback_pool(spark: SparkSession, folder: str) -> DataFrame:
    docs = text_table(spark, folder, "documents", "doc_id", "text", "lang", "source")
    topic_ord = F.coalesce(*[F.when(F.col("lang") == lang, TOPICS.index(t)) for lang, t in CANDIDATE_TOPICS.items()])
    return docs.select(topic_ord.alias("topic_ord"), F.col("doc_id").alias("rank"), F.col("source").alias("url"),
                       "text").where(F.col("topic_ord").isNotNull())


# Intake messages.
VOCAB = ["f_rep", "f_det", "f_conj", "f_that", "f_for", "f_und", "f_rom", "f_was", "f_ble", "f_neg", "f_erha", "f_fw",
         "f_wt", "f_de", "f_this", "f_thing", "f_tion", "on_the", "que", "enough", "eaux"]
PHRASES = [("the the", ["f_rep"]), ("of the", ["f_det"]), ("and that", ["f_conj", "f_that"]), ("for the", ["f_for"]),
           ("und", ["f_und"]), ("de la", ["f_rom"]), ("was", ["f_was"])]
KEYWORDS = [("thble", ["f_ble"]), ("nicht", ["f_neg", "f_und"]), ("erha", ["f_erha"])]
PAIRS = [("from", "with", "f_fw"), ("was", "that", "f_wt"), ("der", "die", "f_de"), ("une", "que", "f_rom")]
CONDITIONS = [("this", ["f_this", "f_was"]), ("thing", ["f_thing"]), ("erect", ["f_unknown"]), ("ontion", ["f_tion"])]
STOP = ["the", "of", "and"]
LEMMAS = [("thing", "thin"), ("things", "thin")]
RULES = [("K1", ["f_was"]), ("K1", ["f_that"]), ("K2", ["f_rep"]), ("K3", ["f_was", "f_thing"]),
         ("K4", ["f_wt", "f_was", "f_det"]), ("CRIT1", ["f_neg", "f_und"]), ("K5", ["f_und", "f_de"]),
         ("K6", ["f_rom"]), ("CRIT2", ["f_this", "f_was", "f_thing"]), ("K7", ["f_thing", "f_ble"])]
CRITICAL = ["CRIT1", "CRIT2"]
MODEL_SCORES = [("K1", 0.5), ("K2", 0.3), ("CRIT1", 0.2)]
FUZZY_CUTOFF = 85
TYPO_CUTOFF = 70
CUES_HIGH = ["was", "nicht", "des"]
CUES_LOW = ["that", "und", "les"]
POOL_EMPTY = ["f_was", "f_thing", "headache", "f_que", "f_neg", "on_the", "cough"]
POOL_FEW = ["f_und", "fatigue", "f_was", "chills", "f_det", "f_rom", "cough"]
MESSAGE_KEYS = ["conv_id", "turn"]


def intake_lexicon(spark: SparkSession, typo_scorer: str = "indel", literal_rows: int = 200,
                   hit_rows: int = 2000) -> IntakeLexicon:
    entries = "entry string, features array<string>"
    return IntakeLexicon(
        vocab=local_table(spark, list(enumerate(VOCAB)), "ord int, feature string"),
        phrases=local_table(spark, PHRASES, entries),
        keywords=local_table(spark, KEYWORDS, entries),
        pairs=local_table(spark, PAIRS, "w1 string, w2 string, feature string"),
        conditions=local_table(spark, CONDITIONS, entries),
        lemmas=local_table(spark, LEMMAS, "token string, lemma string"),
        stop=local_table(spark, [(s,) for s in STOP], "token string"),
        fuzzy_cutoff=FUZZY_CUTOFF, typo_cutoff=TYPO_CUTOFF, typo_scorer=typo_scorer, high_words=CUES_HIGH,
        low_words=CUES_LOW, literal_rows=literal_rows, hit_rows=hit_rows,
    )


def rules_table(spark: SparkSession) -> DataFrame:
    return local_table(spark, [(i, label, feats) for i, (label, feats) in enumerate(RULES)],
                       "rule_ord int, label string, feats array<string>")


def triage_config() -> TriageConfig:
    return TriageConfig(VOCAB, CRITICAL, POOL_EMPTY, POOL_FEW)


def user_messages(spark: SparkSession, folder: str) -> DataFrame:
    turns = text_table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    return with_final_check(turns)


def with_final_check(turns: DataFrame) -> DataFrame:
    return turns.where(F.col("role") == "user").select(
        "conv_id", "turn", "text", (F.col("turn") % 4 == 2).alias("is_final_check"))


def model_choice(final: Column) -> tuple[Column, Column]:
    """Label and confidence from the fixed score table."""
    labels = [n for n, _ in MODEL_SCORES]
    scores = F.array(*[F.lit(p) for _, p in MODEL_SCORES])
    best = best_score(scores, labels, CRITICAL, final)
    return best["label"], best["confidence"]


def triaged_messages(spark: SparkSession, messages: DataFrame) -> DataFrame:
    label, confidence = model_choice(F.col("is_final_check"))
    return triage(messages, MESSAGE_KEYS, intake_lexicon(spark), rules_table(spark), triage_config(), label, confidence)


def dialogue_messages(dialogues: DataFrame) -> DataFrame:
    """The running text of every user turn as a message of its own."""
    return dialogues.select("conv_id", "turn", F.col("dialogue").alias("text"), (F.col("turn") % 4 == 2).alias("is_final_check"))


def log_time() -> Column:
    """Time of a logged message: ten minutes for a conversation, one for a turn."""
    return F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 600 + F.col("turn") * 60)


def log_rows(triaged: DataFrame) -> DataFrame:
    rows = triage_log_rows(triaged.withColumn("user", F.col("conv_id").cast("string")), "user", log_time())
    return listing(rows.withColumn("confidence", F.round("confidence", 6)), "timestamp", ["username"])


def intake_model(spark: SparkSession, folder: str) -> VotingModel:
    """Ensemble that learns the rule labels of the messages that a rule fits."""
    rows = extract_features(user_messages(spark, folder), MESSAGE_KEYS, intake_lexicon(spark))
    known = rule_match(rows, rules_table(spark), MESSAGE_KEYS).where(F.col("rule_label").isNotNull())
    return fit_voting(stored(known.select("features", "rule_label"), "rule-labels"), "rule_label", VOCAB, CRITICAL)


# Customer profiles and remedy rules from parts; two parts make up one remedy topic, so both sides grow together.
def profiles(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        "c_custkey", (k % 90).cast("int").alias("age"),
        F.when(F.col("c_nationkey") % 2 == 0, "female").otherwise("male").alias("gender"),
        F.element_at(string_array(SEVERITIES), (k % 3 + 1).cast("int")).alias("severity"),
        (k % 7 == 0).alias("is_pregnant"), (40.0 + k % 60).alias("weight"),
        F.when(k % 100 == 0, 0.0).otherwise(140.0 + k % 60).alias("height"))


def remedy_table(spark: SparkSession, folder: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    pick = string_array
    return table(spark, folder, "part").select(
        F.concat(F.lit("t"), F.floor(k / 2)).alias("topic"), k.alias("remedy_ord"), F.col("p_name").alias("medicine_name"),
        F.col("p_type").alias("dosage"),
        F.when(k % 25 == 0, "null").when(size % 4 == 0, '["All"]').when(size % 4 == 1, " Young ").when(
            size % 4 == 2, '["middle", " ELDER ", ""]').alias("allowed_ages"),
        F.when(k % 3 == 0, pick(["all"])).when(k % 3 == 1, pick([" Male", ""])).otherwise(pick(["FEMALE"]))
        .alias("allowed_genders"),
        F.when(size % 3 == 0, pick(SEVERITIES)).when(size % 3 == 1, pick(["medium"])).otherwise(pick(["high"]))
        .alias("allowed_severities"))


def remedy_requests(spark: SparkSession, folder: str) -> DataFrame:
    rows = profiles(spark, folder)
    return rows.select(
        "c_custkey", F.concat(F.lit("t"), "c_custkey").alias("topic"),
        sc.age_band(sc.age_band(F.col("age"), "intake"), "kb").alias("age_group"), "gender", "severity")


def bucket_table(spark: SparkSession, folder: str) -> DataFrame:
    """Knowledge base with wildcard buckets: eight parts per topic."""
    k, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, folder, "part").select(
        k.alias("kb_ord"), F.concat(F.lit("t"), F.floor(k / 8)).alias("topic"), F.col("p_name").alias("medicine_name"),
        F.element_at(string_array(["all", *AGES]), (size % 4 + 1).cast("int")).alias("age_group"),
        F.element_at(string_array(["all", *GENDERS]), (k % 3 + 1).cast("int")).alias("gender"),
        F.element_at(string_array(SEVERITIES), (size % 3 + 1).cast("int")).alias("severity"))


def bucket_requests(spark: SparkSession, folder: str) -> DataFrame:
    rows = profiles(spark, folder)
    return rows.select("c_custkey", F.concat(F.lit("t"), F.floor(F.col("c_custkey") / 5)).alias("topic"),
                       sc.age_band(F.col("age"), "demo").alias("age_group"), "gender", "severity")


def topic_requests(spark: SparkSession, folder: str) -> DataFrame:
    """One request per customer for a topic of the document knowledge base."""
    topic = F.element_at(string_array(TOPICS), (F.col("c_custkey") % len(TOPICS) + 1).cast("int"))
    rows = profiles(spark, folder)
    return rows.select("c_custkey", topic.alias("topic"),
                       sc.age_band(sc.age_band(F.col("age"), "intake"), "kb").alias("age_group"), "gender", "severity")


# Document topics under names close to the triage labels.
LABEL_TOPICS = ["K1", "K2x", "K-3", "K4", "K5x", "K6", "K77", "CRIT1", "CRIT2", "Z8", "Z9", "Z10"]


def label_kb(spark: SparkSession, folder: str) -> DataFrame:
    kb = document_kb(spark, folder)
    name = F.element_at(string_array(LABEL_TOPICS), F.col("topic_ord") + 1)
    return kb.select(name.alias("topic"), "combo_ord", "age_group", "gender", "severity", F.lit(0).cast("long")
                     .alias("remedy_ord"), "medicine_name", "dosage", "top_terms")


# Feature matrix of the documents: whole-word presence.
FEATURE_WORDS = ["the", "and", "que", "der", "les", "los", "mit", "pour", "para", "con", "est", "die", "del", "une",
                 "und", "this"]
RULE_LABELS = [("the", "en"), ("les", "fr"), ("der", "de"), ("los", "es")]


def feature_matrix(spark: SparkSession, folder: str) -> DataFrame:
    docs = text_table(spark, folder, "documents", "doc_id", "text", "lang")
    low = compute_once(docs, _low=F.lower("text")).drop("text")
    return low.select("doc_id", F.col("lang").alias("label"), word_terms(F.col("_low"), FEATURE_WORDS)
                      .alias("features"))


def rule_prediction(features: Column) -> Column:
    out = F.when(F.lit(False), "")
    for word, label in RULE_LABELS:
        out = out.when(F.array_contains(features, word), label)
    return out.otherwise("en")
