"""Registered queries on customers and parts: bands, eligibility, lookups, recommendation."""
from __future__ import annotations

from pyspark.sql import functions as F

from evidloom import fixed_values as fv
from evidloom.bounds import string_array
from evidloom.functions import scalars as sc
from evidloom.operators import lookup as lk
from evidloom.operators.profile import PatientDims, expand_kb
from evidloom.plans import fixtures as fx
from evidloom.plans.evidence_queries import KB, TITLED
from evidloom.plans.intake_queries import TRIAGE, ratio_sql
from evidloom.plans.sql import lit, query, values
from evidloom.session import stored, work_folder
from evidloom.sources import stores


def age_bands(spark, folder):
    rows = fx.profiles(spark, folder)
    intake = sc.age_band(F.col("age"), "intake")
    return rows.select("c_custkey", intake.alias("intake"), sc.age_band(F.col("age"), "demo").alias("demo"),
                       sc.age_band(intake, "kb").alias("kb"))


def bmi(spark, folder):
    return fx.profiles(spark, folder).select("c_custkey", sc.bmi(F.col("weight"), F.col("height")).alias("bmi"))


def dosage_adjust(spark, folder):
    rows = fx.profiles(spark, folder).withColumn("band", sc.age_band(F.col("age"), "intake"))
    base = F.when(F.col("c_custkey") % 5 == 0, "Half Dose daily").when(
        F.col("c_custkey") % 5 == 1, "INTENSIVE course").otherwise("1 tablet")
    return rows.select("c_custkey", sc.dosage_adjust(base, F.col("band"), F.col("severity")).alias("dosage"),
                       sc.pregnancy_status(F.col("gender"), F.col("is_pregnant")).alias("pregnancy_status"))


def normalize_list(spark, folder):
    text = (F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit('["'), "c_name", F.lit('", " ", " All "]')))
            .when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("  "), "c_name"))
            .when(F.col("c_custkey") % 4 == 2, F.lit("[broken")))
    rows = fx.table(spark, folder, "customer")
    return rows.select("c_custkey", F.array_join(sc.normalize_list(text), "|").alias("items"))


def eligibility_matrix(spark, folder):
    return lk.eligibility_matrix(fx.remedy_table(spark, folder)).select(
        *lk.BUCKET, "combo_ord", "remedy_ord", "medicine_name", "dosage")


def kb_lookup(spark, folder):
    kb = fx.document_kb(spark, folder).select(*lk.BUCKET, "medicine_name", "dosage")
    return lk.kb_lookup(fx.topic_requests(spark, folder), kb)


def kb_lookup_fallback(spark, folder):
    kb = lk.eligibility_matrix(fx.remedy_table(spark, folder))
    return lk.kb_lookup_fallback(fx.remedy_requests(spark, folder), kb).select(
        "c_custkey", *lk.BUCKET, "match_level", "remedy_ord", "medicine_name", "dosage")


def relaxed_lookup(spark, folder):
    found = lk.relaxed_lookup(fx.bucket_requests(spark, folder), fx.bucket_table(spark, folder))
    return found.select("c_custkey", *lk.BUCKET, "match_level", "rank", "kb_ord", "medicine_name")


def register_new(spark, folder):
    """Customers against suppliers, named after their balance, so that names repeat on both sides."""
    def named(rows, balance):
        return rows.withColumn("name", F.concat(F.lit("acct-"), F.floor(F.col(balance) / 10)))

    new = named(fx.table(spark, folder, "customer"), "c_acctbal").select("c_custkey", "name")
    known = named(fx.table(spark, folder, "supplier"), "s_acctbal")
    return lk.register_new(new, known, "name", "c_custkey").select("c_custkey", "name")


def _triaged_people(spark, folder):
    people = fx.profiles(spark, folder).select(
        F.col("c_custkey").alias("conv_id"), sc.age_band(F.col("age"), "intake").alias("age_category"), "gender",
        "severity", "is_pregnant")
    return fx.triaged_messages(spark, fx.user_messages(spark, folder)).select(
        "conv_id", "turn", "label", "status").join(people, "conv_id")


def recommend(spark, folder):
    rows = _triaged_people(spark, folder)
    return _recommended(spark, stored(rows, "triaged"), stored(fx.label_kb(spark, folder), "kb"))


def stored_recommend(spark, folder):
    """Recommendations from a knowledge base that was written as a version and loaded again."""
    place = work_folder(spark, "kb-store")
    profile = stored(fx.document_profile(spark, folder), "profile")
    names = F.element_at(string_array(fx.LABEL_TOPICS), F.col("topic_ord") + 1)
    stores.write_kb(expand_kb(profile).withColumn("topic", names), profile.withColumn("topic", names), place)
    return _recommended(spark, stored(_triaged_people(spark, folder), "triaged"), stores.load_kb(spark, place, "nowhere"))


def _recommended(spark, rows, kb):
    keys = fx.ordered(spark, fx.LABEL_TOPICS, "key")
    found = lk.recommend(rows, kb, keys, scorer="indel")
    return found.select("conv_id", "turn", "label", "topic", "match_level", "remedy_ord", "remedy", "remedy_dosage",
                        "pregnancy_status")


# --- SQL ------------------------------------------------------------------------------------------------------------

_INTAKE = "CASE WHEN age <= 12 THEN 'children' WHEN age >= 50 THEN 'elderly' ELSE 'youth' END"
_KB_AGE = "CASE WHEN age <= 12 THEN 'child' WHEN age >= 50 THEN 'elder' ELSE 'young' END"
_DEMO = "CASE WHEN age < 25 THEN 'young' WHEN age >= 60 THEN 'elder' ELSE 'middle' END"
PROFILES = [
    ("people", "SELECT c_custkey, c_custkey % 90 AS age, CASE WHEN c_nationkey % 2 = 0 THEN 'female' ELSE 'male' END AS "
               "gender, ['low', 'medium', 'high'][c_custkey % 3 + 1] AS severity, c_custkey % 7 = 0 AS is_pregnant, "
               "40.0::DOUBLE + c_custkey % 60 AS weight, CASE WHEN c_custkey % 100 = 0 THEN 0.0::DOUBLE ELSE "
               "140.0::DOUBLE + c_custkey % 60 END AS height FROM customer"),
    ("combos", values([(i, a, g, s) for i, (a, g, s) in enumerate(PatientDims().combos())],
                      "combo_ord", "age_group", "gender", "severity")),
]
ELIGIBLE = PROFILES + [
    ("remedies", "SELECT 't' || (p_partkey // 2) AS topic, p_partkey AS remedy_ord, p_name AS medicine_name, p_type AS "
                 "dosage, CASE WHEN p_partkey % 25 = 0 THEN []::VARCHAR[] WHEN p_size % 4 = 0 THEN ['all'] WHEN p_size % 4 = 1 THEN "
                 "['young'] WHEN p_size % 4 = 2 THEN ['middle', 'elder'] END AS ages, CASE p_partkey % 3 WHEN 0 THEN ['all'] WHEN 1 THEN ['male'] ELSE ['female'] END AS genders, "
                 "CASE p_size % 3 WHEN 0 THEN ['low', 'medium', 'high'] WHEN 1 THEN ['medium'] ELSE ['high'] END AS "
                 "severities FROM part"),
    ("fitting", "SELECT r.topic, c.age_group, c.gender, c.severity, r.remedy_ord, r.medicine_name, r.dosage FROM "
                "remedies r, combos c WHERE (ages IS NULL OR list_contains(ages, 'all') OR list_contains(ages, "
                "age_group)) AND (list_contains(genders, 'all') OR list_contains(genders, gender)) AND "
                "list_contains(severities, severity)"),
    ("matrix", "SELECT b.topic, b.age_group, b.gender, b.severity, b.combo_ord, f.remedy_ord, f.medicine_name, f.dosage "
               "FROM (SELECT * FROM (SELECT DISTINCT topic FROM remedies), combos) b LEFT JOIN fitting f USING "
               "(topic, age_group, gender, severity)"),
    ("requests", f"SELECT c_custkey, 't' || c_custkey AS topic, {_KB_AGE} AS age_group, gender, severity FROM people"),
]


def _cascade(requests: str, matrix: str, keys: str) -> list[tuple[str, str]]:
    defaults = values([(i, n, d) for i, (n, d) in enumerate(fv.DEFAULT_REMEDIES)], "d_ord", "d_name", "d_dosage")
    return [
        ("filled", f"SELECT * FROM {matrix} WHERE remedy_ord IS NOT NULL"),
        ("first_bucket", "SELECT topic, min(combo_ord) AS first_ord FROM filled GROUP BY topic"),
        ("wanted", f"SELECT r.*, c.combo_ord AS want_ord FROM {requests} r LEFT JOIN combos c USING "
                   "(age_group, gender, severity)"),
        ("levels", "SELECT w.*, CASE WHEN EXISTS (SELECT 1 FROM filled f WHERE f.topic = w.topic AND f.combo_ord = "
                   "w.want_ord) THEN 'exact' WHEN b.first_ord IS NOT NULL THEN 'first' ELSE 'default' END AS "
                   "match_level, b.first_ord FROM wanted w LEFT JOIN first_bucket b USING (topic)"),
        ("defaults", defaults),
        ("resolved", f"SELECT {keys}, l.match_level, f.remedy_ord, f.medicine_name, f.dosage FROM levels l JOIN filled f "
                     "ON f.topic = l.topic AND f.combo_ord = CASE l.match_level WHEN 'exact' THEN l.want_ord ELSE "
                     f"l.first_ord END WHERE l.match_level <> 'default' UNION ALL SELECT {keys}, l.match_level, d_ord, "
                     "d_name, d_dosage FROM levels l, defaults WHERE l.match_level = 'default'"),
    ]


RELAXED = PROFILES + [
    ("buckets", "SELECT p_partkey AS kb_ord, 't' || (p_partkey // 8) AS topic, p_name AS medicine_name, "
                "['all', 'young', 'middle', 'elder'][p_size % 4 + 1] AS b_age, ['all', 'male', 'female'][p_partkey % 3 "
                "+ 1] AS b_gender, ['low', 'medium', 'high'][p_size % 3 + 1] AS severity FROM part"),
    ("requests", f"SELECT c_custkey, 't' || (c_custkey // 5) AS topic, {_DEMO} AS age_group, gender, severity "
                 "FROM people"),
    ("loose", "SELECT r.*, b.kb_ord, b.medicine_name, b.b_age IN (r.age_group, 'all') AND b.b_gender IN (r.gender, "
              "'all') AS strict FROM requests r LEFT JOIN buckets b USING (topic, severity)"),
    ("best", "SELECT *, bool_or(strict) OVER (PARTITION BY c_custkey) AS any_strict FROM loose"),
    ("ranked", "SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY kb_ord) AS rank FROM best WHERE "
               "any_strict IS NULL OR strict = any_strict"),
]
_LABEL_KB = KB + [
    ("label_topics", values(list(enumerate(fx.LABEL_TOPICS)), "topic_ord", "label_topic")),
    ("label_kb", "SELECT t.label_topic AS topic, kb.combo_ord, 0 AS remedy_ord, kb.medicine_name, kb.dosage, "
                 "kb.top_terms FROM kb JOIN label_topics t USING (topic_ord)"),
]
RECOMMEND = PROFILES[:1] + _LABEL_KB + TRIAGE + [
    ("label_scores", f"SELECT label, t.topic_ord, t.label_topic, {ratio_sql('label', 't.label_topic')} AS score FROM "
                     "(SELECT DISTINCT label FROM routed WHERE status = 'success') l, label_topics t"),
    ("label_best", f"SELECT label, label_topic FROM label_scores WHERE score >= {fv.LOOKUP_CUTOFF} "
                   "QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, topic_ord) = 1"),
    ("asked", f"SELECT r.conv_id, r.turn, r.label, coalesce(b.label_topic, '') AS topic, {_KB_AGE} AS age_group, "
              f"p.gender, p.severity, p.is_pregnant, {_INTAKE} AS band FROM routed r JOIN people p ON r.conv_id = "
              "p.c_custkey LEFT JOIN label_best b ON r.label = b.label WHERE r.status = 'success'"),
] + _cascade("asked", "label_kb", "l.conv_id, l.turn, l.label, l.topic, l.gender, l.severity, l.is_pregnant, l.band")
_BASE_DOSE = ("CASE c_custkey % 5 WHEN 0 THEN 'Half Dose daily' WHEN 1 THEN 'INTENSIVE course' ELSE '1 tablet' END")


def _dose(dosage: str, band: str) -> str:
    scaled = (f"CASE WHEN {band} IN ('children', 'elderly') AND NOT contains({dosage}, 'Half Dose') THEN "
              f"{lit(fv.SCALED_PREFIX)} || {dosage} ELSE {dosage} END")
    return (f"CASE WHEN severity = 'high' AND NOT contains({scaled}, 'INTENSIVE') THEN 'INTENSIVE: ' || ({scaled}) || "
            f"{lit(fv.INTENSIVE_SUFFIX)} ELSE {scaled} END")


_PREGNANCY = (f"CASE WHEN gender = 'male' THEN {lit(fv.PREGNANCY_MALE)} WHEN is_pregnant THEN {lit(fv.PREGNANCY_YES)} "
              f"ELSE {lit(fv.PREGNANCY_NO)} END")

QUERIES = {
    "age_bands": age_bands,
    "bmi": bmi,
    "dosage_adjust": dosage_adjust,
    "normalize_list": normalize_list,
    "eligibility_matrix": eligibility_matrix,
    "kb_lookup": kb_lookup,
    "kb_lookup_fallback": kb_lookup_fallback,
    "relaxed_lookup": relaxed_lookup,
    "register_new": register_new,
    "recommend": recommend,
    "stored_recommend": stored_recommend,
}
ORACLE = {
    "age_bands": query(PROFILES, f"SELECT c_custkey, {_INTAKE} AS intake, {_DEMO} AS demo, {_KB_AGE} AS kb FROM people"),
    "bmi": query(PROFILES, "SELECT c_custkey, round(weight / nullif((height / 100.0) * (height / 100.0), 0.0), 1) AS bmi "
                           "FROM people"),
    "dosage_adjust": query(
        PROFILES + [("based", f"SELECT *, {_BASE_DOSE} AS base, {_INTAKE} AS band FROM people")],
        f"SELECT c_custkey, {_dose('base', 'band')} AS dosage, {_PREGNANCY} AS pregnancy_status FROM based"),
    "normalize_list": (
        "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN lower(c_name) || '|all' WHEN 1 THEN lower(c_name) ELSE '' END "
        "AS items FROM customer"),
    "eligibility_matrix": query(ELIGIBLE, "SELECT * FROM matrix"),
    "kb_lookup": query(
        KB + PROFILES[:1] + [
            ("topic_names", values(list(enumerate(fx.TOPICS)), "t_ord", "topic")),
            ("requests", f"SELECT c_custkey, topic, {_KB_AGE} AS age_group, gender, severity FROM people JOIN "
                         f"topic_names ON t_ord = c_custkey % {len(fx.TOPICS)}")],
        "SELECT r.*, kb.medicine_name, kb.dosage FROM requests r LEFT JOIN (SELECT topic, age_group, gender, "
        "combos.severity, medicine_name, dosage FROM kb JOIN combos USING (combo_ord, age_group, gender)) kb USING "
        "(topic, age_group, gender, severity)"),
    "kb_lookup_fallback": query(
        ELIGIBLE + _cascade("requests", "matrix", "c_custkey, l.topic, l.age_group, l.gender, l.severity"),
        "SELECT * FROM resolved"),
    "relaxed_lookup": query(
        RELAXED, "SELECT c_custkey, topic, age_group, gender, severity, CASE WHEN kb_ord IS NULL THEN NULL WHEN any_strict "
                 "THEN 'strict' ELSE 'relaxed' END AS match_level, CASE WHEN kb_ord IS NOT NULL THEN rank END AS rank, "
                 "kb_ord, medicine_name FROM ranked WHERE rank <= 3"),
    "recommend": query(
        RECOMMEND + [
            ("terms", f"SELECT DISTINCT topic, {TITLED} AS t FROM label_kb"),
            ("named", "SELECT r.*, CASE WHEN r.match_level = 'default' THEN []::VARCHAR[] ELSE terms.t END AS t FROM "
                      "resolved r LEFT JOIN terms USING (topic)")],
        "SELECT conv_id, turn, label, topic, match_level, remedy_ord, CASE WHEN len(t) = 0 THEN medicine_name ELSE "
        f"array_to_string(t[1:5], ', ') END AS remedy, {_dose('dosage', 'band')} AS remedy_dosage, {_PREGNANCY} AS "
        "pregnancy_status FROM named"),
    "register_new": (
        "WITH named AS (SELECT c_custkey, 'acct-' || floor(c_acctbal / 10)::BIGINT AS name FROM customer) SELECT c_custkey, "
        "name FROM named WHERE name NOT IN (SELECT 'acct-' || floor(s_acctbal / 10)::BIGINT FROM supplier) QUALIFY "
        "row_number() OVER (PARTITION BY name ORDER BY c_custkey) = 1"),
}
ORACLE["stored_recommend"] = ORACLE["recommend"]
