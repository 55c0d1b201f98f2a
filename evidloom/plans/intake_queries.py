"""Registered queries on conversations: features, rules, triage, dialogue text, similarity."""
from __future__ import annotations

from pyspark.sql import functions as F

from evidloom import fixed_values as fv
from evidloom.bounds import string_array
from evidloom.functions import lexicon as lx
from evidloom.functions import scalars as sc
from evidloom.functions import similarity as sim
from evidloom.functions import text as tx
from evidloom.functions import vectors as vc
from evidloom.operators import features as ft
from evidloom.operators import triage as tr
from evidloom.operators.rules import rule_match as match_rules
from evidloom.operators.similar import fuzzy_best_match as best_match
from evidloom.operators.similar import similar_pairs
from evidloom.plans import fixtures as fx
from evidloom.plans.sql import lit, query, values
from evidloom.sources.tables import table

KEYS = fx.MESSAGE_KEYS


def non_blank(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    return turns.where(tx.not_blank(F.col("text"))).select("conv_id", "turn")


def lemma_text(spark, folder):
    return ft.lemmatize(fx.user_messages(spark, folder), KEYS, fx.intake_lexicon(spark)).select(*KEYS, "lemma_text")


def _step(name):
    def run(spark, folder):
        lex = fx.intake_lexicon(spark)
        rows = ft.prepare_messages(fx.user_messages(spark, folder), KEYS, lex)
        rows = getattr(ft, name)(rows, KEYS, lex)
        return rows.select(*KEYS, F.array_join(name, ",").alias("features"))
    run.__name__ = name
    return run


def typo_fallback(spark, folder):
    """Vocabulary name of every misspelt word, with the native scorer."""
    words = fx.user_messages(spark, folder).select(tx.clean_words(F.col("text")).alias("words"))
    return ft.typo_hits(ft.distinct_words(words, fv.TYPO_WORD_MIN_CHARS), fx.intake_lexicon(spark))


def typo_fallback_weighted(spark, folder):
    """Features of all messages when misspelt words are scored by the weighted ratio."""
    rows = ft.extract_features(fx.user_messages(spark, folder), KEYS, fx.intake_lexicon(spark, "weighted"))
    return rows.select(*KEYS, F.array_join("features", ",").alias("features"))


def _features(spark, folder):
    return ft.extract_features(fx.user_messages(spark, folder), KEYS, fx.intake_lexicon(spark))


def extract_features(spark, folder):
    return _features(spark, folder).select(*KEYS, F.array_join("features", ",").alias("features"))


def severity_last_cue(spark, folder):
    return fx.user_messages(spark, folder).select(
        *KEYS, lx.severity_by_last_cue(tx.tokens(F.col("text")), fx.CUES_HIGH, fx.CUES_LOW).alias("severity"))


def rule_match(spark, folder):
    return match_rules(_features(spark, folder), fx.rules_table(spark), KEYS).select(*KEYS, "rule_label")


def label_choice(spark, folder):
    rows = match_rules(_features(spark, folder), fx.rules_table(spark), KEYS)
    label, confidence = fx.model_choice(F.col("is_final_check"))
    return tr.label_choice(rows, label, confidence).select(*KEYS, "label", F.round("confidence", 6).alias("confidence"))


def feature_vector(spark, folder):
    vector = vc.feature_array(F.col("features"), fx.VOCAB)
    return _features(spark, folder).select(
        *KEYS, F.array_join(F.transform(vector, lambda x: x.cast("int").cast("string")), "").alias("vector"))


def suggest_empty(spark, folder):
    rows = _features(spark, folder).where(F.size("features") == 0)
    return rows.select(*KEYS, F.array_join(vc.suggest(F.col("features"), fx.POOL_EMPTY, fx.VOCAB, 5), ",")
                       .alias("follow_ups"))


def suggest_few(spark, folder):
    return _features(spark, folder).select(
        *KEYS, F.array_join(vc.suggest(F.col("features"), fx.POOL_FEW, fx.VOCAB, 4), ",").alias("follow_ups"))


def display_name(spark, folder):
    names = _features(spark, folder).select(F.explode("features").alias("feature")).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"))
    return names.select("feature", "n", sc.display_name(F.col("feature")).alias("title"),
                        sc.display_name(F.col("feature"), "first").alias("raised"))


def triage(spark, folder):
    rows = fx.triaged_messages(spark, fx.user_messages(spark, folder))
    return rows.select(*KEYS, F.array_join("features", ",").alias("features"), "detected_severity", "status",
                       "message", "top_label", "confidence_pct", F.array_join("follow_ups", ",").alias("follow_ups"))


def triage_log_rows(spark, folder):
    return fx.log_rows(fx.triaged_messages(spark, fx.user_messages(spark, folder)))


def triage_model(spark, folder):
    """Triage with the ensemble; contributions as text."""
    rows = tr.triage_with_model(fx.user_messages(spark, folder), KEYS, fx.intake_lexicon(spark), fx.rules_table(spark),
                                fx.triage_config(), fx.intake_model(spark, folder))
    shares = F.transform("contributions", lambda c: F.concat_ws(":", c["symptom"], c["impact_score"].cast("string")))
    return rows.select(*KEYS, F.array_join("features", ",").alias("features"), "rule_label", "status", "top_label",
                       F.round("confidence", 6).alias("confidence"), F.array_join(shares, ",").alias("contributions"))


def _dialogues(spark, folder):
    turns = fx.user_messages(spark, folder).select("conv_id", "turn", "text")
    return tr.dialogue_accumulate(turns, "conv_id", "turn").select("conv_id", "turn", "dialogue")


def dialogue_accumulate(spark, folder):
    return _dialogues(spark, folder)


def dialogue_triage(spark, folder):
    """Every turn triaged by the whole text of its conversation so far."""
    rows = fx.triaged_messages(spark, fx.dialogue_messages(_dialogues(spark, folder)))
    return rows.select(*KEYS, F.array_join("features", ",").alias("features"), "status", "top_label", "confidence_pct")


def indel_ratio(spark, folder):
    """Scores of all distinct words with every condition, by the general expression."""
    words = fx.user_messages(spark, folder).select(tx.clean_words(F.col("text")).alias("words"))
    pairs = ft.distinct_words(words, fv.FUZZY_WORD_MIN_CHARS).select(
        "a", F.explode(string_array([c for c, _ in fx.CONDITIONS])).alias("b"))
    return pairs.withColumn("score", sim.indel_ratio("a", "b"))


def similar_words(spark, folder):
    words = fx.user_messages(spark, folder).select(tx.clean_words(F.col("text")).alias("words"))
    conditions = fx.intake_lexicon(spark).conditions.select(F.col("entry").alias("b"))
    return similar_pairs(ft.distinct_words(words, fv.FUZZY_WORD_MIN_CHARS), conditions, fx.FUZZY_CUTOFF)


PART_KEYS = ["red widget", "hot plate", "cold gear", "old rod", "blue gizmo", "small anvil"]


def _part_match(spark, folder, scorer):
    names = table(spark, folder, "part").select(F.col("p_name").alias("a"))
    return best_match(names, fx.ordered(spark, PART_KEYS, "key"), fv.LOOKUP_CUTOFF, scorer)


def fuzzy_best_match(spark, folder):
    return _part_match(spark, folder, "indel")


def fuzzy_best_match_weighted(spark, folder):
    return _part_match(spark, folder, "weighted")


# --- SQL ------------------------------------------------------------------------------------------------------------

def _list(items) -> str:
    return "[" + ", ".join(lit(i) for i in items) + "]" + ("" if items else "::VARCHAR[]")


def _lexicon(text: str, entries) -> str:
    cases = ", ".join(f"CASE WHEN contains({text}, {lit(e)}) THEN {_list(f)} ELSE []::VARCHAR[] END"
                      for e, f in entries)
    return f"list_sort(list_distinct(flatten([{cases}])))"


def ratio_sql(a: str, b: str) -> str:
    full = f"((1::BIGINT << length({b})) - 1)"
    masks = (f"list_transform(string_split({a}, ''), lambda c: list_sum(list_transform(range(length({b})), lambda i: "
             f"CASE WHEN substr({b}, i + 1, 1) = c THEN 1::BIGINT << i ELSE 0::BIGINT END))::BIGINT)")
    left = f"list_reduce({masks}, lambda v, m: (((v + (v & m)) | (v - (v & m))) & {full}), {full})"
    return (f"round_even(200.0 * (length({b}) - bit_count({left})) / (length({a}) + length({b})), 0)::INT")


_SPACE_CLASS = tx.SPACE
_WORDS = (f"list_filter(regexp_split_to_array(translate(lower(text), '.,', ''), {lit(_SPACE_CLASS + '+')}), "
          "lambda w: w <> '')")
_TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_'']+|[^\\p{L}\\p{N}_''\\s]')"


def _lemma(t: str) -> str:
    return f"CASE {t} " + " ".join(f"WHEN {lit(a)} THEN {lit(b)}" for a, b in fx.LEMMAS) + f" ELSE {t} END"


_LAST_CUE = f"list_filter(toks, lambda t: t IN ({', '.join(lit(c) for c in fx.CUES_HIGH + fx.CUES_LOW)}))[-1]"
_NAMES = ([(0, i, v, v) for i, v in enumerate(fx.VOCAB)]
          + [(1, i, v, v.replace("_", " ")) for i, v in enumerate(fx.VOCAB)])
MESSAGES = [
    ("messages", "SELECT conv_id, turn, regexp_replace(replace(text, 'skip_followup.', ''), "
                 f"{lit(f'^{_SPACE_CLASS}+|{_SPACE_CLASS}+$')}, '', 'g') AS text, text AS raw, turn % 4 = 2 AS "
                 "is_final_check FROM conversations WHERE role = 'user'"),
    ("tokened", f"SELECT *, lower(text) AS low, {_WORDS} AS words, {_TOKENS} AS toks FROM messages"),
    ("prepared", f"SELECT *, ' ' || array_to_string(list_transform(toks, lambda t: {_lemma('t')}), ' ') || ' ' AS "
                 "lemma_seq, array_to_string(list_transform(list_filter(toks, lambda t: t NOT IN "
                 f"({', '.join(lit(s) for s in fx.STOP)}) AND regexp_matches(t, '^\\p{{L}}+$')), "
                 f"lambda t: {_lemma('t')}), ' ') AS lemma_text FROM tokened"),
    ("hay", "SELECT *, lemma_text || chr(1) || low AS haystack FROM prepared"),
    ("all_words", "SELECT DISTINCT unnest(words) AS a FROM tokened"),
    ("conditions", values(fx.CONDITIONS, "entry", "features")),
    ("scored", f"SELECT a, entry AS b, features, {ratio_sql('a', 'entry')} AS score FROM all_words, conditions "
               f"WHERE length(a) >= {fv.FUZZY_WORD_MIN_CHARS}"),
    ("cond_words", f"SELECT a, list_distinct(flatten(list(features))) AS f FROM scored WHERE score >= "
                   f"{fx.FUZZY_CUTOFF} GROUP BY a"),
    ("names", values(_NAMES, "spaced", "ord", "feature", "b")),
    ("typo_pairs", f"SELECT a, spaced, ord, feature, {ratio_sql('a', 'b')} AS score FROM all_words, names "
                   f"WHERE length(a) >= {fv.TYPO_WORD_MIN_CHARS}"),
    ("typos", f"SELECT a AS word, feature AS value FROM typo_pairs WHERE score >= {fx.TYPO_CUTOFF} "
              "QUALIFY row_number() OVER (PARTITION BY a ORDER BY spaced, score DESC, ord) = 1"),
    ("hit_sets", "SELECT h.*, "
              f"{_lexicon('lemma_seq', [(f' {p} ', f) for p, f in fx.PHRASES])} AS phrase_features, "
              f"{_lexicon('haystack', fx.KEYWORDS)} AS keyword_features, "
              "list_sort(list_distinct(list_filter(["
              + ", ".join(f"CASE WHEN contains(haystack, {lit(a)}) AND contains(haystack, {lit(b)}) THEN {lit(f)} END"
                          for a, b, f in fx.PAIRS)
              + "], lambda x: x IS NOT NULL))) AS cooc_features, "
              f"list_sort(list_distinct(list_concat({_lexicon('low', fx.CONDITIONS)}, coalesce((SELECT "
              "flatten(list(f)) FROM cond_words c WHERE list_contains(h.words, c.a)), []::VARCHAR[])))) "
              "AS condition_features, "
              f"{_lexicon('low', [(b, [f]) for _, _, f, b in _NAMES])} AS vocab_features FROM hay h"),
    ("unioned", "SELECT *, list_distinct(flatten([phrase_features, keyword_features, cooc_features, "
                "condition_features, vocab_features])) AS u FROM hit_sets"),
    ("fixed", "SELECT *, CASE WHEN len(u) > 0 THEN u ELSE coalesce((SELECT list(value) FROM typos t WHERE "
              "list_contains(unioned.words, t.word)), []::VARCHAR[]) END AS f FROM unioned"),
    ("featured", f"SELECT *, list_sort(list_distinct(list_filter(f, lambda x: x IN "
                 f"({', '.join(lit(v) for v in fx.VOCAB)})))) AS features, CASE WHEN {_LAST_CUE} IN "
                 f"({', '.join(lit(c) for c in fx.CUES_HIGH)}) THEN 'high' WHEN {_LAST_CUE} IN "
                 f"({', '.join(lit(c) for c in fx.CUES_LOW)}) THEN 'low' ELSE 'medium' END AS detected_severity "
                 "FROM fixed"),
]
_RULE_CASES = " ".join(
    f"WHEN list_has_all(features, {_list(f)}) AND len(features) <= {len(f) + 1} THEN {lit(label)}"
    for label, f in fx.RULES)
_BEST_PLAIN, _BEST_FINAL = fx.MODEL_SCORES[0], [s for s in fx.MODEL_SCORES if s[0] not in fx.CRITICAL]
_EXP_ALL = f"({' + '.join(f'exp({p})' for _, p in fx.MODEL_SCORES)})"
_PLAIN_CONF = f"exp({_BEST_PLAIN[1]}) / {_EXP_ALL}"
_FINAL_CONF = (f"(exp({_BEST_FINAL[0][1]}) / {_EXP_ALL}) / "
               f"({' + '.join(f'exp({p}) / {_EXP_ALL}' for _, p in _BEST_FINAL)} + 1e-9)")


def suggest_sql(pool, limit: int) -> str:
    inside = _list([p for p in pool if p in fx.VOCAB])
    first = f"list_filter({inside}, lambda p: NOT list_contains(features, p))"
    rest = (f"list_filter({_list(fx.VOCAB)}, lambda p: NOT list_contains(features, p) AND NOT "
            f"list_contains({inside}, p))")
    return f"list_concat({first}, {rest}[1:greatest(4 - len({first}), 0)])[1:{limit}]"


_IS_CRIT = f"label IN ({', '.join(lit(c) for c in fx.CRITICAL)})"
TRIAGE = MESSAGES + [
    ("matched", f"SELECT *, CASE WHEN len(features) = 0 THEN NULL {_RULE_CASES} END AS rule_label FROM featured"),
    ("chosen", f"SELECT *, coalesce(rule_label, {lit(_BEST_PLAIN[0])}) AS label, CASE WHEN rule_label IS NOT NULL "
               f"THEN {fv.RULE_CONFIDENCE} WHEN is_final_check THEN {_FINAL_CONF} ELSE {_PLAIN_CONF} END AS "
               "confidence FROM matched"),
    ("stated", f"SELECT *, CASE WHEN len(features) = 0 AND is_final_check THEN 'a' WHEN len(features) = 0 THEN 'b' "
               f"WHEN NOT is_final_check AND len(features) < 3 AND {_IS_CRIT} THEN 'c' WHEN NOT is_final_check AND "
               f"len(features) < 3 THEN 'd' WHEN {_IS_CRIT} AND confidence > 0.40 THEN 'e' ELSE 'f' END AS s "
               "FROM chosen"),
    ("routed", "SELECT *, CASE s WHEN 'a' THEN 'error' WHEN 'e' THEN 'CRITICAL' WHEN 'f' THEN 'success' ELSE "
               "'needs_more_info' END AS status, CASE s "
               f"WHEN 'a' THEN {lit(fv.REPLY_ERROR)} WHEN 'b' THEN {lit(fv.REPLY_NOTHING_FOUND)} "
               f"WHEN 'c' THEN {lit(fv.REPLY_CRITICAL_FEW[0])} || replace(features[1], '_', ' ') || "
               f"{lit(fv.REPLY_CRITICAL_FEW[1])} WHEN 'd' THEN {lit(fv.REPLY_FEW[0])} || array_to_string("
               "list_transform(features, lambda x: replace(x, '_', ' ')), ', ') || "
               f"{lit(fv.REPLY_FEW[1])} WHEN 'e' THEN {lit(fv.REPLY_EMERGENCY[0])} || label || "
               f"{lit(fv.REPLY_EMERGENCY[1])} END AS message, CASE s WHEN 'a' THEN NULL WHEN 'b' THEN 'Unknown' "
               "ELSE label END AS top_label, CASE s WHEN 'a' THEN NULL WHEN 'b' THEN 0.0 ELSE "
               "round(confidence * 100, 2) END AS confidence_pct, CASE s "
               f"WHEN 'b' THEN array_to_string({suggest_sql(fx.POOL_EMPTY, 5)}, ',') "
               f"WHEN 'c' THEN {lit(','.join(fv.CRITICAL_FOLLOW_UPS))} "
               f"WHEN 'd' THEN array_to_string({suggest_sql(fx.POOL_FEW, 4)}, ',') END AS follow_ups FROM stated"),
]
_LOGGED = ("SELECT conv_id::VARCHAR AS username, text AS symptoms, label AS predicted_disease, CASE status WHEN 'CRITICAL' THEN "
           "'EMERGENCY' ELSE 'COMPLETED' END AS status, round(confidence, 6) AS confidence, strftime(make_timestamp((1704067200 + "
           "conv_id * 600 + turn * 60) * 1000000), '%Y-%m-%d %H:%M') AS timestamp FROM routed WHERE status IN ('CRITICAL', 'success')")
TRIAGE_LOG = query(TRIAGE, _LOGGED)
DIALOGUE = ("SELECT conv_id, turn, coalesce(string_agg(CASE WHEN turn = first THEN text ELSE "
            f"{lit(fv.FOLLOW_UP[0])} || replace(text, '_', ' ') || {lit(fv.FOLLOW_UP[1])} END, '') OVER (PARTITION BY conv_id "
            "ORDER BY turn ROWS UNBOUNDED PRECEDING), '') AS dialogue FROM (SELECT *, min(turn) FILTER (text IS NOT NULL) OVER "
            "(PARTITION BY conv_id) AS first FROM conversations WHERE role = 'user')")
DIALOGUE_TRIAGE = [
    ("dialogues", DIALOGUE),
    ("messages", MESSAGES[0][1].replace("text", "dialogue").replace("AS dialogue", "AS text").replace("conversations WHERE role = 'user'", "dialogues")),
] + TRIAGE[1:]
DIALOGUE_LOG = query(DIALOGUE_TRIAGE, _LOGGED)


def _shown(name: str) -> str:
    return query(MESSAGES, f"SELECT conv_id, turn, array_to_string({name}, ',') AS features FROM hit_sets")


STEPS = ["phrase_features", "keyword_features", "cooc_features", "condition_features", "vocab_features"]
QUERIES = {
    "non_blank": non_blank,
    "lemma_text": lemma_text,
    **{name: _step(name) for name in STEPS},
    "typo_fallback": typo_fallback,
    "typo_fallback_weighted": typo_fallback_weighted,
    "extract_features": extract_features,
    "severity_last_cue": severity_last_cue,
    "rule_match": rule_match,
    "label_choice": label_choice,
    "feature_vector": feature_vector,
    "suggest_empty": suggest_empty,
    "suggest_few": suggest_few,
    "display_name": display_name,
    "triage": triage,
    "triage_log_rows": triage_log_rows,
    "triage_model": triage_model,
    "dialogue_accumulate": dialogue_accumulate,
    "dialogue_triage": dialogue_triage,
    "indel_ratio": indel_ratio,
    "similar_words": similar_words,
    "fuzzy_best_match": fuzzy_best_match,
    "fuzzy_best_match_weighted": fuzzy_best_match_weighted,
}
_PARTS = [("part_names", "SELECT DISTINCT p_name AS a FROM part"),
          ("part_keys", values(list(enumerate(PART_KEYS)), "key_ord", "key")),
          ("part_scores", f"SELECT a, key, key_ord, {ratio_sql('a', 'key')} AS score FROM part_names, part_keys"),
          ("part_best", f"SELECT a, key, score FROM part_scores WHERE score >= {fv.LOOKUP_CUTOFF} "
                        "QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, key_ord) = 1")]
ORACLE = {
    "non_blank": "SELECT conv_id, turn FROM conversations WHERE trim(text) <> ''",
    "lemma_text": query(MESSAGES, "SELECT conv_id, turn, lemma_text FROM prepared"),
    **{name: _shown(name) for name in STEPS},
    "typo_fallback": query(MESSAGES, "SELECT word, value FROM typos"),
    "extract_features": query(MESSAGES, "SELECT conv_id, turn, array_to_string(features, ',') AS features "
                                        "FROM featured"),
    "severity_last_cue": query(MESSAGES, "SELECT conv_id, turn, detected_severity AS severity FROM featured"),
    "rule_match": query(TRIAGE, "SELECT conv_id, turn, rule_label FROM matched"),
    "label_choice": query(TRIAGE, "SELECT conv_id, turn, label, round(confidence, 6) AS confidence FROM chosen"),
    "feature_vector": query(
        MESSAGES, f"SELECT conv_id, turn, array_to_string(list_transform({_list(fx.VOCAB)}, lambda v: "
                  "CASE WHEN list_contains(features, v) THEN '1' ELSE '0' END), '') AS vector FROM featured"),
    "suggest_empty": query(
        MESSAGES, f"SELECT conv_id, turn, array_to_string({suggest_sql(fx.POOL_EMPTY, 5)}, ',') AS follow_ups "
                  "FROM featured WHERE len(features) = 0"),
    "suggest_few": query(
        MESSAGES, f"SELECT conv_id, turn, array_to_string({suggest_sql(fx.POOL_FEW, 4)}, ',') AS follow_ups "
                  "FROM featured"),
    "display_name": query(
        MESSAGES + [("exploded", "SELECT unnest(features) AS feature FROM featured")],
        "SELECT feature, count(*) AS n, array_to_string(list_transform(string_split(feature, '_'), lambda p: "
        "upper(p[1]) || lower(p[2:])), ' ') AS title, upper(feature[1]) || replace(feature[2:], '_', ' ') AS raised "
        "FROM exploded GROUP BY feature"),
    "triage": query(
        TRIAGE, "SELECT conv_id, turn, array_to_string(features, ',') AS features, detected_severity, status, message, "
                "top_label, confidence_pct, follow_ups FROM routed"),
    "triage_log_rows": TRIAGE_LOG,
    "dialogue_accumulate": DIALOGUE,
    "dialogue_triage": query(
        DIALOGUE_TRIAGE, "SELECT conv_id, turn, array_to_string(features, ',') AS features, status, top_label, confidence_pct "
                         "FROM routed"),
    "indel_ratio": query(MESSAGES, "SELECT a, b, score FROM scored"),
    "similar_words": query(MESSAGES, f"SELECT a, b, score FROM scored WHERE score >= {fx.FUZZY_CUTOFF}"),
    "fuzzy_best_match": query(_PARTS, "SELECT a, key, score FROM part_names LEFT JOIN part_best USING (a)"),
}
