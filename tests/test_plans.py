"""The plan for large lexicons gives the same rows as the literal plan, and operators match brute force."""
import random
import re

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from evidloom.bounds import broadcast_if_small, local_table
from evidloom.fixed_values import DEFAULT_REMEDIES
from evidloom.functions import similarity as sim
from evidloom.functions.lexicon import has_word_term
from evidloom.functions.text import normalize_whitespace
from evidloom.operators import commerce as cm
from evidloom.operators import corpus, features as ft
from evidloom.operators import learning as ln
from evidloom.operators import lookup as lk
from evidloom.operators import triage as tr
from evidloom.operators.evidence import filter_entities
from evidloom.operators.matching import match_terms
from evidloom.operators.profile import PatientDims
from evidloom.operators.rules import rule_match
from evidloom.operators.similar import fuzzy_best_match, similar_pairs
from evidloom.plans import fixtures as fx
from evidloom.plans.registry import QUERIES


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("mode", ["substring", "word"])
def test_indexed_matching_equals_literals(spark, mode):
    sents = fx.document_sentences(spark, DATA)
    lexicon = fx.ordered(spark, fx.TERMS + ["o", "que les", "et la", "."], "term")
    args = (sents, ["doc_id", "sent_ord"], "low", lexicon, "term", "term_ord", mode, "found")
    literal, indexed = match_terms(*args), match_terms(*args, literal_rows=1)
    keep = ["doc_id", "sent_ord", "found"]
    got = rows(literal.select(*keep))
    assert got == rows(indexed.select(*keep)) and any("que les" in r for r in got)


def test_features_with_large_lexicons_equal_literals(spark):
    messages = fx.user_messages(spark, DATA)
    small = ft.extract_features(messages, fx.MESSAGE_KEYS, fx.intake_lexicon(spark))
    large = ft.extract_features(messages, fx.MESSAGE_KEYS, fx.intake_lexicon(spark, literal_rows=1, hit_rows=1))
    keep = [*fx.MESSAGE_KEYS, "features", "detected_severity"]
    assert rows(small.select(*keep)) == rows(large.select(*keep))
    vocab = set(fx.VOCAB)
    assert all(set(r.features) <= vocab for r in small.collect())


def lcs(a, b):
    prev = [0] * (len(b) + 1)
    for c in a:
        row = [0]
        for j, d in enumerate(b):
            row.append(prev[j] + 1 if c == d else max(prev[j + 1], row[j]))
        prev = row
    return prev[-1]


def ratio(a, b):
    return round(200 * lcs(a, b) / (len(a) + len(b))) if a or b else 100


def random_words(n, seed, longest=12):
    r = random.Random(seed)
    return sorted({"".join(r.choice("abcdé") for _ in range(r.randint(1, longest))) for _ in range(n)})


def test_indel_ratio_equals_table(spark):
    r = random.Random(1)
    pairs = [(a, b) for a, b in zip(random_words(200, 2), random_words(200, 3))]
    pairs += [("", ""), ("", "abc"), ("x" * 80, "xy" * 50), ("ab" * 40, "abc")]
    pairs += [("".join(r.choice("ab") for _ in range(62)), "".join(r.choice("ab") for _ in range(n))) for n in (61, 62, 63, 90)]
    df = local_table(spark, pairs, "a string, b string").withColumn("s", sim.indel_ratio("a", "b"))
    df = df.withColumn("t", sim.indel_ratio("b", "a"))
    for row in df.collect():
        assert row.s == row.t == ratio(row.a, row.b), row


@pytest.mark.parametrize("cutoff", [50, 70, 85])
def test_similar_pairs_miss_nothing(spark, cutoff):
    left, right = random_words(150, 4), random_words(60, 5)
    want = sorted((a, b, ratio(a, b)) for a in left for b in right if ratio(a, b) >= cutoff)
    a = local_table(spark, [(x,) for x in left], "a string")
    b = local_table(spark, [(x,) for x in right], "b string")
    for limit in (1000, 1):
        got = sorted(tuple(r) for r in similar_pairs(a, b, cutoff, literal_rows=limit).select("a", "b", "score").collect())
        assert got == want


def test_weighted_ratio():
    value = sim.weighted_ratio_value
    assert value("New York!", "new york") == 100
    assert value("york new", "new york") == 95
    assert value("yankees", "new york yankees") == 90
    assert value("", "a") == 0 and value(None, "a") == 0
    assert value("legpains", "leg_pain") >= 85
    assert value("abc", "xyz") == 0


def test_weighted_plans_agree(spark):
    a = local_table(spark, [("fungal infectn",), ("acne",), ("zzz",)], "a string")
    keys = fx.ordered(spark, ["Acne", "Fungal infection", "Fungus"], "key")
    small = fuzzy_best_match(a, keys, 70, "weighted")
    assert rows(small) == rows(fuzzy_best_match(a, keys, 70, "weighted", literal_rows=1))
    assert {r.a: r.key for r in small.collect()} == {"fungal infectn": "Fungal infection", "acne": "Acne", "zzz": None}


def test_rules_equal_brute_force(spark):
    r = random.Random(7)
    sets = [sorted(r.sample("abcdefg", r.randint(0, 6))) for _ in range(150)]
    rules = [(i, f"L{i}", sorted(r.sample("abcdefg", r.randint(1, 5)))) for i in range(25)]
    table = local_table(spark, rules, "rule_ord int, label string, feats array<string>")
    df = local_table(spark, list(enumerate(sets)), "id int, features array<string>")

    def first(have):
        if not have:
            return None
        return next((n for _, n, f in rules if set(f) <= set(have) and len(have) <= len(f) + 1), None)

    for limit in (200, 1):
        got = {x.id: x.rule_label for x in rule_match(df, table, ["id"], literal_rows=limit).collect()}
        assert got == {i: first(s) for i, s in enumerate(sets)}


def test_earlier_rule_wins(spark):
    rules = local_table(spark, [(0, "Malaria", ["a", "b", "c", "d"]), (1, "Typhoid", ["a", "b", "c", "e"])],
                        "rule_ord int, label string, feats array<string>")
    df = local_table(spark, [(1, ["a", "b", "c", "d", "e"])], "id int, features array<string>")
    assert rule_match(df, rules, ["id"]).first().rule_label == "Malaria"


def test_cart_adjust_with_one_hot_key(spark):
    r = random.Random(3)
    steps = [(1 if r.random() < 0.6 else r.randint(2, 5), i, r.choice([-2, -1, 1, 1])) for i in range(600)]
    want = {}
    for key in {k for k, _, _ in steps}:
        q = 0
        for k, _, d in steps:
            q = max(0, q + d) if k == key else q
        if q > 0:
            want[key] = q
    df = local_table(spark, steps, "k int, at long, delta long")
    for block in (1, 7, 1000):
        out = cm.cart_adjust(df, ["k"], ["at"], F.floor(F.col("at") / block))
        assert {x.k: x.qty for x in out.collect()} == want


def said(texts):
    texts = [t for t in texts if t is not None]
    return "".join(texts[:1] + [f". I also have {t.replace('_', ' ')}." for t in texts[1:]])


def test_dialogue_over_many_blocks(spark):
    turns = [(c, t, f"{c}.{t}" if t % 5 else "") for c, n in ((1, 60), (2, 1), (3, 7)) for t in range(n)]
    df = local_table(spark, turns, "conv_id long, turn long, text string")
    for block in (1, 4, 512):
        out = tr.dialogue_accumulate(df, "conv_id", "turn", block=block).collect()
        for r in out:
            assert r.dialogue == said([x for c, t, x in turns if c == r.conv_id and t <= r.turn])
        assert len(out) == len(turns)


def test_split_is_exact_per_label(spark):
    rows_ = [(i, "hot" if i % 3 else f"l{i % 7}") for i in range(900)] + [(1000, "one"), (1001, None), (1002, None)]
    out = ln.stratified_split(local_table(spark, rows_, "id long, label string"), "id", "label", prefix=1).collect()
    assert len(out) == len(rows_)
    count = {}
    for r in out:
        n, t = count.get(r.label, (0, 0))
        count[r.label] = (n + 1, t + r.is_test)
    assert all(t == int(n * 0.2 + 0.5) for n, t in count.values())


def test_noise_drops_one_or_two(spark):
    df = fx.feature_matrix(spark, DATA)
    out = ln.drop_noise(df.withColumn("before", F.col("features")), "doc_id", "features").collect()
    lost = {len(r.before) - len(r.features) for r in out if len(r.before) > 2}
    assert lost == {1, 2}
    assert all(r.before == r.features for r in out if len(r.before) <= 2)


def test_fallback_is_sequential(spark):
    r = random.Random(11)
    topics = [f"t{i}x" for i in range(8)]
    word = lambda: r.choice(topics + ["none"] * 3)
    base = [(0, "u0", "t1x only"), (1, "u1", "nothing")]
    pool = [(t, k, f"u{r.randint(0, 12)}", " ".join(word() for _ in range(r.randint(0, 3))) + "." * r.choice([0, 10]))
            for t in range(8) for k in range(9)]
    got = corpus.fallback_candidates(
        local_table(spark, base, "id long, url string, text string"),
        local_table(spark, pool, "topic_ord int, rank long, url string, text string"),
        local_table(spark, list(enumerate(topics)), "topic_ord int, topic string"), ["id"], min_chars=10).collect()
    tried, texts, want = {u for _, u, _ in base}, [x for _, _, x in base], set()
    for t, name in enumerate(topics):
        if any(name in x for x in texts):
            continue
        for _, k, url, text in sorted(p for p in pool if p[0] == t)[:5]:
            if url in tried:
                continue
            tried.add(url)
            if len(text) >= 10:
                texts.append(text)
                want.add((t, k, url))
    assert {(x.topic_ord, x.rank, x.url) for x in got} == want and want


def test_register_within_batch(spark):
    new = local_table(spark, [(1, "a"), (2, "a"), (3, "b"), (4, "c")], "id int, name string")
    known = local_table(spark, [("b",), ("b",)], "name string")
    assert rows(lk.register_new(new, known, "name", "id").select("id")) == ["Row(id=1)", "Row(id=4)"]


def test_lookup_keeps_every_request(spark):
    kb = lk.eligibility_matrix(fx.remedy_table(spark, DATA))
    requests = fx.remedy_requests(spark, DATA)
    out = lk.kb_lookup_fallback(requests, kb)
    assert out.select("c_custkey").distinct().count() == requests.count()
    assert {r.match_level for r in out.select("match_level").distinct().collect()} == {"exact", "first", "default"}


def test_eligibility_without_a_join(spark):
    """Exploded rows look small to the planner, so a join of them was broadcast whatever their number."""
    some = [(None, 0, "n", None, None, None), ("a", 1, "x", "null", ["all"], ["low"]), ("a", 2, "y", " Young ", [" MALE", None], None),
            ("b", 3, "z", None, [], ["high"]), ("c", 4, "v", '["All"]', None, ["medium", "low"]), ("c", 4, "v", '["All"]', None, ["low"])]
    rules = local_table(spark, some, "topic string, remedy_ord long, medicine_name string, allowed_ages string, "
                                     "allowed_genders array<string>, allowed_severities array<string>")
    items = lambda v: None if v is None else [] if v == "null" else [x.strip().lower() for x in (
        v if isinstance(v, list) else [v.strip('[]"')]) if x]
    fits = lambda v, x: items(v) is None or "all" in items(v) or x in items(v)
    want = []
    for topic in [None, "a", "b", "c"]:
        for i, (age, gender, severity) in enumerate(PatientDims().combos()):
            found = [(r[1], r[2]) for r in some if r[0] == topic and topic and fits(r[3], age) and fits(r[4], gender)
                     and fits(r[5], severity)]
            want += [(topic, age, gender, severity, i, *f) for f in found or [(None, None)]]
    out = lk.eligibility_matrix(rules)
    assert out.columns == [*lk.BUCKET, "combo_ord", "remedy_ord", "medicine_name"]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_fallback_shuffles_a_large_kb(spark):
    """More filled buckets than are broadcast after counting are not broadcast on the planner's guess either."""
    rules = spark.range(50_000).select(F.concat(F.lit("t"), F.floor(F.col("id") / 2)).alias("topic"), F.col("id").alias("remedy_ord"),
                                       F.concat(F.lit("m"), "id").alias("medicine_name"), F.lit("d").alias("dosage"),
                                       *[F.lit(None).cast("array<string>").alias(f"allowed_{c}") for c in ("ages", "genders", "severities")])
    requests = spark.range(0, 50_000, 2000).select("id", F.concat(F.lit("t"), "id").alias("topic"), F.lit("young").alias("age_group"),
                                                   F.lit("male").alias("gender"), F.lit("low").alias("severity"))
    out = lk.kb_lookup_fallback(requests, lk.eligibility_matrix(rules))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.id, r.match_level, r.remedy_ord, r.medicine_name) for r in out.collect()}
    assert got == {(i, "exact", 2 * i + k, f"m{2 * i + k}") for i in range(0, 25_000, 2000) for k in (0, 1)} | {
        (i, "default", k, n) for i in range(26_000, 50_000, 2000) for k, (n, _) in enumerate(DEFAULT_REMEDIES)}
    wide = spark.range(25_000).withColumn("v", F.sequence(F.lit(0), F.lit(40)))
    joined = spark.range(25_000).join(broadcast_if_small(wide), "id")
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


def test_profile_is_computed_once_for_the_stored_kb(spark, monkeypatch):
    from evidloom.sources import stores

    given, write = [], stores.write_kb
    monkeypatch.setattr(stores, "write_kb", lambda kb, profile, path: (given.extend([kb, profile]), write(kb, profile, path)))
    assert QUERIES["stored_recommend"](spark, DATA).count() > 0
    assert len(given) == 2 and not any("documents.parquet" in f for df in given for f in df.inputFiles())


def test_sentences_are_split_once_for_entities(spark):
    shown = QUERIES["extractions_with_entities"](spark, DATA)
    assert shown.inputFiles() and not any("documents.parquet" in f for f in shown.inputFiles())


def test_white_space_and_entity_words(spark):
    r = random.Random(4)
    parts = ["a", "é", "b!", " ", " ", "  ", "\t", "\n", "\x1c", "\x85", "\xa0", "\u1680", "\u200a", "\u2028", "\u202f", "\u205f", "\u3000", "\u200b"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(400)]
    spaces = "[\t-\r \x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
    clean = local_table(spark, list(enumerate([*texts, None])), "i int, t string").select("i", normalize_whitespace(F.col("t")).alias("n"))
    assert {x.i: x.n for x in clean.collect()} == {i: re.sub(spaces, " ", t).strip(" ") for i, t in enumerate(texts)} | {400: None}
    words = [(1, " Abc ", 0.65), (1, "abc", 0.9), (1, "ab", 1.0), (1, "naïf", 1.0), (1, "xyz", 0.64), (2, "xyz", None), (None, "nul", 1.0)]
    found = filter_entities(local_table(spark, words, "k int, word string, score double"), ["k"])
    assert {(x.k, *x.entity_terms) for x in found.collect()} == {(1, "abc"), (None, "nul")}
    low = local_table(spark, [("it was so",), ("washed",), ("",), (None,)], "low string")
    assert [x[0] for x in low.select(has_word_term(F.col("low"), ["was", "are"])).collect()] == [True, False, False, None]


def test_model_round_trip_and_majority(spark, tmp_path):
    from pyspark.ml.functions import vector_to_array

    from evidloom.functions import vectors as vc

    df = ln.label_index(fx.feature_matrix(spark, DATA), "label").withColumn("label_index", F.col("label_index").cast("double"))
    df = ln.with_vector(df.withColumn("values", vc.feature_array(F.col("features"), fx.FEATURE_WORDS)), "values")
    model = ln.fit_forest(df, trees=10)
    ln.save_model(model, f"{tmp_path}/m")
    loaded = ln.load_model(f"{tmp_path}/m")
    scored = loaded.transform(df).withColumn("p", vc.argmax(vector_to_array("forest_p")))
    hits = scored.agg(F.avg((F.col("p") == F.col("label_index")).cast("double"))).first()[0]
    majority = df.groupBy("label").count().agg(F.max("count") / F.sum("count")).first()[0]
    assert hits > majority


def test_dialogue_stream_keeps_state_over_batches(spark, tmp_path):
    from evidloom.streaming.feeds import dialogue_stream

    turns = [(c, t, f"{c}-{t}") for t in range(3) for c in range(4)]
    for t in range(3):
        local_table(spark, [x for x in turns if x[1] == t], "conv_id long, turn long, text string").coalesce(1).write.mode(
            "append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("conv_id long, turn long, text string").option("maxFilesPerTrigger", 1).parquet(
        f"{tmp_path}/in")
    query = dialogue_stream(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
        "checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").where("turn = 2").collect()
    assert len(got) == 4
    assert all(r.dialogue == said([f"{r.conv_id}-{t}" for t in range(3)]) for r in got)


def test_dialogue_stream_of_late_and_empty_turns(spark, tmp_path):
    from evidloom.streaming.feeds import dialogue_stream

    batches = [[(1, 0, None), (1, 2, "sore_throat"), (2, 5, "x")], [(1, 1, "too late"), (1, 3, "high_fever"), (2, 6, None)]]
    for rows_of_batch in batches:
        local_table(spark, rows_of_batch, "conv_id long, turn long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("conv_id long, turn long, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = dialogue_stream(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
        "checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.conv_id, r.turn): (r.dialogue, r.late) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got[1, 0] == ("", False) and got[1, 2] == ("sore_throat", False) and got[1, 1] == (None, True)
    assert got[1, 3] == ("sore_throat. I also have high fever.", False)
    assert got[2, 5] == got[2, 6] == ("x", False)


def test_registered_plans_have_no_cross_join(spark):
    from evidloom.plans.registry import QUERIES

    for name in ("topic_profile", "eligibility_matrix", "kb_flat", "relaxed_lookup", "fuzzy_best_match", "cart_adjust"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_model_scores_only_rows_without_a_rule(spark):
    """Label, confidence and contributions of the ensemble, recomputed from its members in numpy."""
    from dataclasses import replace

    import numpy as np

    from evidloom.operators import boosting as bo
    from evidloom.operators.ensemble import fit_voting

    messages = fx.user_messages(spark, DATA)
    lex, rules = fx.intake_lexicon(spark), fx.rules_table(spark)
    found = rule_match(ft.extract_features(messages, fx.MESSAGE_KEYS, lex), rules, fx.MESSAGE_KEYS).where("rule_label is not null")
    model = fit_voting(found, "rule_label", fx.VOCAB, fx.CRITICAL, trees=5, plain=replace(bo.PLAIN, rounds=3), strict=replace(bo.REGULARISED, rounds=9))
    seen = []
    transform = model.transform

    def spy(df):
        seen.append(df.count())
        return transform(df)

    model.transform = spy
    out = tr.triage_with_model(messages, fx.MESSAGE_KEYS, lex, rules, fx.triage_config(), model).collect()
    assert len(out) == messages.count()
    open_rows = [r for r in out if r.rule_label is None and r.features]
    assert seen == [len(open_rows)] and 0 < len(open_rows) < len(out)
    votes = {(r.conv_id, r.turn): np.array(r.vote_p) for r in transform(messages.sparkSession.createDataFrame(
        [(r.conv_id, r.turn, r.features) for r in open_rows], "conv_id long, turn long, features array<string>")).collect()}
    explain = bo.Attribution(model.strict)
    for r in out:
        if r.rule_label is not None:
            assert (r.label, r.confidence, r.contributions) == (r.rule_label, 0.98, None)
        elif not r.features:
            assert r.label is None and r.contributions is None
        else:
            p = np.exp(votes[r.conv_id, r.turn])
            p = p / p.sum()
            if r.is_final_check:
                p[[k for k, name in enumerate(model.labels) if name in fx.CRITICAL]] = 0
            k = int(np.argmax(np.round(p, 15)))
            assert r.label == model.labels[k] and r.confidence == pytest.approx(p[k] / (p.sum() + 1e-9) if r.is_final_check else p[k])
            x = np.array([[int(v in r.features) for v in fx.VOCAB]])
            shares = explain.values(x, k)[0]
            assert sorted(c.impact_score for c in r.contributions) == pytest.approx(sorted(round(shares[i], 4) for i in np.flatnonzero(x[0])), abs=1.1e-4)
            assert [c.impact_score for c in r.contributions] == sorted((c.impact_score for c in r.contributions), reverse=True)
