"""Large lexicons: the automaton against the literal plan and against Python, and its plan."""
import random

import pytest
from pyspark.sql import functions as F

from evidloom.bounds import local_table
from evidloom.operators import features as ft
from evidloom.operators import scanning
from evidloom.operators.matching import match_terms
from evidloom.plans import fixtures as fx

DATA = "/root/testdata/sf0.001"
TEXTS = ["the sore throat, sorethroat", "throat", "éclair_x sore", "", None, "a-b a.b ab", "sore", "über sore\nthroat", "x" * 100_000 + " sore"]
TERMS = ["sore", "Throat", "sore throat", "ab", "a", "éclair", "über", "zz", "-", "a.b", ""]


@pytest.fixture(scope="module")
def texts(spark):
    return local_table(spark, list(enumerate(TEXTS)), "id int, low string")


@pytest.mark.parametrize("mode", ["substring", "word"])
def test_automaton_equals_literals(spark, texts, mode):
    terms = [t for t in TERMS if t or mode == "substring"]
    lexicon = local_table(spark, list(enumerate(terms)), "ord int, term string")
    results = []
    for rows in (200, 0):
        out = match_terms(texts, ["id"], "low", lexicon, "term", "ord", mode, "found", literal_rows=rows)
        results.append({r.id: list(r.found or []) for r in out.collect()})
    assert results[0] == results[1]
    assert results[1][2] == (["sore", "a", "éclair", ""] if mode == "substring" else ["sore"])


def test_twenty_thousand_entries_in_several_parts(spark, monkeypatch):
    """Equal rows for one automaton and for seven, and equal to Python."""
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(3, 8))) for _ in range(40_000)})[:20_000]
    texts = [" ".join(rng.choice(words) if rng.random() < 0.5 else "".join(rng.choice("abcdef") for _ in range(9)) for _ in range(30)) for _ in range(60)]
    lexicon = local_table(spark, [(w, [f"f{k % 50}", "all"]) for k, w in enumerate(words)], "entry string, features array<string>")
    df = local_table(spark, list(enumerate(texts)), "id int, low string")
    features = dict(zip(words, (k % 50 for k in range(len(words)))))
    want = {k: sorted({f"f{features[w]}" for w in words if w in t} | {"all"}) for k, t in enumerate(texts)}
    for size in (scanning.PART_ROWS, 3_000):
        monkeypatch.setattr(scanning, "PART_ROWS", size)
        out = ft.lexicon_features(df, ["id"], "low", lexicon, "features", literal_rows=200)
        assert {r.id: sorted(r.features) for r in out.collect()} == want
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Generate" not in plan and plan.count("ArrowEvalPython") == -(-len(words) // size)


def test_all_lexicon_steps_agree_for_both_plans(spark):
    messages = fx.user_messages(spark, DATA)
    found = []
    for rows in (200, 0):
        lex = fx.intake_lexicon(spark, literal_rows=200)
        lex.literal_rows = 200
        prepared = ft.prepare_messages(messages, fx.MESSAGE_KEYS, lex)
        lex.literal_rows = rows
        steps = {}
        for name in ("phrase_features", "keyword_features", "cooc_features", "vocab_features"):
            out = getattr(ft, name)(prepared, fx.MESSAGE_KEYS, lex)
            steps[name] = {(r.conv_id, r.turn): sorted(r[name]) for r in out.select(*fx.MESSAGE_KEYS, name).collect()}
        found.append(steps)
    assert found[0] == found[1] and any(found[0]["cooc_features"].values())


def test_null_entries_and_features(spark):
    lexicon = local_table(spark, [("sore", None), (None, ["x"]), ("throat", ["t", "s"])], "entry string, features array<string>")
    df = local_table(spark, [(1, "sore throat"), (2, None)], "id int, low string")
    out = ft.lexicon_features(df, ["id"], "low", lexicon, "f", literal_rows=0)
    assert {r.id: r.f for r in out.collect()} == {1: ["s", "t"], 2: []}


def test_empty_lexicon(spark):
    lexicon = local_table(spark, [], "entry string, features array<string>")
    lexicon.__dict__.pop("_known_rows", None)
    df = local_table(spark, [(1, "sore")], "id int, low string")
    named = F.array(F.struct(F.lit(0).cast("long").alias("ord"), F.col("entry").alias("value")))
    assert df.select(scanning.occurring("low", lexicon.select("entry", named.alias("f")), "entry", "f").alias("x")).first()["x"] == []
