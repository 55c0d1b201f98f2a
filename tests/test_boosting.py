"""Boosting, tree attribution and the voting bundle against brute force."""
from dataclasses import replace
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidloom.bounds import local_table
from evidloom.operators import boosting as bo
from evidloom.operators import ensemble as en
from evidloom.operators import learning as ln
from evidloom.plans import fixtures as fx
from evidloom.plans import learning_queries as lq

DATA = "/root/testdata/sf0.001"
WORDS = ["a", "b", "c", "d", "e"]


def made_rows(n=400, seed=3):
    """Rows whose label depends on two features and some noise."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 2, (n, len(WORDS)))
    y = np.where(rng.random(n) < 0.1, rng.integers(0, 3, n), x[:, 0] + x[:, 1] * x[:, 2])
    return [(int(k), [float(v) for v in r], int(c), float(c)) for k, (r, c) in enumerate(zip(x, y))]


@pytest.fixture(scope="module")
def train(spark):
    return local_table(spark, made_rows(), "id int, values array<double>, y int, label double")


@pytest.mark.parametrize("cfg", [replace(bo.REGULARISED, rounds=4, depth=3), replace(bo.PLAIN, rounds=4, depth=3, features="all")])
def test_sums_by_spark_and_in_memory_give_the_same_trees(spark, train, cfg, monkeypatch):
    monkeypatch.setattr(bo, "SCORE_ROUNDS", 3)
    near = bo.fit_boosting(train, "values", "y", 3, cfg)
    far = bo.fit_boosting(train.repartition(3), "values", "y", 3, cfg, memory_patterns=0)
    assert (near.trees["feature"] == far.trees["feature"]).all() and (near.trees["feature"] >= 0).any()
    for c in ("value", "gain", "cover"):
        assert np.allclose(near.trees[c], far.trees[c])


@pytest.mark.parametrize("cfg", [bo.REGULARISED, bo.PLAIN])
def test_boosting_learns_and_probabilities_sum_to_one(spark, train, cfg):
    model = bo.fit_boosting(train, "values", "y", 3, cfg)
    got = train.withColumn("p", model.probabilities("values")).collect()
    assert all(abs(sum(r.p) - 1) < 1e-9 for r in got)
    assert np.mean([int(np.argmax(r.p)) == r.y for r in got]) > 0.85


def test_first_tree_by_hand(spark, train):
    """One split of one class: gains of all features recomputed from the rows."""
    cfg = replace(bo.REGULARISED, rounds=1, depth=1)
    model = bo.fit_boosting(train, "values", "y", 3, cfg)
    rows = made_rows()
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    for k in range(3):
        g, h = 1 / 3 - (y == k), np.full(len(y), 2 / 3 * 2 / 3)
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 10)
        gains = [part(x[:, f] > 0) + part(x[:, f] == 0) - part(slice(None)) for f in range(5)]
        assert model.trees["feature"][0, k, 1] == int(np.argmax(gains))
        assert model.trees["gain"][0, k, 1] == pytest.approx(max(gains))
        side = x[:, int(np.argmax(gains))] > 0
        assert model.trees["value"][0, k, 3] == pytest.approx(-g[side].sum() / (h[side].sum() + 10) * cfg.step)


def expectation(model, r, k, row, known, node=1):
    """Value of one tree where only the features in ``known`` are known."""
    t = {c: model.trees[c][r, k] for c in ("feature", "value", "cover")}

    def at(node):
        f = t["feature"][node]
        if f < 0:
            return t["value"][node]
        if f in known:
            return at(2 * node + int(row[f]))
        return sum(t["cover"][2 * node + s] / t["cover"][node] * at(2 * node + s) for s in (0, 1))

    return at(1)


def test_attribution_equals_all_subsets(spark, train):
    model = bo.fit_boosting(train, "values", "y", 3, replace(bo.REGULARISED, rounds=3, min_gain=0.1))
    explain = bo.Attribution(model)
    n = len(WORDS)
    for row in ([0, 0, 0, 0, 0], [1, 0, 1, 1, 0], [1, 1, 1, 0, 1]):
        for k in range(3):
            value = lambda s: sum(expectation(model, r, k, row, s) for r in range(3))  # noqa: E731, B023
            want = [sum(factorial(len(s)) * factorial(n - len(s) - 1) / factorial(n) * (value({*s, j}) - value(set(s)))
                        for m in range(n) for s in combinations([i for i in range(n) if i != j], m)) for j in range(n)]
            got = explain.values(np.array([row]), k)[0]
            assert np.allclose(got, want)
            assert got.sum() == pytest.approx(value(set(range(n))) - explain.expected(k))


def test_attribution_rows(spark, train):
    model = bo.fit_boosting(train, "values", "y", 3, replace(bo.REGULARISED, rounds=5))
    rows = local_table(spark, [(1, [1.0, 0.0, 1.0, 0.0, 0.0], 1), (2, [0.0] * 5, 0), (3, None, 1), (4, [1.0] * 5, None)],
                       "id int, values array<double>, target int")
    out = bo.tree_attribution(rows, model, ["id"], "values", "target", WORDS).collect()
    assert [(r.id, r.rank) for r in sorted(out, key=lambda r: r["rank"])] == [(1, 1), (1, 2)]
    assert {r.feature for r in out} == {"a", "c"}
    assert out[0].impact >= out[1].impact


def test_boosting_of_nothing(spark, train):
    model = bo.fit_boosting(train.limit(0), "values", "y", 2)
    assert train.select(model.probabilities("values").alias("p")).first()["p"] == [0.5, 0.5]


def test_bundle_round_trip_in_a_new_session(spark, tmp_path):
    rows = ln.label_index(fx.feature_matrix(spark, DATA), "label").drop("label_index")
    small = {"plain": replace(bo.PLAIN, rounds=5), "strict": replace(bo.REGULARISED, rounds=5)}
    model = en.fit_voting(rows, "label", fx.FEATURE_WORDS, ["es"], trees=10, **small)
    model.write().overwrite().save(f"{tmp_path}/bundle")
    other = spark.newSession()
    loaded = en.VotingModel.load(f"{tmp_path}/bundle")
    assert (loaded.labels, loaded.vocab, loaded.critical) == (model.labels, fx.FEATURE_WORDS, ["es"])
    votes = lambda m, s: {r.doc_id: (r.vote, [round(v, 9) for v in r.vote_p]) for r in
                          m.transform(fx.feature_matrix(s, DATA)).select("doc_id", "vote", "vote_p").collect()}
    before = votes(model, spark)
    assert before == votes(loaded, other)
    assert len(set(v for v, _ in before.values())) > 1


def test_registered_models_are_of_full_size(spark, monkeypatch):
    seen = []
    fit, forest = bo.fit_boosting, ln.RandomForestClassifier.fit

    def small(train, values, label, classes, cfg=bo.REGULARISED, **more):
        seen.append((cfg.rounds, cfg.depth, cfg.newton))
        return fit(train, values, label, classes, replace(cfg, rounds=1), **more)

    def small_forest(self, df, params=None):
        seen.append((self.getNumTrees(), self.getMaxDepth(), "forest"))
        return forest(self.copy({self.numTrees: 1}), df)

    monkeypatch.setattr(en, "fit_boosting", small)
    monkeypatch.setattr(lq, "fit_boosting", small)
    monkeypatch.setattr(ln.RandomForestClassifier, "fit", small_forest)
    for name in ("rf_predict", "gbt_predict", "reg_predict", "soft_vote", "tree_attribution", "occlusion_impact"):
        lq.QUERIES[name](spark, DATA)
    forests, plain, strict = (150, 8, "forest"), (200, 4, False), (150, 5, True)
    assert sorted(map(str, seen)) == sorted(map(str, [forests, plain, strict, forests, plain, strict, strict, strict]))


def test_voting_scores_members_and_means(spark):
    rows = fx.feature_matrix(spark, DATA)
    model = en.fit_voting(rows, "label", fx.FEATURE_WORDS, [], trees=5, plain=replace(bo.PLAIN, rounds=2), strict=replace(bo.REGULARISED, rounds=2))
    odd = local_table(spark, [(1, None), (2, []), (3, ["the", "unknown"])], "doc_id int, features array<string>")
    for r in model.transform(odd).select("vote", "vote_p", *en.MEMBERS).collect():
        mean = np.mean([r[m] for m in en.MEMBERS], axis=0)
        assert np.allclose(mean, r.vote_p) and r.vote == int(np.argmax(np.round(mean, 15)))
