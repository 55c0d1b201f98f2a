"""Registered queries for batch classification on the document feature matrix, and score functions on embeddings."""
from __future__ import annotations

from dataclasses import replace

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from evidloom import fixed_values as fv
from evidloom.functions import vectors as vc
from evidloom.functions.scalars import display_name
from evidloom.operators import learning as ln
from evidloom.operators.boosting import PLAIN, REGULARISED, fit_boosting, tree_attribution
from evidloom.operators.ensemble import fit_voting
from evidloom.plans import fixtures as fx
from evidloom.plans.sql import has_word, lit, query
from evidloom.session import stored
from evidloom.sources.tables import table


def drop_label(spark, folder):
    return ln.drop_label(fx.feature_matrix(spark, folder), "label", "es").select(
        "doc_id", "label", F.array_join("features", ",").alias("features"))


def label_index(spark, folder):
    return ln.label_index(fx.feature_matrix(spark, folder).select("doc_id", "label"), "label")


def _split(spark, folder):
    return ln.stratified_split(fx.feature_matrix(spark, folder), "doc_id", "label")


def stratified_split(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", F.col("lang").alias("label"))
    return ln.stratified_split(rows, "doc_id", "label")


def drop_noise(spark, folder):
    test = _split(spark, folder).where("is_test")
    return ln.drop_noise(test, "doc_id", "features").select("doc_id", F.array_join("features", ",").alias("features"))


def weighted_metrics(spark, folder):
    rows = fx.feature_matrix(spark, folder)
    return ln.weighted_metrics(rows.withColumn("pred", fx.rule_prediction(F.col("features"))), "label", "pred")


def _prepared(spark, folder):
    """Train and noisy test rows with vectors, written once because fitting reads them many times."""
    rows = ln.label_index(stored(_split(spark, folder), "matrix"), "label")
    noisy = ln.drop_noise(rows.where("is_test"), "doc_id", "features")
    both = rows.where(~F.col("is_test")).unionByName(noisy)
    both = both.withColumn("values", vc.feature_array(F.col("features"), fx.FEATURE_WORDS))
    both = ln.with_vector(both.withColumn("label_index", F.col("label_index").cast("double")), "values")
    return both.where(~F.col("is_test")), both.where("is_test")


def _forest(train):
    model = ln.fit_forest(train)
    return lambda df: model.transform(df).withColumn("forest", vector_to_array("forest_p")).drop(
        "forest_p", "forest_raw", "forest_label")


def _boosted(train, cfg):
    classes = int(train.agg(F.max("label_index")).first()[0]) + 1
    return fit_boosting(train, "values", "label_index", classes, cfg)


def _predicted(df, scores):
    return df.select("doc_id", F.col("label_index").cast("int").alias("label_index"),
                     vc.argmax(F.col(scores)).alias("predicted"))


def rf_predict(spark, folder):
    train, test = _prepared(spark, folder)
    return _predicted(_forest(train)(test), "forest")


def gbt_predict(spark, folder):
    train, test = _prepared(spark, folder)
    return _predicted(test.withColumn("p", _boosted(train, PLAIN).probabilities("values")), "p")


def reg_predict(spark, folder):
    train, test = _prepared(spark, folder)
    return _predicted(test.withColumn("p", _boosted(train, REGULARISED).probabilities("values")), "p")


def soft_vote(spark, folder):
    train, test = _prepared(spark, folder)
    model = fit_voting(train, "label", fx.FEATURE_WORDS, [])
    return _predicted(model.transform(test.drop("values", "vector")), "vote_p")


def _explained(spark, folder):
    """Regularised model, and test rows with the class it finds most likely."""
    train, test = _prepared(spark, folder)
    model = _boosted(train, REGULARISED)
    return model, stored(test.withColumn("target", vc.argmax(model.probabilities("values"))).select("doc_id", "values", "target"), "explained")


def occlusion_impact(spark, folder):
    model, picked = _explained(spark, folder)
    return ln.occlusion_impact(lambda df: df.withColumn("score", model.probabilities("values")), picked, "doc_id", "values",
                               fx.FEATURE_WORDS, "target")


def attribution(spark, folder):
    model, picked = _explained(spark, folder)
    return tree_attribution(picked, model, ["doc_id"], "values", "target", fx.FEATURE_WORDS).withColumn(
        "feature", display_name(F.col("feature")))


# Rounds whose trees are compared node by node with SQL; they do not depend on the rounds after them.
TREE_ROUNDS = 2


def boosted_trees(spark, folder):
    """Every node of the first rounds of the regularised model: split feature, gain, hessian sum and leaf value."""
    train, _ = _prepared(spark, folder)
    nodes = _boosted(train, replace(REGULARISED, rounds=TREE_ROUNDS)).node_table(spark)
    return nodes.select("round", "class", "node", "feature", *[(F.round(c, 6) + 0.0).alias(c) for c in ("gain", "cover", "value")])


def _scores(spark, folder):
    """Class probabilities: squared embedding values over their sum."""
    squares = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    rows = table(spark, folder, "embeddings").select("vec_id", squares.alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn("p", F.transform("s", lambda x: x / total)).drop("s")


def _text(p):
    return F.array_join(F.transform(p, lambda x: F.round(x * 1000000, 0).cast("long").cast("string")), ",")


def softmax_rescale(spark, folder):
    return _scores(spark, folder).select("vec_id", _text(vc.softmax_rescale(F.col("p"))).alias("scores"))


def mask_renorm(spark, folder):
    masked = F.transform("p", lambda x, i: i % 7 == 0)
    rows = _scores(spark, folder).select(
        "vec_id", vc.mask_renorm(F.col("p"), masked, F.col("vec_id") % 2 == 0).alias("r"))
    return rows.select("vec_id", "r.top", F.round("r.confidence", 6).alias("confidence"))


def vote_mean(spark, folder):
    rows = _scores(spark, folder).withColumn("q", F.reverse("p"))
    return ln.soft_vote(rows, ["p", "q"]).select("vec_id", "vote", _text(F.col("vote_p")).alias("scores"))


_ACTIVE = ("list_filter([" + ", ".join(f"CASE WHEN {has_word('lower(text)', w)} THEN {lit(w)} END"
                                       for w in fx.FEATURE_WORDS) + "], lambda x: x IS NOT NULL)")
MATRIX = [("matrix", f"SELECT doc_id, lang AS label, {_ACTIVE} AS features FROM documents")]
SPLIT = MATRIX + [
    ("split", "SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(doc_id || '|42'), doc_id) <= "
              f"round(count(*) OVER (PARTITION BY label) * {fv.SPLIT_TEST_FRACTION}, 0) AS is_test FROM matrix"),
]
_NOISE = SPLIT + [
    ("active", "SELECT doc_id, len(features) AS n, unnest(features) AS f FROM split WHERE is_test"),
    ("ranked", "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5(doc_id || '|' || f || '|42'), f) AS r, "
               "CASE WHEN substr(md5(doc_id || '|42'), 1, 1) IN ('0','2','4','6','8','a','c','e') THEN 1 ELSE 2 END AS k "
               "FROM active"),
    ("kept", "SELECT doc_id, list(f ORDER BY CASE WHEN n > 2 THEN f END, list_position("
             + "[" + ", ".join(lit(w) for w in fx.FEATURE_WORDS) + "], f)) AS f FROM ranked WHERE n <= 2 OR r > k "
             "GROUP BY doc_id"),
]
_PRED = ("CASE " + " ".join(f"WHEN list_contains(features, {lit(w)}) THEN {lit(v)}" for w, v in fx.RULE_LABELS)
         + " ELSE 'en' END")
_METRICS = MATRIX + [
    ("preds", f"SELECT label AS t, {_PRED} AS p FROM matrix"),
    ("classes", "SELECT t AS c FROM preds UNION SELECT p FROM preds"),
    ("per", "SELECT c, count(*) FILTER (t = c AND p = c) AS tp, count(*) FILTER (t = c) AS support, count(*) FILTER "
            "(p = c) AS predicted FROM classes, preds GROUP BY c"),
    ("rates", "SELECT *, coalesce(tp / nullif(predicted, 0), 0.0) AS pr, coalesce(tp / nullif(support, 0), 0.0) AS rc "
              "FROM per"),
    ("f", "SELECT *, coalesce(2 * pr * rc / nullif(pr + rc, 0), 0.0) AS f1 FROM rates"),
]
_P = [("sq", "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE) AS s FROM embeddings"),
      ("probs", "SELECT vec_id, list_transform(s, lambda x: x / list_reduce(s, lambda a, b: a + b)) AS p FROM sq")]
_LONGS = "array_to_string(list_transform({0}, lambda x: round(x * 1000000, 0)::BIGINT::VARCHAR), ',')"

def _tree_sql() -> str:
    """First rounds of second-order boosting, level by level: softmax, sums by node and feature, best split, leaves."""
    cfg = REGULARISED
    words = "[" + ", ".join(lit(w) for w in fx.FEATURE_WORDS) + "]"
    ctes = [f"{n} AS ({b})" for n, b in SPLIT] + [
        f"numbered AS (SELECT *, dense_rank() OVER (ORDER BY label) - 1 AS y FROM split)",
        f"classes AS (SELECT DISTINCT y AS k FROM numbered)",
        f"xs AS (SELECT doc_id, y, features FROM numbered WHERE NOT is_test)",
        f"fs AS (SELECT unnest(range(len({words}))) AS f)",
        f"bits AS (SELECT doc_id, f FROM xs, fs WHERE list_contains(features, {words}[f + 1]))",
        f"score0 AS (SELECT doc_id, k, y, 0.0::DOUBLE AS s FROM xs, classes)",
    ]
    out = []
    for r in range(TREE_ROUNDS):
        ctes += [f"p{r} AS (SELECT doc_id, k, y, s, exp(s) / sum(exp(s)) OVER (PARTITION BY doc_id) AS p FROM score{r})",
                 f"g{r} AS (SELECT doc_id, k, s, p - (y = k)::INT AS g, 2 * p * (1 - p) AS h FROM p{r})",
                 f"at{r}_0 AS (SELECT *, 1 AS node FROM g{r})"]
        for d in range(cfg.depth + 1):
            here = f"at{r}_{d}"
            low = 1 << d
            ctes.append(f"node{r}_{d} AS (SELECT k, node, sum(g) AS g, sum(h) AS h, count(*) AS n FROM {here} WHERE node >= {low} GROUP BY k, node)")
            if d == cfg.depth:
                ctes.append(f"best{r}_{d} AS (SELECT k, node, 0 AS f, 0.0 AS gain FROM node{r}_{d} WHERE false)")
                break
            ctes += [
                f"one{r}_{d} AS (SELECT k, node, f, sum(g) AS g1, sum(h) AS h1, count(*) AS n1 FROM {here} JOIN bits USING (doc_id) "
                f"WHERE node >= {low} GROUP BY k, node, f)",
                f"gain{r}_{d} AS (SELECT k, node, f, round(g1 * g1 / (h1 + {cfg.l2}) + (g - g1) * (g - g1) / (h - h1 + {cfg.l2}) - g * g / "
                f"(h + {cfg.l2}), 9) AS gain FROM one{r}_{d} JOIN node{r}_{d} USING (k, node) WHERE n1 < n AND h1 >= {cfg.min_weight} AND "
                f"h - h1 >= {cfg.min_weight})",
                f"best{r}_{d} AS (SELECT * FROM gain{r}_{d} WHERE gain >= {cfg.min_gain} QUALIFY row_number() OVER (PARTITION BY k, node "
                "ORDER BY gain DESC, f) = 1)",
                f"at{r}_{d + 1} AS (SELECT a.doc_id, a.k, a.s, a.g, a.h, CASE WHEN b.f IS NULL THEN a.node ELSE 2 * a.node + (x.f IS NOT NULL)::INT "
                f"END AS node FROM {here} a LEFT JOIN best{r}_{d} b USING (k, node) LEFT JOIN bits x ON x.doc_id = a.doc_id AND x.f = b.f)"]
        every = " UNION ALL ".join(
            f"SELECT n.k, n.node, coalesce(b.f, -1) AS feature, coalesce(b.gain, 0.0) AS gain, n.h AS cover, CASE WHEN b.f IS NULL THEN -n.g / "
            f"(n.h + {cfg.l2}) * {cfg.step} ELSE 0.0 END AS value FROM node{r}_{d} n LEFT JOIN best{r}_{d} b USING (k, node)"
            for d in range(cfg.depth + 1))
        ctes += [f"tree{r} AS ({every})",
                 f"score{r + 1} AS (SELECT a.doc_id, a.k, p.y, a.s + t.value AS s FROM at{r}_{cfg.depth} a JOIN tree{r} t USING (k, node) "
                 f"JOIN p{r} p USING (doc_id, k))"]
        out.append(f"SELECT {r} AS round, k AS class, node, feature, round(gain, 6) + 0.0 AS gain, round(cover, 6) + 0.0 AS cover, round(value, 6) + 0.0 AS value FROM tree{r}")
    return "WITH " + ",\n".join(ctes) + "\n" + " UNION ALL ".join(out)


QUERIES = {
    "drop_label": drop_label,
    "label_index": label_index,
    "stratified_split": stratified_split,
    "drop_noise": drop_noise,
    "weighted_metrics": weighted_metrics,
    "rf_predict": rf_predict,
    "gbt_predict": gbt_predict,
    "reg_predict": reg_predict,
    "soft_vote": soft_vote,
    "occlusion_impact": occlusion_impact,
    "tree_attribution": attribution,
    "boosted_trees": boosted_trees,
    "softmax_rescale": softmax_rescale,
    "mask_renorm": mask_renorm,
    "vote_mean": vote_mean,
}
ORACLE = {
    "boosted_trees": _tree_sql(),
    "drop_label": query(MATRIX, "SELECT doc_id, label, array_to_string(features, ',') AS features FROM matrix WHERE "
                                "label IS DISTINCT FROM 'es'"),
    "label_index": "SELECT doc_id, lang AS label, dense_rank() OVER (ORDER BY lang) - 1 AS label_index FROM documents",
    "stratified_split": query(SPLIT, "SELECT doc_id, label, is_test FROM split"),
    "drop_noise": query(_NOISE, "SELECT s.doc_id, coalesce(array_to_string(k.f, ','), '') AS features FROM split s LEFT "
                                "JOIN kept k USING (doc_id) WHERE s.is_test"),
    "weighted_metrics": query(
        _METRICS, "SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(sum(pr * support) / sum(support), 6) AS "
                  "precision, round(sum(rc * support) / sum(support), 6) AS recall, round(sum(f1 * support) / "
                  "sum(support), 6) AS f1 FROM f"),
    "softmax_rescale": query(
        _P + [("e", "SELECT vec_id, list_transform(p, lambda x: exp(x)) AS e FROM probs"),
              ("r", "SELECT vec_id, list_transform(e, lambda x: x / list_reduce(e, lambda a, b: a + b)) AS r FROM e")],
        f"SELECT vec_id, {_LONGS.format('r')} AS scores FROM r"),
    "mask_renorm": query(
        _P + [("m", "SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN list_transform(p, lambda x, i: CASE WHEN (i - 1) % 7 = "
                    "0 THEN 0.0 ELSE x END) ELSE p END AS q FROM probs")],
        "SELECT vec_id, list_position(q, list_max(q)) - 1 AS top, round(CASE WHEN vec_id % 2 = 0 THEN list_max(q) / "
        "(list_reduce(q, lambda a, b: a + b) + 1e-9) ELSE list_max(q) END, 6) AS confidence FROM m"),
    "vote_mean": query(
        _P + [("m", "SELECT vec_id, list_transform(p, lambda x, i: (x + p[len(p) - i + 1]) / 2.0) AS v FROM probs")],
        f"SELECT vec_id, list_position(v, list_max(v)) - 1 AS vote, {_LONGS.format('v')} AS scores FROM m"),
}
