"""Batch classification: encoding, exact stratified split, noise, ensemble, metrics, attribution."""
from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidloom import fixed_values as fv
from evidloom.bounds import broadcast_if_small
from evidloom.functions.vectors import argmax, mean_scores


def drop_label(df: DataFrame, label: str, unwanted: str) -> DataFrame:
    """Rows of the other labels; rows without a label stay."""
    return df.where(~F.col(label).eqNullSafe(unwanted))


def label_indexer(df: DataFrame, label: str, out: str = "label_index"):
    return StringIndexer(inputCol=label, outputCol=out, stringOrderType="alphabetAsc").fit(df)


def label_index(df: DataFrame, label: str, out: str = "label_index") -> DataFrame:
    """Add the alphabetical index of the label."""
    return label_indexer(df, label, out).transform(df).withColumn(out, F.col(out).cast("int"))


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def stratified_split(df: DataFrame, key: str, label: str, fraction: float = fv.SPLIT_TEST_FRACTION,
                     seed: int = fv.SPLIT_SEED, prefix: int = 3) -> DataFrame:
    """Add ``is_test``: exactly round(fraction * n) rows of every label, those with the smallest seeded hash of the key.

    The cut per label is found from a histogram over the first ``prefix`` hash digits (16 ** prefix bins) and a ranking
    of the one bin that holds it. The result is one threshold per label, so the rows themselves are marked in place: no
    label is sorted or shuffled as a whole, however common it is.
    """
    hashed = _hash(F.col(key).cast("string"), F.lit(str(seed)))
    slim = df.select(F.col(label).alias("_label"), F.col(key).alias("_key"), hashed.alias("_h")).withColumn(
        "_bin", F.substring("_h", 1, prefix))
    bins = slim.groupBy("_label", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    by_label = Window.partitionBy("_label")
    running = by_label.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("_upto", F.sum("_n").over(running)).withColumn(
        "_cut", F.round(F.sum("_n").over(by_label) * F.lit(fraction), 0).cast("long"))
    cuts = bins.where((F.col("_upto") >= F.col("_cut")) & (F.col("_upto") - F.col("_n") < F.col("_cut"))).select(
        F.col("_label").alias("_l"), F.col("_bin").alias("_b"),
        (F.col("_cut") - F.col("_upto") + F.col("_n")).alias("_take"))
    edge = slim.join(broadcast_if_small(cuts), F.col("_label").eqNullSafe(F.col("_l")) & (F.col("_bin") == F.col("_b")))
    rank = F.row_number().over(Window.partitionBy("_label", "_bin").orderBy("_h", "_key"))
    last = edge.withColumn("_r", rank).where(F.col("_r") == F.col("_take")).select(
        "_l", F.struct("_h", "_key").alias("_last"))
    marked = df.join(broadcast_if_small(last), F.col(label).eqNullSafe(F.col("_l")), "left")
    test = F.struct(hashed.alias("_h"), F.col(key).alias("_key")) <= F.col("_last")
    return marked.withColumn("is_test", F.coalesce(test, F.lit(False))).drop("_l", "_last")


def drop_noise(df: DataFrame, key: str, features: str, seed: int = fv.SPLIT_SEED, keep_up_to: int = 2) -> DataFrame:
    """Rows with more than ``keep_up_to`` active features (an array of names) lose one or two of them.

    Order and number follow from seeded hashes of the key and the feature, inside the row: nothing is shuffled.
    """
    row = F.col(key).cast("string")
    ranked = F.array_sort(F.transform(
        features, lambda f: F.named_struct(F.lit("h"), _hash(row, f, F.lit(str(seed))), F.lit("f"), f)))
    first = F.substring(_hash(row, F.lit(str(seed))), 1, 1)
    count = F.when(first.isin(*"02468ace"), 1).otherwise(2)
    kept = F.transform(F.slice(ranked, count + 1, F.size(features)), lambda s: s["f"])
    return df.withColumn(features, F.when(F.size(features) > keep_up_to, F.array_sort(kept)).otherwise(
        F.col(features)))


def with_vector(df: DataFrame, values: str, out: str = "vector") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(values)))


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Add the balanced class weight n / (classes * class count)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    whole = counts.agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_k"))
    counts = counts.join(F.broadcast(whole)).select(label, (F.col("_n") / (F.col("_k") * F.col("_c"))).alias(out))
    return df.join(broadcast_if_small(counts), label)


def fit_forest(train: DataFrame, label: str = "label_index", features: str = "vector", trees: int = 150,
               depth: int = 8, min_leaf: int = 5, seed: int = fv.SPLIT_SEED) -> PipelineModel:
    """Random forest with balanced class weights."""
    forest = RandomForestClassifier(
        labelCol=label, featuresCol=features, weightCol="weight", numTrees=trees, maxDepth=depth,
        minInstancesPerNode=min_leaf, seed=seed, probabilityCol="forest_p", rawPredictionCol="forest_raw",
        predictionCol="forest_label")
    return Pipeline(stages=[forest]).fit(class_weights(train, label))


def soft_vote(df: DataFrame, members: list[str], out: str = "vote") -> DataFrame:
    """Add the mean of the members' class probabilities and its first largest class."""
    scored = df.withColumn(f"{out}_p", mean_scores([F.col(m) for m in members]))
    return scored.withColumn(out, argmax(F.col(f"{out}_p")))


def weighted_metrics(preds: DataFrame, label: str, pred: str) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 (0 where undefined), from one confusion count."""
    cells = preds.groupBy(F.col(label).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(zero)
    sides = cells.select(F.explode(F.array(
        F.struct(F.col("t").alias("c"), hit.alias("tp"), F.col("n").alias("support"), zero.alias("predicted")),
        F.struct(F.col("p").alias("c"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("predicted")),
    )).alias("s")).select("s.*")
    per = sides.groupBy("c").agg(*[F.sum(x).alias(x) for x in ("tp", "support", "predicted")])
    tp = F.col("tp").cast("double")
    prec = F.coalesce(tp / F.nullif(F.col("predicted"), F.lit(0)), F.lit(0.0))
    rec = F.coalesce(tp / F.nullif(F.col("support"), F.lit(0)), F.lit(0.0))
    per = per.withColumn("prec", prec).withColumn("rec", rec).withColumn(
        "f1", F.coalesce(2 * F.col("prec") * F.col("rec") / F.nullif(F.col("prec") + F.col("rec"), F.lit(0.0)),
                         F.lit(0.0)))
    n = F.sum("support")
    return per.agg(
        F.round(F.sum("tp") / n, 6).alias("accuracy"),
        *[F.round(F.sum(F.col(c) * F.col("support")) / n, 6).alias(name)
          for c, name in (("prec", "precision"), ("rec", "recall"), ("f1", "f1"))])


def occlusion_impact(score, df: DataFrame, key: str, values: str, vocab: list[str], target: str,
                     vector: str = "vector") -> DataFrame:
    """Impact of every active feature on the score of the ``target`` class: score with it minus score without it.

    ``score`` adds an array column ``score`` to rows with a feature vector. All masked copies of a row are scored in
    one pass. This is occlusion, not a Shapley value. One row per key and active feature, ``rank`` 1 for the largest.
    """
    places = F.filter(F.sequence(F.lit(0), F.lit(len(vocab) - 1)), lambda i: F.get(F.col(values), i) > 0)
    copies = df.select(key, target, values, F.explode(F.concat(F.array(F.lit(-1)), places)).alias("_masked"))
    copies = copies.withColumn(values, F.transform(
        values, lambda v, i: F.when(i == F.col("_masked"), F.lit(0.0)).otherwise(v)))
    scored = score(with_vector(copies, values, vector)).select(
        key, "_masked", F.get("score", F.col(target)).alias("_s"))
    packed = scored.groupBy(key).agg(
        F.max(F.when(F.col("_masked") < 0, F.col("_s"))).alias("_full"),
        F.collect_list(F.when(F.col("_masked") >= 0, F.struct("_masked", "_s"))).alias("_parts"))
    name = F.get(F.array(*[F.lit(v) for v in vocab]), F.col("_p._masked"))
    out = packed.select(key, "_full", F.explode("_parts").alias("_p")).select(
        key, name.alias("feature"), F.round(F.col("_full") - F.col("_p._s"), 4).alias("impact"))
    return out.withColumn("rank", F.row_number().over(
        Window.partitionBy(key).orderBy(F.desc("impact"), F.asc("feature"))))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
