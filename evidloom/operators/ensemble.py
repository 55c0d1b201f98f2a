"""Soft-voting ensemble of forest, boosting and regularised boosting as one Spark ML model, with all it needs to score."""
from __future__ import annotations

from pyspark.ml import Model, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidloom.functions.vectors import feature_array
from evidloom.operators.boosting import PLAIN, REGULARISED, BoostedTrees, Boosting, fit_boosting
from evidloom.operators.learning import fit_forest, label_indexer, soft_vote, with_vector

MEMBERS = ["forest_s", "plain_s", "strict_s"]


class VotingModel(Model, MLWritable, MLReadable):
    """Members, label names, vocabulary and critical labels, saved and loaded together.

    ``transform`` takes rows with an array of feature names and adds ``values`` (0/1 in vocabulary order), the class
    probabilities of the members (``forest_s``, ``plain_s``, ``strict_s``), their mean ``vote_p`` and its first largest
    class ``vote``. A row without features (null or empty) is scored as one with no active feature.
    """

    def __init__(self, forest: PipelineModel, plain: BoostedTrees, strict: BoostedTrees, labels: list[str], vocab: list[str],
                 critical: list[str], features: str = "features"):
        super().__init__()
        self.forest, self.plain, self.strict = forest, plain, strict
        self.labels, self.vocab, self.critical, self.features = labels, vocab, critical, features

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names = F.coalesce(F.col(self.features), F.array().cast("array<string>"))
        rows = with_vector(dataset.withColumn("values", feature_array(names, self.vocab)), "values")
        rows = self.forest.transform(rows).withColumn("forest_s", vector_to_array("forest_p")).drop(
            "forest_p", "forest_raw", "forest_label", "vector")
        rows = rows.withColumn("plain_s", self.plain.probabilities("values")).withColumn(
            "strict_s", self.strict.probabilities("values"))
        return soft_vote(rows, MEMBERS)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: VotingModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        spark = SparkSession.active()
        extra = {"labels": m.labels, "vocab": m.vocab, "critical": m.critical, "features": m.features}
        for name in ("plain", "strict"):
            trees = getattr(m, name)
            extra[name] = {"start": trees.start.tolist(), "rounds": len(trees.trees["feature"]), "depth": trees.depth}
            trees.node_table(spark).write.mode("overwrite").parquet(f"{path}/{name}")
        m.forest.write().overwrite().save(f"{path}/forest")
        DefaultParamsWriter.saveMetadata(m, path, spark.sparkContext, extraMetadata={"bundle": extra})


class _Reader(MLReader):
    def load(self, path: str) -> VotingModel:
        spark = SparkSession.active()
        extra = DefaultParamsReader.loadMetadata(path, spark.sparkContext)["bundle"]
        members = {n: BoostedTrees.from_nodes(spark.read.parquet(f"{path}/{n}").collect(), **extra[n]) for n in ("plain", "strict")}
        return VotingModel(PipelineModel.load(f"{path}/forest"), labels=extra["labels"], vocab=extra["vocab"],
                           critical=extra["critical"], features=extra["features"], **members)


def fit_voting(train: DataFrame, label: str, vocab: list[str], critical: list[str], features: str = "features",
               trees: int = 150, plain: Boosting = PLAIN, strict: Boosting = REGULARISED) -> VotingModel:
    """Fit all members on rows with an array of feature names and a label; rows without a label are left out.

    Labels are indexed in alphabetical order. The rows are read several times, so give a written table.
    """
    known = train.where(F.col(label).isNotNull()).select(F.col(features), F.col(label))
    indexer = label_indexer(known, label, "label_index")
    rows = indexer.transform(known).withColumn("values", feature_array(F.col(features), vocab))
    rows = with_vector(rows.select("values", "label_index"), "values")
    classes = len(indexer.labels)
    members = {n: fit_boosting(rows, "values", "label_index", classes, cfg) for n, cfg in (("plain", plain), ("strict", strict))}
    return VotingModel(fit_forest(rows, trees=trees), labels=list(indexer.labels), vocab=vocab, critical=critical,
                       features=features, **members)
