"""Documents to packed training sequences: quality, near copies, benchmark passages, secrets, packing."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidloom.llm.decontamination import with_benchmark_hits
from evidloom.llm.ngram_join import BROADCAST_IDS, ngram_components
from evidloom.llm.packing import pack
from evidloom.llm.quality import train, with_quality
from evidloom.llm.secrets import masked, with_secrets
from evidloom.llm.storage import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of the documents given."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = _free_name(docs, "score")
    return with_quality(docs, "text", model, score).where(F.col(score) >= 0.5).select(*_columns(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of rows that links join: that with the smallest id, null last, then the first row.

    Every row is a document of its own, also where ids are null or repeat with the same or other texts: then rows are
    written with a number and joined by it. Rows without words are linked with nothing, so all of them stay.
    """
    n, distinct = docs.agg(F.count("*"), F.countDistinct("doc_id")).first()
    rows, row = docs, "doc_id"
    if n != distinct:
        row = _free_name(docs, "row")
        rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = stored(ngram_components(rows, key=row).select(F.col(row).alias("member"), F.col("component_id").alias("top"))
                   .where("member != top"), "copies")
    grouped = stored(found.unionByName(found.select(F.col("top").alias("member"), "top").distinct()), "groups")
    ids = rows.select(F.col(row).alias("member"), F.col("doc_id").alias("id"))
    small = grouped.count() <= BROADCAST_IDS
    place = F.struct(F.col("id").isNull().alias("none"), "id", "member")
    first = (ids.join(F.broadcast(grouped) if small else grouped, "member").groupBy("top")
             .agg(F.min(place)["member"].alias("member")).select("member"))
    gone = stored(grouped.join(first, "member", "left_anti").select(F.col("member").alias(row)), "gone")
    return rows.join(F.broadcast(gone) if small else gone, row, "left_anti").select(*_columns(docs))


def _free_name(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name = f"_{name}"
    return name


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    mark = _free_name(docs, "mark_")
    marked = with_benchmark_hits(docs, "text", spark.read.parquet(f"{sf_dir}/benchmark.parquet"), prefix=mark)
    return marked.where(~F.col(f"{mark}contaminated")).select(*_columns(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked and their length as it is then."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_chars")]
    clean = with_secrets(docs, "text").select(*kept, masked(F.col("text"), F.col("secrets")).alias("text"))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*_columns(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences."""
    return pack(docs, "doc_id", "text")


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", decontamination),
          ("secret scans", secrets), ("best-fit packing", packing)]

#: tokenisation, components and a trained classifier can't be written in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
    return docs
