"""Readers and writers for the stored artefacts: corpus, evidence, knowledge base, logs, catalog, training data."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from evidloom import fixed_values as fv
from evidloom.operators.lookup import eligibility_matrix
from evidloom.operators.profile import kb_nested, kb_quality, remedy_rules

CORPUS_SCHEMA = "label string, url string, domain string, category string, text string, chars long, disease_hint string"
EVIDENCE_SCHEMA = (
    "source_label string, source_url string, source_category string, evidence_text string, diseases array<string>, "
    "herbs_found array<string>, dosha_type string, severity string, "
    "constraints struct<child_safe:boolean,elderly_safe:boolean,pregnant_safe:boolean>, confidence_score double"
)
REMEDY_STRUCT = (
    "medicine_name string, formulation_type string, herb_sanskrit array<string>, dosha_type string, dosage string, "
    "allowed_ages string, allowed_genders string, allowed_severities string, "
    "child_safe boolean, elderly_safe boolean, pregnant_safe boolean"
)


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """JSON with a declared schema. Line-delimited files split over tasks; a JSON list file does not."""
    return spark.read.schema(schema).json(path, multiLine=multi_line)


def read_evidence(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Evidence rows in the column names of the operators, with their place in the file as the order."""
    rows = read_json(spark, path, EVIDENCE_SCHEMA, multi_line)
    return rows.select(
        F.monotonically_increasing_id().alias("doc_ord"), F.lit(0).alias("sent_ord"),
        F.coalesce("source_url", F.lit("")).alias("source"), F.col("evidence_text").alias("sentence"),
        F.col("diseases").alias("topics"), F.col("herbs_found").alias("terms"), F.col("dosha_type").alias("class"),
        "severity", "constraints", "confidence_score")


def read_remedies(spark: SparkSession, path: str) -> DataFrame:
    """Remedy rules from a JSON map of topics to lists, one row per remedy in file order.

    Allow-lists stay as they are written, for ``eligibility_matrix``: a missing one is NULL, a JSON null the text ``null``.
    """
    rows = spark.read.schema("value string").text(path, wholetext=True)
    parsed = rows.select(F.from_json("value", "map<string, array<map<string, string>>>").alias("m"))
    lists = parsed.select(F.posexplode("m").alias("topic_ord", "topic", "remedies"))
    lists = lists.select("topic_ord", F.trim("topic").alias("topic"), F.posexplode("remedies").alias("remedy_ord", "r"))

    def value(name: str, kind: str) -> Column:
        raw = F.try_element_at("r", F.lit(name))
        if name.startswith("allowed_"):
            return F.when(F.map_contains_key("r", name), F.coalesce(raw, F.lit("null")))
        return F.from_json(raw, kind) if kind.startswith("array") else raw.try_cast(kind)

    fields = [f.strip().split(" ", 1) for f in REMEDY_STRUCT.split(", ")]
    return lists.where("topic <> ''").select("topic_ord", "topic", F.col("remedy_ord").cast("long").alias("remedy_ord"),
                                             *[value(n, t).alias(n) for n, t in fields])


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """Feature matrix from CSV, without the unnamed trailing column that some exports have."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path).drop("Unnamed: 133")


#: columns of a loaded knowledge base, wherever it comes from
KB_SCHEMA = ("topic string, combo_ord int, age_group string, gender string, severity string, remedy_ord long, medicine_name string, "
             "dosage string, top_terms array<string>")
MANIFEST_SCHEMA = "version string, written timestamp"


def write_kb(kb: DataFrame, profile: DataFrame, path: str) -> str:
    """All knowledge-base outputs as a new version: flat, final, nested, quality report and remedy rules.

    The row of the manifest is written last, so that a reader sees a whole version or none of it; earlier versions stay.
    """
    version = uuid.uuid4().hex
    place = f"{path}/{version}"
    kb.write.parquet(f"{place}/kb_flat")
    flat = kb.sparkSession.read.schema(kb.schema).parquet(f"{place}/kb_flat")
    flat.write.json(f"{place}/kb_final")
    kb_nested(flat).write.json(f"{place}/kb_structured")
    kb_quality(flat).write.json(f"{place}/kb_quality")
    remedy_rules(profile).write.json(f"{place}/remedy_rules")
    row = kb.sparkSession.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("written"))
    row.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return version


def _present(build) -> DataFrame | None:
    """Result of ``build``, or None where its path is not there; other errors are raised."""
    try:
        return build()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def load_kb(spark: SparkSession, kb_path: str, remedies_path: str) -> DataFrame:
    """Newest version of the stored knowledge base; else the matrix derived from the remedy rules; else no rows.

    All three have the columns of KB_SCHEMA, as ``recommend`` takes them.
    """
    manifest = _present(lambda: spark.read.schema(MANIFEST_SCHEMA).parquet(f"{kb_path}/manifest"))
    newest = manifest.orderBy(F.desc("written"), F.desc("version")).first() if manifest is not None else None
    if newest is not None:
        flat = spark.read.schema("topic string, combo_ord int, age_group string, gender string, severity string, medicine_name "
                                 "string, dosage string, top_terms array<string>").parquet(f"{kb_path}/{newest['version']}/kb_flat")
        return _kb_columns(flat.withColumn("remedy_ord", F.lit(0)))
    rules = _present(lambda: read_remedies(spark, remedies_path))
    if rules is None:
        return spark.createDataFrame([], KB_SCHEMA)
    named = rules.withColumns({
        "medicine_name": F.coalesce("medicine_name", F.lit(fv.DEFAULT_REMEDY_NAME)),
        "dosage": F.coalesce("dosage", F.lit(fv.DEFAULT_REMEDY_DOSAGE)), "top_terms": F.col("herb_sanskrit")})
    return _kb_columns(eligibility_matrix(named))


def _kb_columns(kb: DataFrame) -> DataFrame:
    return kb.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(KB_SCHEMA)])


def overwrite_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a stored table without the internal id."""
    return spark.read.parquet(path).drop("_id")
