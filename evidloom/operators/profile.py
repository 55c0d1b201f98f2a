"""Topic profiles and the knowledge base built from evidence rows."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom import fixed_values as fv
from evidloom.bounds import sql_text, string_array
from evidloom.functions.scalars import contraindications, formulation, kb_dosage
from evidloom.operators.common import top_k


def _place() -> Column:
    """Place of a row in evidence order as one decimal, which a hash aggregate can hold (a struct would be sorted)."""
    return F.col("doc_ord").cast("decimal(19,0)") * F.lit(10**10).cast("decimal(11,0)") + F.col("sent_ord")


def evidence_facts(ext: DataFrame) -> DataFrame:
    """Counts per (topic, kind, value), kind being ``term``, ``source``, ``class`` or ``all``.

    One pass over the evidence and one shuffle of pre-aggregated rows serve all profile columns. The single ``all``
    fact of a topic carries the row count, the confidence sum and the safety flags.
    """
    flags = F.col("constraints")
    conf = F.coalesce(F.col("confidence_score"), F.lit(fv.CONFIDENCE_MISSING)).cast("decimal(20,6)")

    def fact(kind: str, value: Column) -> Column:
        return F.named_struct(F.lit("kind"), F.lit(kind), F.lit("value"), value)

    facts = F.concat(
        F.transform("terms", lambda t: fact("term", t)),
        F.array(fact("source", F.col("source")), fact("class", F.coalesce("class", F.lit(fv.DEFAULT_CLASS))),
                fact("all", F.lit(None).cast("string"))),
    )
    rows = ext.where((F.size("terms") > 0) & (F.size("topics") > 0)).select(
        "doc_ord", "sent_ord", conf.alias("conf"),
        *[F.coalesce(flags[f], F.lit(True)).alias(f) for f in ("child_safe", "elderly_safe", "pregnant_safe")],
        F.explode("topics").alias("topic"), facts.alias("facts"),
    ).select("*", F.explode("facts").alias("fact")).select(
        "topic", "fact.kind", "fact.value", "doc_ord", "sent_ord", "conf", "child_safe", "elderly_safe",
        "pregnant_safe")
    return rows.groupBy("topic", "kind", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min(_place()).alias("at"), F.sum("conf").alias("conf"),
        *[F.bool_and(f).alias(f) for f in ("child_safe", "elderly_safe", "pregnant_safe")],
    )


def _by_frequency() -> list[Column]:
    return [F.desc("n"), F.asc("at"), F.asc("value")]


def top_terms(ext: DataFrame, k: int = fv.TOP_TERMS) -> DataFrame:
    """Most frequent terms per topic; the one seen first wins a tie."""
    facts = evidence_facts(ext).where(F.col("kind") == "term")
    return top_k(facts, ["topic"], _by_frequency(), k, "rank").select(
        "topic", "rank", F.col("value").alias("term"), "n")


def topic_modes(ext: DataFrame) -> DataFrame:
    """Most frequent source and class per topic; the one seen first wins a tie."""
    facts = evidence_facts(ext).where(F.col("kind").isin("source", "class"))
    best = top_k(facts, ["topic", "kind"], _by_frequency(), 1)
    return best.groupBy("topic").agg(
        F.max(F.when(F.col("kind") == "source", F.col("value"))).alias("source"),
        F.max(F.when(F.col("kind") == "class", F.col("value"))).alias("class"),
    )


def topic_profile(ext: DataFrame, topics: DataFrame, k: int = fv.TOP_TERMS,
                  default_terms: list[str] = fv.DEFAULT_TERMS, default_class: str = fv.DEFAULT_CLASS,
                  name_suffix: str = " Protocol") -> DataFrame:
    """One row per topic of the list, with defaults for a topic without evidence."""
    best = top_k(evidence_facts(ext), ["topic", "kind"], _by_frequency(), k, "rank")
    top = F.col("rank") == 1
    whole = F.col("kind") == "all"
    lists = best.groupBy("topic").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "term", F.struct("rank", "value")))).alias("_terms"),
        F.max(F.when((F.col("kind") == "source") & top, F.col("value"))).alias("_source"),
        F.max(F.when((F.col("kind") == "class") & top, F.col("value"))).alias("_class"),
        F.max(F.when(whole, F.col("n"))).alias("evidence_count"),
        F.max(F.when(whole, (F.col("conf") / F.col("n")).cast("double"))).alias("avg_conf"),
        *[F.bool_and(F.when(whole, F.col(f))).alias(f) for f in ("child_safe", "elderly_safe", "pregnant_safe")],
    )
    terms = F.coalesce(F.transform("_terms", lambda s: s["value"]), string_array(default_terms))
    rows = topics.select("topic_ord", "topic").join(lists, "topic", "left")
    return rows.withColumn("top_terms", terms).select(
        "topic_ord", "topic",
        F.concat("topic", F.lit(name_suffix)).alias("medicine_name"),
        formulation(F.col("top_terms")).alias("formulation_type"),
        "top_terms",
        F.coalesce("_class", F.lit(default_class)).alias("class"),
        F.coalesce("_source", F.lit(fv.DEFAULT_SOURCE)).alias("source"),
        F.round(F.coalesce("avg_conf", F.lit(0.0)), 3).alias("confidence_score"),
        F.struct(*[F.coalesce(f, F.lit(True)).alias(f) for f in ("child_safe", "elderly_safe", "pregnant_safe")])
        .alias("constraints"),
        F.coalesce("evidence_count", F.lit(0)).cast("long").alias("evidence_count"),
    )


@dataclass
class PatientDims:
    """Members of the patient matrix, in order."""

    ages: list[str] = field(default_factory=lambda: fv.AGES)
    genders: list[str] = field(default_factory=lambda: fv.GENDERS)
    severities: list[str] = field(default_factory=lambda: fv.SEVERITIES)

    def combos(self) -> list[tuple[str, str, str]]:
        return [(a, g, s) for a in self.ages for g in self.genders for s in self.severities]

    def array(self) -> Column:
        """Literal array of combination structs, to be exploded next to a row (no join)."""
        combos = [
            f"named_struct('combo_ord', {i}, 'age_group', {sql_text(a)}, 'gender', {sql_text(g)}, 'severity', {sql_text(s)})"
            for i, (a, g, s) in enumerate(self.combos())
        ]
        return F.expr(f"array({', '.join(combos)})")


def expand_kb(profile: DataFrame, dims: PatientDims | None = None) -> DataFrame:
    """Profile rows times patient combinations, with dosage and contraindications."""
    dims = dims or PatientDims()
    rows = profile.select("*", F.explode(dims.array()).alias("_c")).select("*", "_c.*").drop("_c")
    return rows.select(
        "topic_ord", "topic", "combo_ord", "age_group", "gender", "severity", "medicine_name", "top_terms",
        "formulation_type", "class",
        kb_dosage(F.col("severity"), F.col("age_group"), F.col("constraints.child_safe")).alias("dosage"),
        contraindications(F.col("constraints")).alias("contraindications"),
        "source", "confidence_score", "evidence_count",
    )


def kb_nested(kb: DataFrame) -> DataFrame:
    """One row per topic with a map from ``age_gender_severity`` to its records. A topic has as many records as
    there are patient combinations, so the collected list is bounded."""
    combo = F.concat_ws("_", "age_group", "gender", "severity")
    record = F.struct("medicine_name", "top_terms", "formulation_type", "class", "dosage", "contraindications",
                      "source", "confidence_score", "evidence_count")
    return kb.groupBy("topic_ord", "topic").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(combo.alias("combo"), F.array(record).alias("recs")))))
        .alias("buckets"))


def kb_quality(kb: DataFrame, dims: PatientDims | None = None, examples: int = fv.QUALITY_EXAMPLES) -> DataFrame:
    """One-row quality report with the first zero-evidence combinations in topic and combination order."""
    dims = dims or PatientDims()
    per_topic = len(dims.combos())
    empty = F.col("evidence_count") == 0
    totals = kb.agg(
        F.countDistinct("topic").alias("topic_count"),
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(empty).alias("zero_evidence_combos"),
    )
    first = kb.where(empty).select(
        "topic_ord", "combo_ord",
        F.concat(F.col("topic"), F.lit(":"), F.concat_ws("_", "age_group", "gender", "severity")).alias("example"),
    ).orderBy("topic_ord", "combo_ord").limit(examples)
    listed = first.agg(F.array_sort(F.collect_list(F.struct("topic_ord", "combo_ord", "example"))).alias("_l"))
    both = totals.unionByName(listed, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in totals.columns], F.first("_l", ignorenulls=True).alias("_l"))
    return both.select(
        "topic_count", (F.col("topic_count") * per_topic).alias("total_combos_expected"), "total_records",
        "zero_evidence_combos", F.transform("_l", lambda s: s["example"]).alias("zero_evidence_examples"))


def remedy_rules(profile: DataFrame) -> DataFrame:
    """Curation table: one remedy per topic, allowed for every patient."""
    return profile.select(
        "topic_ord", "topic", "medicine_name", "formulation_type", F.col("top_terms").alias("herb_sanskrit"),
        F.col("class").alias("dosha_type"), F.lit(fv.DOSAGE_STANDARD).alias("dosage"),
        string_array(["all"]).alias("allowed_ages"), string_array(["all"]).alias("allowed_genders"),
        string_array(fv.SEVERITIES).alias("allowed_severities"), "constraints.child_safe", "constraints.elderly_safe",
        "constraints.pregnant_safe")
