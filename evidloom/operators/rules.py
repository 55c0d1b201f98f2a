"""Ordered subset rules on feature sets."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidloom.bounds import LITERAL_ROWS, broadcast_if_small, small_rows
from evidloom.fixed_values import RULE_SLACK
from evidloom.operators.common import first_by


def rule_match(df: DataFrame, rules: DataFrame, keys: list[str], feats: str = "features", out: str = "rule_label",
               slack: int = RULE_SLACK, literal_rows: int = LITERAL_ROWS) -> DataFrame:
    """Add the label of the first rule contained in the feature set with at most ``slack`` features left over.

    ``rules`` has ``(rule_ord, label, feats)``. A bounded rule base becomes one CASE expression. A larger one is
    matched per distinct feature set through an inverted index: features joined on rule features, complete rules kept.
    A rule without features fits sets of at most ``slack`` features, in both plans; an empty set fits no rule.
    """
    rows = small_rows(rules, literal_rows)
    if rows is not None:
        have = F.col(feats)
        case = F.when(F.size(have) == 0, F.lit(None).cast("string"))
        for r in sorted(rows, key=lambda r: r.rule_ord):
            wanted = sorted(set(r.feats))
            cond = F.size(have).between(len(wanted), len(wanted) + slack)
            for f in wanted:
                cond = cond & F.array_contains(have, f)
            case = case.when(cond, F.lit(r.label))
        return df.withColumn(out, case)
    flat = rules.select("rule_ord", "label", F.size(F.array_distinct("feats")).alias("_need"),
                        F.explode(F.array_distinct("feats")).alias("_f"))
    empty = rules.where(F.size("feats") == 0).orderBy("rule_ord").limit(1).collect()
    sets = df.select(F.col(feats).alias("_set")).where(F.size("_set") > 0).distinct()
    hits = sets.select("_set", F.explode("_set").alias("_f")).join(broadcast_if_small(flat), "_f")
    full = hits.groupBy("_set", "rule_ord", "label", "_need").agg(F.count(F.lit(1)).alias("_n")).where(
        (F.col("_n") == F.col("_need")) & (F.size("_set") <= F.col("_need") + slack))
    if empty:
        always = sets.where(F.size("_set") <= slack).select(
            "_set", F.lit(empty[0].rule_ord).alias("rule_ord"), F.lit(empty[0].label).alias("label"))
        full = full.select("_set", "rule_ord", "label").union(always)
    best = first_by(full, ["_set"], [F.asc("rule_ord")]).select("_set", F.col("label").alias(out))
    return df.join(best, F.col(feats) == F.col("_set"), "left").drop("_set")
