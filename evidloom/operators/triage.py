"""Message triage: label choice, status routing, dialogue text and log rows."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidloom import fixed_values as fv
from evidloom.bounds import string_array
from evidloom.functions.text import strip_marker
from evidloom.functions.scalars import display_name
from evidloom.functions.vectors import let, mask_renorm, softmax_rescale, suggest
from evidloom.operators.boosting import impacts
from evidloom.operators.ensemble import VotingModel
from evidloom.operators.common import compute_once
from evidloom.operators.features import IntakeLexicon, extract_features
from evidloom.operators.rules import rule_match
from evidloom.session import stored


@dataclass
class TriageConfig:
    """Inputs of the routing; ``vocab`` is the ordered feature list, ``critical`` the critical labels."""

    vocab: list[str]
    critical: list[str]
    pool_empty: list[str]
    pool_few: list[str]
    min_features: int = fv.MIN_FEATURES
    confidence_cut: float = fv.CRITICAL_CONFIDENCE
    rule_confidence: float = fv.RULE_CONFIDENCE


def label_choice(df: DataFrame, model_label: Column, model_confidence: Column, rule: str = "rule_label",
                 rule_confidence: float = fv.RULE_CONFIDENCE) -> DataFrame:
    """Rule label with the fixed rule confidence, else the label and confidence of the model."""
    hit = F.col(rule).isNotNull()
    return df.withColumn("label", F.coalesce(F.col(rule), model_label)).withColumn(
        "confidence", F.when(hit, F.lit(rule_confidence)).otherwise(model_confidence))


def best_score(scores: Column, labels: list[str], critical: list[str], final: Column) -> Column:
    """struct(label, confidence) of the best model score after the softmax; on a final check critical labels are masked."""
    masked = F.array(*[F.lit(x in critical) for x in labels])
    return let(mask_renorm(softmax_rescale(scores), masked, final), lambda picked: F.struct(
        F.get(string_array(labels), picked["top"]).alias("label"), picked["confidence"].alias("confidence")))


def _spaced(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit(" "))


def route(df: DataFrame, cfg: TriageConfig) -> DataFrame:
    """Add ``status``, ``message``, ``top_label``, ``confidence_pct`` and ``follow_ups``.

    The first that holds decides: no features on a final check, no features, few features with a critical label,
    few features, critical and sure, success.
    """
    feats, final = F.col("features"), F.coalesce(F.col("is_final_check"), F.lit(False))
    none = F.size(feats) == 0
    is_critical = F.coalesce(F.col("label").isin(*cfg.critical), F.lit(False))
    few = ~final & (F.size(feats) < cfg.min_features)
    few_critical = few & is_critical
    emergency = is_critical & (F.col("confidence") > cfg.confidence_cut)

    def pick(error, nothing, critical_few, few_only, alarm, success) -> Column:
        return (
            F.when(none & final, error).when(none, nothing).when(few_critical, critical_few).when(few, few_only)
            .when(emergency, alarm).otherwise(success)
        )

    text = F.lit(None).cast("string")
    no_list = F.lit(None).cast("array<string>")
    listed = F.array_join(F.transform(feats, _spaced), ", ")
    a, b = fv.REPLY_CRITICAL_FEW, fv.REPLY_FEW
    alarm = fv.REPLY_EMERGENCY
    return df.select(
        "*",
        pick(F.lit("error"), F.lit("needs_more_info"), F.lit("needs_more_info"), F.lit("needs_more_info"),
             F.lit("CRITICAL"), F.lit("success")).alias("status"),
        pick(
            F.lit(fv.REPLY_ERROR), F.lit(fv.REPLY_NOTHING_FOUND),
            F.concat(F.lit(a[0]), _spaced(F.get(feats, 0)), F.lit(a[1])),
            F.concat(F.lit(b[0]), listed, F.lit(b[1])),
            F.concat(F.lit(alarm[0]), F.col("label"), F.lit(alarm[1])), text,
        ).alias("message"),
        pick(text, F.lit("Unknown"), F.col("label"), F.col("label"), F.col("label"), F.col("label"))
        .alias("top_label"),
        F.round(F.when(none, F.when(~final, F.lit(0.0))).otherwise(F.col("confidence") * 100), 2)
        .alias("confidence_pct"),
        pick(no_list, suggest(feats, cfg.pool_empty, cfg.vocab, 5), string_array(fv.CRITICAL_FOLLOW_UPS),
             suggest(feats, cfg.pool_few, cfg.vocab, 4), no_list, no_list).alias("follow_ups"),
    )


def triage(messages: DataFrame, keys: list[str], lex: IntakeLexicon, rules: DataFrame, cfg: TriageConfig,
           model_label: Column, model_confidence: Column) -> DataFrame:
    """Whole intake step: marker strip, features, rule match, label choice and routing."""
    rows = messages.withColumn("text", strip_marker(F.col("text")))
    rows = extract_features(rows, keys, lex)
    rows = rule_match(rows, rules, keys)
    return route(label_choice(rows, model_label, model_confidence, rule_confidence=cfg.rule_confidence), cfg)


def triage_with_model(messages: DataFrame, keys: list[str], lex: IntakeLexicon, rules: DataFrame, cfg: TriageConfig,
                      model: VotingModel) -> DataFrame:
    """Whole intake step with the ensemble: only rows that have features and fit no rule are scored.

    Adds ``contributions``, (symptom, impact_score) of the active features of a scored row by the regularised member, for
    the label it got; null for other rows. Features are extracted once: the rows are written before they are split.
    """
    rows = extract_features(messages.withColumn("text", strip_marker(F.col("text"))), keys, lex)
    rows = stored(rule_match(rows, rules, keys), "featured")
    unscored = F.col("rule_label").isNotNull() | (F.size("features") == 0)
    none = F.lit(None)
    told = rows.where(unscored).withColumns({
        "label": F.col("rule_label"), "confidence": F.when(F.col("rule_label").isNotNull(), F.lit(cfg.rule_confidence)),
        "contributions": none.cast("array<struct<symptom:string,impact_score:double>>")})
    return route(told.unionByName(_scored(rows.where(~unscored), cfg, model)), cfg)


def _scored(rows: DataFrame, cfg: TriageConfig, model: VotingModel) -> DataFrame:
    final = F.coalesce(F.col("is_final_check"), F.lit(False))
    best = best_score(F.col("vote_p"), model.labels, cfg.critical, final)
    scored = compute_once(model.transform(rows.withColumnRenamed("features", model.features)), _best=best)
    place = (F.array_position(string_array(model.labels), F.col("_best.label")) - 1).cast("int")
    shares = impacts(model.strict, "values", place, model.vocab)
    return scored.select(
        *rows.columns, F.col("_best.label").alias("label"), F.col("_best.confidence").alias("confidence"),
        F.transform(shares, lambda p: F.struct(display_name(p["feature"]).alias("symptom"), p["impact"].alias("impact_score")))
        .alias("contributions"))


def triage_log_rows(triaged: DataFrame, user: str, at: Column | None = None) -> DataFrame:
    """Rows to log, with the time ``at`` (now, if not given): emergencies and completed diagnoses only."""
    status = F.when(F.col("status") == "CRITICAL", "EMERGENCY").when(F.col("status") == "success", "COMPLETED")
    return triaged.where(F.col("status").isin("CRITICAL", "success")).select(
        F.col(user).alias("username"), F.col("text").alias("symptoms"), F.col("label").alias("predicted_disease"),
        status.alias("status"), "confidence", (F.current_timestamp() if at is None else at).alias("timestamp"))


def dialogue_accumulate(turns: DataFrame, key: str, order: str, text: str = "text", block: int = 512) -> DataFrame:
    """Add ``dialogue``: the first text of the conversation, and each later one up to the turn as a follow-up sentence.

    A follow-up is put as ``. I also have <text>.`` with spaces for underscores. Work is split by ``(key, block of
    turns)``, ``order`` being an integer turn number (of either sign), so that a long conversation is not one task. Every
    row gets the joined texts of the blocks before, one row per block. NULL texts add nothing; a turn without any text up
    to it has an empty dialogue.
    """
    of_block = [key, "_block"]
    rows = turns.withColumn("_block", F.floor(F.col(order) / block))
    first = Window.partitionBy(key)
    before = first.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*of_block).agg(
        F.min(F.when(F.col(text).isNotNull(), F.col(order))).alias("_least"),
        F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))).alias("_items"))
    blocks = blocks.withColumn("_first", F.min("_least").over(first)).withColumn("_joined", F.array_join(F.transform(
        "_items", lambda s: _sentence(s["t"], s["o"] == F.col("_first"))), ""))
    blocks = blocks.select(*of_block, "_first", F.array_join(F.collect_list("_joined").over(before), "").alias("_before"))
    within = Window.partitionBy(*of_block).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(blocks, of_block)
    own = F.collect_list(_sentence(F.col(text), F.col(order) == F.col("_first"))).over(within)
    return joined.withColumn("dialogue", F.concat("_before", F.array_join(own, ""))).drop("_block", "_first", "_before")


def _sentence(text: Column, is_first: Column) -> Column:
    a, b = fv.FOLLOW_UP
    return F.when(is_first, text).otherwise(F.concat(F.lit(a), _spaced(text), F.lit(b)))
