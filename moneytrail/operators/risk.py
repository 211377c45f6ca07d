"""Fusion of rule, pattern, model and behaviour signals, and what follows from the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moneytrail.constants import (AI_PREDICTED, AI_RISK_SCORE, AI_UNHEARD, ALERT_LEVELS, BLEND_DIRECTIONS, BLEND_TEXTS,
                                  COUNTRY_LISTS, CTR_THRESHOLD, ML_BASE_SCORE, RECOMMENDED_ACTIONS, RISK_RANK,
                                  STATUS_BADGE)
from moneytrail.functions.scalars import (composite_level, lookup, money_text, percent_text, risk_level_from_score,
                                          risk_rank)


def _flag(name: str, columns: list[str]) -> Column:
    return F.coalesce(F.col(name), F.lit(False)) if name in columns else F.lit(False)


def batch_rule_score(df: DataFrame) -> DataFrame:
    """Additive rule score of the batch pipeline (``batch_rule_score``, at most 100)."""
    amount, have = F.col("amount"), df.columns
    origin = F.upper(F.coalesce("origin_country", F.lit(""))) if "origin_country" in have else F.lit("")
    target = F.upper(F.coalesce("destination_country", F.lit("")))
    abroad = origin.isin(COUNTRY_LISTS["batch_high"]) | target.isin(COUNTRY_LISTS["batch_high"])
    score = (F.when(amount >= 10_000, 20).when(amount >= 5_000, 10).otherwise(0) + F.when(abroad, 25).otherwise(0)
             + F.when(_flag("pep_flag", have), 15).otherwise(0)
             + F.when(_flag("sanctioned_flag", have), 30).otherwise(0)
             + F.when(_flag("is_new_recipient", have), 10).otherwise(0))
    return df.withColumn("batch_rule_score", F.least(F.lit(100), score).cast("double"))


def ml_risk_score(predicted: Column, confidence: Column, anomaly: Column) -> Column:
    """Number from 0 to 100 for a predicted class, its confidence and the anomaly score."""
    base = lookup(predicted, ML_BASE_SCORE, 50)
    moved = F.when(predicted == "normal", base + (1 - confidence) * 20).otherwise(base + confidence * 15)
    odd = F.when(anomaly < 0, F.abs(anomaly) * 10).otherwise(0.0)
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), moved + odd))


def adjust_prediction(df: DataFrame, mode: str = "online") -> DataFrame:
    """Let a strong anomaly raise the predicted class (``predicted``, ``confidence``, ``anomaly`` columns).

    ``mode`` picks the confidence floors of the online and of the batch model.
    """
    mild, doubt, strong = (0.62, 0.70, 0.72) if mode == "online" else (0.65, 0.75, 0.78)
    p, c, a = F.col("predicted"), F.col("confidence"), F.col("anomaly")
    nudged = F.coalesce((a < -0.05) & (p == "normal"), F.lit(False))
    severe = F.coalesce(~nudged & (a < -0.15), F.lit(False))
    return df.withColumns({
        "predicted": F.when(nudged, "suspicious").when(severe & (p != "super_suspicious") & (c < doubt),
                                                       "super_suspicious").otherwise(p),
        "confidence": F.when(nudged, F.greatest(c, F.lit(mild))).when(severe, F.greatest(c, F.lit(strong)))
        .otherwise(c)})


def composite_score(ml: Column, confidence: Column, pattern: Column, rule: Column) -> Column:
    total = ml * (F.lit(0.5) + confidence * 0.3) + pattern * 0.3 + rule * 0.2
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), total))


def final_level(score: Column, high_patterns: Column) -> Column:
    """Level of a composite score; high-risk patterns escalate it."""
    return (F.when(high_patterns >= 2, "critical").when((high_patterns >= 1) & (score >= 40), "critical")
            .when(high_patterns >= 1, "high").otherwise(composite_level(score)))


def recommended_action(level: Column, high_patterns: Column) -> Column:
    def action(key: str) -> Column:
        name, priority, text, timeline, approvals = RECOMMENDED_ACTIONS[key]
        return F.struct(F.lit(name).alias("action"), F.lit(priority).alias("priority"),
                        F.lit(text).alias("description"), F.lit(timeline).alias("timeline"),
                        F.array(*[F.lit(a) for a in approvals]).alias("required_approvals"))
    return (F.when(level == "critical", action("critical"))
            .when((level == "high") & (high_patterns >= 2), action("high_multi"))
            .when(level == "high", action("high")).when(level == "medium", action("medium"))
            .otherwise(action("low")))


def contributing_factors(ml: Column, confidence: Column, pattern: Column, pattern_count: Column, rule: Column,
                         anomaly: Column) -> Column:
    """Up to five factors, largest value first."""
    def factor(when: Column, name: str, value: Column, weight: float, text: Column, order: int) -> Column:
        return F.when(when, F.struct(value.cast("double").alias("value"), F.lit(-order).alias("o"),
                                     F.lit(name).alias("factor"), F.lit(weight).alias("weight"),
                                     text.alias("description")))

    found = F.array_compact(F.array(
        factor(F.lit(True), "ML Prediction", ml, 0.5,
               F.concat(F.lit("Model risk score with "), percent_text(confidence, 1), F.lit(" confidence")), 0),
        factor(pattern > 0, "Fraud Patterns", pattern, 0.3,
               F.concat(pattern_count.cast("string"), F.lit(" suspicious patterns detected")), 1),
        factor(rule > 0, "Rule-Based Analysis", rule, 0.2, F.lit("Regulatory rule violations"), 2),
        factor(anomaly < 0, "Anomaly Detection", F.abs(anomaly) * 100, 0.15,
               F.concat(F.lit("Behavioral anomaly detected (score: "), F.format_string("%.2f", anomaly),
                        F.lit(")")), 3)))
    top = F.slice(F.sort_array(found, asc=False), 1, 5)
    return F.transform(top, lambda f: F.struct(f["factor"].alias("factor"), f["value"].alias("value"),
                                               f["weight"].alias("weight"), f["description"].alias("description")))


def explain_factors(factors: Column) -> Column:
    return F.transform(factors, lambda f: F.when(f["description"] != "", f["description"]).otherwise(F.concat(
        f["factor"], F.lit(" contributes to risk (value: "), f["value"].cast("string"), F.lit(")"))))


def explanations(df: DataFrame) -> Column:
    """Texts for the assessment: model, anomaly, first three patterns, rules, amount, new beneficiary."""
    c = F.col
    sure = percent_text(c("confidence"), 1)
    shown = F.transform(F.slice("patterns", 1, 3), lambda p: F.concat(F.lit("Pattern detected: "), p["description"]))
    head = F.array_compact(F.array(
        F.when(c("predicted") == "super_suspicious", F.concat(F.lit("ML model predicts high risk with "), sure,
                                                              F.lit(" confidence")))
        .when(c("predicted") == "suspicious", F.concat(F.lit("ML model predicts suspicious activity with "), sure,
                                                       F.lit(" confidence"))),
        F.when(c("anomaly") < -0.1, F.concat(F.lit("Transaction shows strong anomaly behavior (score: "),
                                             F.format_string("%.2f", c("anomaly")), F.lit(")")))))
    tail = F.array_compact(F.array(
        F.when(c("batch_rule_score") >= 50, F.concat(F.lit("Rule-based analysis indicates elevated risk (score: "),
                                                     F.format_string("%.0f", c("batch_rule_score")), F.lit(")"))),
        F.when(c("amount") >= CTR_THRESHOLD, F.concat(F.lit("Large transaction amount: "), money_text(c("amount")))),
        F.when((c("transaction_type") == "transfer") & (F.coalesce("receiver_account", F.lit("")) != "")
               & _flag("is_new_recipient", df.columns), "Transfer to new beneficiary")))
    return F.concat(head, shown, tail)


def composite_risk(df: DataFrame) -> DataFrame:
    """Full assessment of rows with ``ml_score``, ``predicted``, ``confidence``, ``anomaly``, ``patterns``,
    ``pattern_score``, ``pattern_count``, ``high_risk_patterns`` and ``batch_rule_score``."""
    c = F.col
    high = F.size("high_risk_patterns")
    rows = df.withColumn("_score", composite_score(c("ml_score"), c("confidence"), c("pattern_score"),
                                                   c("batch_rule_score")))
    rows = rows.withColumn("assessed_level", final_level(c("_score"), high))
    return rows.withColumns({
        "assessed_score": F.bround("_score", 2), "assessed_confidence": F.bround("confidence", 3),
        "ml_component": F.bround("ml_score", 2), "pattern_component": F.bround(c("pattern_score").cast("double"), 2),
        "rule_component": F.bround("batch_rule_score", 2),
        "explanations": explanations(df),
        "contributing_factors": contributing_factors(c("ml_score"), c("confidence"), c("pattern_score"),
                                                     c("pattern_count"), c("batch_rule_score"), c("anomaly")),
        "recommended_action": recommended_action(c("assessed_level"), high)}).drop("_score")


def format_assessment(assessed: DataFrame) -> DataFrame:
    """Columns of the summary card."""
    level = F.col("assessed_level")
    badge = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in STATUS_BADGE.items() for x in kv]), level),
                       F.lit("Unknown"))
    return assessed.select("id", F.upper(level).alias("risk_level"), F.col("assessed_score").alias("risk_score"),
                           percent_text(F.col("assessed_confidence"), 1).alias("confidence"), badge.alias("status"),
                           F.col("recommended_action.action").alias("action"), "pattern_count")


def online_risk(df: DataFrame) -> DataFrame:
    """Fuse ``rule_score``, ``ml_level``/``ml_confidence`` and ``behavioral_score`` into the online score and level.

    A model counts from 65 % confidence; behaviour counts by its own score; the rule score is a floor.
    """
    c = F.col
    sure = F.coalesce(c("ml_confidence") >= 0.65, F.lit(False))
    ml = F.when(sure, lookup(c("ml_level"), AI_RISK_SCORE, 0)).otherwise(0)
    behaviour = F.coalesce(c("behavioral_score"), F.lit(0))
    trust = F.least(F.lit(0.9), behaviour / 100.0)
    fused = F.bround(ml * F.coalesce("ml_confidence", F.lit(0.0)) * 0.65 + behaviour * trust * 0.35, 0)
    rows = df.withColumns({"ml_score": ml.cast("long"), "ai_score": fused.cast("long"),
                           "behavioral_confidence": trust})
    rows = rows.withColumn("risk_score", F.greatest("rule_score", "ai_score"))
    rows = rows.withColumn("risk_level", risk_level_from_score(c("risk_score")))
    has_rules = F.size("rules") > 0 if "rules" in df.columns else F.lit(False)
    parts = F.concat_ws("; ", F.when(has_rules, c("rule_reason")) if "rule_reason" in df.columns else F.lit(None),
                        F.when(ml > 0, F.concat(F.lit("ML model: "), F.replace("ml_level", F.lit("_"), F.lit(" ")),
                                                F.lit(" ("), percent_text(c("ml_confidence")),
                                                F.lit(" confidence)"))),
                        F.when(behaviour >= 40, c("behavioral_reason")) if "behavioral_reason" in df.columns
                        else F.lit(None))
    return rows.withColumns({
        "reason": F.when(parts == "", "Routine transaction — no material AML indicators").otherwise(parts),
        "ai_risk_level": F.coalesce("ml_level", "behavioral_level"),
        "ai_confidence": F.greatest(F.coalesce("ml_confidence", F.lit(0.0)), trust)})


def combine_rule_ai(df: DataFrame) -> DataFrame:
    """Blend a rule result with a model result.

    Input ``rule_score``, ``rule_level``, ``ai_level``, ``ai_confidence``, ``mandatory`` and, if there is one,
    ``rule_reason``; adds ``final_score``, ``final_level``, ``final_reason`` and ``ai_reason``.  A mandatory rule is never
    lowered, and a "normal" model never lowers a suspicious rule.
    """
    c = F.col
    rule, conf = c("rule_score"), F.coalesce("ai_confidence", F.lit(0.0))
    rule_rank, ai_rank = risk_rank(c("rule_level")), risk_rank(c("ai_level"))
    ai = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in AI_RISK_SCORE.items() for x in kv]),
                                 F.coalesce("ai_level", F.lit(""))), rule)
    heard = (F.coalesce("ai_level", F.lit("")) != "") & (conf >= 0.55)
    free = ~F.coalesce("mandatory", F.lit(False))
    weight = F.least(F.lit(0.85), F.greatest(F.lit(0.60), conf))
    blend = F.bround(ai * weight + rule * (1 - weight), 0).cast("long")
    calm = (c("ai_level") == "normal") & (conf >= 0.85) & (rule_rank < RISK_RANK["low"])
    kept = (c("ai_level") == "normal") & (rule_rank >= RISK_RANK["suspicious"])
    blended = F.least(F.lit(100), F.greatest(F.lit(0), F.when(kept, F.greatest(rule, blend)).otherwise(blend)))
    raised = heard & ~free & (c("ai_level") != "normal") & (ai_rank > rule_rank)
    score = (F.when(heard & free & calm, F.least(blend, F.lit(24))).when(heard & free, blended)
             .when(raised, F.greatest(rule, ai)).otherwise(rule))
    rows = df.withColumn("_s", score.cast("long"))
    level = (F.when(heard & free & calm, "normal").when((heard & free) | raised, risk_level_from_score(c("_s")))
             .otherwise(c("rule_level")))
    rows = rows.withColumn("_l", level)
    lowered = ~free & (risk_rank(c("_l")) < rule_rank)
    known = F.coalesce("rule_reason", F.lit("")) if "rule_reason" in df.columns else F.lit("")
    sure, text = percent_text(conf), BLEND_TEXTS
    direction = (F.when(kept, BLEND_DIRECTIONS["kept"]).when(ai_rank > rule_rank, BLEND_DIRECTIONS["up"])
                 .otherwise(BLEND_DIRECTIONS["down"]))
    reason = (F.when(lowered, F.format_string(text["lowered"], known))
              .when(heard & free & calm, F.format_string(text["calm"], sure, known))
              .when(heard & free, F.format_string(text["blended"], direction, sure, percent_text(weight), known))
              .when(heard & ~free & (c("ai_level") == "normal"), F.format_string(text["preserved"], sure, known))
              .when(raised, F.format_string(text["raised"], sure, known)).otherwise(known))
    said = F.when(F.coalesce("ai_level", F.lit("")) != "", F.format_string(
        AI_PREDICTED, F.replace("ai_level", F.lit("_"), F.lit(" ")), sure)).otherwise(AI_UNHEARD)
    return rows.withColumns({"final_score": F.when(lowered, rule).otherwise(c("_s")).cast("long"),
                             "final_level": F.when(lowered, c("rule_level")).otherwise(c("_l")),
                             "final_reason": reason, "ai_reason": said}).drop("_s", "_l")


def with_wealth_segment(tx: DataFrame, accounts: DataFrame) -> DataFrame:
    """Adds the sender's ``wealth_segment``, ``average`` where there is no account or no segment. One row per transaction:
    of repeated account numbers the one with the greatest id counts."""
    segments = accounts.where("account_number IS NOT NULL").groupBy(F.col("account_number").alias("sender_account")).agg(
        F.max_by("wealth_segment", "id").alias("wealth_segment"))
    return tx.drop("wealth_segment").join(segments, "sender_account", "left").withColumn(
        "wealth_segment", F.coalesce("wealth_segment", F.lit("average")))


def calibrate_labelled_risk(df: DataFrame, label: str = "generated_label") -> DataFrame:
    """Keep score and level of labelled rows inside their label's band (``calibrated_score``, ``_level``)."""
    c = F.col
    kind, score = F.lower(F.coalesce(label, F.lit("normal"))), c("risk_score")
    must = F.coalesce("mandatory", F.lit(False))
    calm = (kind == "normal") & ~must
    raised = (F.when(kind == "normal", F.greatest(score, F.lit(35)))
              .when(kind == "suspicious", F.greatest(score, F.lit(45))).otherwise(F.greatest(score, F.lit(70))))
    value = F.when(calm, 20).otherwise(raised).cast("long")
    mild = kind.isin("normal", "suspicious")
    return df.withColumns({
        "calibrated_score": value,
        "calibrated_level": F.when(calm, "normal").when(mild & (value >= 60), "high_risk").when(mild, "suspicious")
        .when(value >= 80, "critical").otherwise("high_risk")})


def generate_alerts(scored: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Alert rows for material levels, one per transaction, unless the transaction already has one."""
    rules = F.to_json("rules") if "rules" in scored.columns else F.lit("[]")
    rows = scored.where(F.col("risk_level").isin(ALERT_LEVELS)).select(
        F.col("id").alias("transaction_id"), F.col("sender_account").alias("account_number"), "risk_score",
        "risk_level", "reason", rules.alias("rules_triggered"), F.lit("open").alias("status"), "ts")
    return rows if existing is None else rows.join(existing.select("transaction_id"), "transaction_id", "left_anti")


def generate_ctrs(scored: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Currency report rows for large cash, unless the transaction already has one."""
    cash = F.col("transaction_type").isin("deposit", "withdraw") & (F.col("amount") >= CTR_THRESHOLD)
    rows = scored.where(cash).select(F.col("id").alias("transaction_id"),
                                     F.col("sender_account").alias("account_number"), "amount",
                                     F.lit("system").alias("generated_by"), F.lit("pending").alias("status"),
                                     F.col("ts").alias("created_at"))
    return rows if existing is None else rows.join(existing.select("transaction_id"), "transaction_id", "left_anti")
