"""Risk fusion, calibration, alerts and currency reports."""

from pyspark.sql import functions as F

from checks.profiles import AS_OF_US as PROFILE_AS_OF_US
from checks.registry import define, query
from checks.rules import RISK_LEVEL, assessed
from moneytrail.functions import scalars
from moneytrail.operators import risk, windows
from moneytrail.plans import online
from moneytrail.plans.hot import find_hot_keys
from moneytrail.sources import views
import checks.patterns  # noqa: F401
import checks.profiles  # noqa: F401

define("batch_rules", """
SELECT t.*, a.pep_flag, count(*) OVER (PARTITION BY sender_account, receiver_account ORDER BY ts
  RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) = 0 AS is_new,
  least(100, CASE WHEN amount >= 10000 THEN 20 WHEN amount >= 5000 THEN 10 ELSE 0 END + (destination_country IN ('IR'))::INT * 25
  + coalesce(pep_flag, false)::INT * 15)::DOUBLE AS base
FROM transactions t LEFT JOIN accounts a ON a.account_number = t.sender_account""", "transactions", "accounts")


def with_flags(spark, d, tx=None):
    tx = views.transactions(spark, d) if tx is None else tx
    rows = windows.is_new_recipient(tx, find_hot_keys(tx, "sender_account"))
    flags = views.accounts(spark, d).select(F.col("account_number").alias("sender_account"), "pep_flag")
    return risk.batch_rule_score(rows.join(flags, "sender_account", "left"))


@query("batch_rule_score", "SELECT id, least(100, base + is_new::INT * 10)::DOUBLE AS batch_rule_score FROM batch_rules",
       "batch_rules")
def batch_rule_score(spark, d):
    return with_flags(spark, d).select("id", "batch_rule_score")


ML_RISK = ("least(100, greatest(0, CASE {p} WHEN 'normal' THEN 10 + (1 - {c}) * 20 WHEN 'suspicious' THEN 50 + {c} * 15 "
           "WHEN 'super_suspicious' THEN 85 + {c} * 15 ELSE 50 + {c} * 15 END + CASE WHEN {a} < 0 THEN abs({a}) * 10 ELSE 0 END))")
define("assessed_rows", f"""
SELECT id, predicted, confidence, anomaly, ml, rule, pattern_score, pattern_count, high_count, score,
  CASE WHEN high_count >= 2 THEN 'critical' WHEN high_count >= 1 AND score >= 40 THEN 'critical' WHEN high_count >= 1 THEN 'high'
    WHEN score >= 75 THEN 'critical' WHEN score >= 50 THEN 'high' WHEN score >= 25 THEN 'medium' ELSE 'low' END AS level
FROM (SELECT *, least(100, greatest(0, ml * (0.5::DOUBLE + confidence * 0.3::DOUBLE) + pattern_score * 0.3::DOUBLE + rule * 0.2::DOUBLE)) AS score
  FROM (SELECT p.*, s.pattern_score, s.pattern_count, s.high_count, least(100, b.base + b.is_new::INT * 10)::DOUBLE AS rule,
    {ML_RISK.format(p='predicted', c='confidence', a='anomaly')}::DOUBLE AS ml
    FROM predictions p JOIN pattern_scores s USING (id) JOIN batch_rules b USING (id)))""",
       "predictions", "pattern_scores", "batch_rules")


def assessed_rows(spark, d):
    tx = views.transactions(spark, d)
    accounts = views.accounts(spark, d).withColumn("customer_id", F.expr("id div 2"))
    model = views.predictions(spark, d).select("id", "predicted", "confidence", "anomaly")
    from checks.features import AS_OF_US
    return online.analyze(tx, accounts, model, AS_OF_US)


@query("composite_risk", """
SELECT id, round(score, 6) AS score, level, round(ml, 6) AS ml, pattern_score FROM assessed_rows""", "assessed_rows")
def composite_risk(spark, d):
    rows = assessed_rows(spark, d)
    score = risk.composite_score(F.col("ml_score"), F.col("confidence"), F.col("pattern_score"),
                                 F.col("batch_rule_score"))
    return rows.select("id", F.round(score, 6).alias("score"), F.col("assessed_level").alias("level"),
                       F.round("ml_score", 6).alias("ml"), "pattern_score")


@query("recommended_action", """
SELECT id, CASE level WHEN 'critical' THEN 'FREEZE_AND_ESCALATE' WHEN 'high' THEN CASE WHEN high_count >= 2 THEN 'FREEZE_AND_ESCALATE' ELSE 'HOLD_FOR_REVIEW' END
  WHEN 'medium' THEN 'ENHANCED_MONITORING' ELSE 'APPROVE' END AS action,
  CASE level WHEN 'critical' THEN 'immediate' ELSE level END AS priority,
  CASE level WHEN 'critical' THEN 'Within 1 hour' WHEN 'high' THEN CASE WHEN high_count >= 2 THEN 'Within 4 hours' ELSE 'Within 24 hours' END ELSE 'Immediate' END AS timeline
FROM assessed_rows""", "assessed_rows")
def recommended_action(spark, d):
    a = F.col("recommended_action")
    return assessed_rows(spark, d).select("id", a["action"].alias("action"), a["priority"].alias("priority"),
                                          a["timeline"].alias("timeline"))


@query("contributing_factors", """
SELECT id, factor, round(value, 6) AS value, row_number() OVER (PARTITION BY id ORDER BY value DESC, o) AS position FROM (
  SELECT id, 'ML Prediction' AS factor, ml AS value, 0 AS o FROM assessed_rows
  UNION ALL SELECT id, 'Fraud Patterns', pattern_score, 1 FROM assessed_rows WHERE pattern_score > 0
  UNION ALL SELECT id, 'Rule-Based Analysis', rule, 2 FROM assessed_rows WHERE rule > 0
  UNION ALL SELECT id, 'Anomaly Detection', abs(anomaly) * 100, 3 FROM assessed_rows WHERE anomaly < 0)""", "assessed_rows")
def contributing_factors(spark, d):
    rows = assessed_rows(spark, d).select("id", F.posexplode("contributing_factors").alias("position", "f"))
    return rows.select("id", F.col("f.factor").alias("factor"), F.round("f.value", 6).alias("value"),
                       (F.col("position") + 1).cast("long").alias("position"))


@query("factor_texts", """
SELECT id, CASE WHEN anomaly < 0 THEN 'Behavioral anomaly detected (score: ' || format('{:.2f}', anomaly) || ')' END AS anomaly_text
FROM predictions""", "predictions")
def factor_texts(spark, d):
    rows = views.predictions(spark, d)
    zero = F.lit(0.0)
    factors = risk.contributing_factors(zero, F.col("confidence"), zero, F.lit(0), zero, F.col("anomaly"))
    texts = risk.explain_factors(factors)
    return rows.select("id", F.array_max(F.filter(texts, lambda t: t.startswith("Behavioral"))).alias("anomaly_text"))


@query("assessment_display", """
SELECT id, upper(level) AS risk_level, CASE level WHEN 'low' THEN '✓ Normal' WHEN 'medium' THEN '⚠ Review' WHEN 'high' THEN '⚠⚠ High Risk' ELSE '🚨 Critical' END AS status,
  pattern_count FROM assessed_rows""", "assessed_rows")
def assessment_display(spark, d):
    return risk.format_assessment(assessed_rows(spark, d)).select("id", "risk_level", "status", "pattern_count")


@query("assessment_explanations")
def assessment_explanations(spark, d):
    return assessed_rows(spark, d).select("id", F.array_join("explanations", "; ").alias("text"))


define("model_levels", """
SELECT id, predicted AS ml_level, confidence AS ml_confidence FROM predictions""", "predictions")
define("online_rows", f"""
SELECT *, {RISK_LEVEL.format('risk_score')} AS risk_level FROM (
  SELECT *, greatest(rule_score, ai_score) AS risk_score FROM (
    SELECT t.*, m.ml_level, m.ml_confidence, b.behavioral_score, b.behavioral_level, s.total, s.sanctioned,
      least(100, coalesce(r.s, 0) + least(80, s.total))::BIGINT AS rule_score, coalesce(r.crit, false) OR s.sanctioned AS mandatory, coalesce(r.r07, false) AS r07,
      CAST(round_even(CASE WHEN ml_confidence >= 0.65 THEN CASE ml_level WHEN 'normal' THEN 10 WHEN 'suspicious' THEN 55 ELSE 90 END ELSE 0 END * ml_confidence * 0.65::DOUBLE
        + behavioral_score * least(0.9::DOUBLE, behavioral_score / 100.0::DOUBLE) * 0.35::DOUBLE, 0) AS BIGINT) AS ai_score
    FROM transactions t JOIN model_levels m USING (id) JOIN behavioral_risk b USING (id) JOIN tx_screening s USING (id) LEFT JOIN (
      SELECT id, sum(score_delta) AS s, bool_or(severity = 'critical') AS crit, bool_or(rule_id = 'R07') AS r07 FROM rule_hit_rows GROUP BY id) r USING (id)))""",
       "transactions", "model_levels", "behavioral_risk", "tx_screening", "rule_hit_rows")


def online_rows(spark, d):
    from moneytrail.operators.profiles import build_profiles
    tx = views.transactions(spark, d)
    model = views.predictions(spark, d).select("id", F.col("predicted").alias("ml_level"),
                                               F.col("confidence").alias("ml_confidence"))
    return online.score_online(tx, views.accounts(spark, d), views.watchlist(spark, d),
                               build_profiles(tx, PROFILE_AS_OF_US), model,
                               hot=find_hot_keys(tx, "sender_account"))


@query("score_online", """
SELECT id, rule_score, ai_score, risk_score, risk_level, mandatory, transaction_type IN ('deposit','withdraw') AND amount >= 10000 AS ctr_required,
  r07 OR risk_level IN ('suspicious','super_suspicious','high_risk','critical') AS sar_required FROM online_rows""", "online_rows")
def score_online(spark, d):
    return online_rows(spark, d).select("id", "rule_score", "ai_score", "risk_score", "risk_level", "mandatory",
                                        "ctr_required", "sar_required")


@query("online_risk", """
SELECT id, CAST(round_even(CASE WHEN ml_confidence >= 0.65 THEN CASE ml_level WHEN 'normal' THEN 10 WHEN 'suspicious' THEN 55 ELSE 90 END ELSE 0 END * ml_confidence * 0.65::DOUBLE, 0) AS BIGINT) AS ai_score
FROM model_levels""", "model_levels")
def online_risk(spark, d):
    rows = views.predictions(spark, d).select(
        "id", F.col("predicted").alias("ml_level"), F.col("confidence").alias("ml_confidence"),
        F.lit(0).cast("long").alias("rule_score"), F.lit(0).alias("behavioral_score"),
        F.lit("normal").alias("behavioral_level"))
    return risk.online_risk(rows).select("id", "ai_score")


@query("combine_rule_ai", f"""
SELECT id, final_score::BIGINT AS final_score, final_level, final_reason, ai_reason FROM (
 SELECT id, CASE WHEN lowered THEN rule_score ELSE s END AS final_score, CASE WHEN lowered THEN rule_level ELSE l END AS final_level,
  'AI behavior model predicted ' || replace(predicted, '_', ' ') || ' with ' || pct || ' confidence.' AS ai_reason,
  CASE WHEN lowered THEN 'Mandatory compliance rule preserved. ' || note
   WHEN heard AND NOT mandatory AND calm THEN 'AI-led behavior model recognized this as normal for the sender (' || pct || ' confidence), so non-mandatory rule risk was reduced. Rule review: ' || note
   WHEN heard AND NOT mandatory THEN 'AI-led behavior model ' || CASE WHEN kept THEN 'reviewed but did not downgrade' WHEN ar > rr THEN 'increased' ELSE 'tempered' END ||
     ' the behavioral risk (' || pct || ' confidence, ' || format('{{:.0f}}%', round(least(0.85::DOUBLE, greatest(0.6::DOUBLE, confidence)) * 100, 6)) || ' AI weighting). Rule review: ' || note
   WHEN heard AND predicted = 'normal' THEN 'Mandatory compliance rule preserved despite AI normal prediction (' || pct || ' confidence). Rule review: ' || note
   WHEN raised THEN 'Mandatory compliance rule preserved and AI behavior model added elevated context (' || pct || ' confidence). Rule review: ' || note
   ELSE note END AS final_reason FROM (
  SELECT *, mandatory AND lr < rr AS lowered FROM (
   SELECT *, CASE l WHEN 'normal' THEN 0 WHEN 'low' THEN 1 WHEN 'suspicious' THEN 2 WHEN 'critical' THEN 4 ELSE 3 END AS lr FROM (
    SELECT *, CASE WHEN heard AND NOT mandatory AND calm THEN 'normal' WHEN (heard AND NOT mandatory) OR raised THEN {RISK_LEVEL.format('s')} ELSE rule_level END AS l FROM (
     SELECT *, CASE WHEN heard AND NOT mandatory AND calm THEN least(blend, 24) WHEN heard AND NOT mandatory THEN least(100, greatest(0, CASE WHEN kept THEN greatest(rule_score, blend) ELSE blend END))
       WHEN raised THEN greatest(rule_score, ai) ELSE rule_score END AS s FROM (
      SELECT *, predicted = 'normal' AND confidence >= 0.85 AND rr < 1 AS calm, predicted = 'normal' AND rr >= 2 AS kept,
        heard AND mandatory AND predicted <> 'normal' AND ar > rr AS raised FROM (
       SELECT r.*, p.predicted, p.confidence, r.rule_score || ' points' AS note, format('{{:.0f}}%', round(p.confidence * 100, 6)) AS pct, r.critical_rule AS mandatory, p.confidence >= 0.55 AS heard, CASE predicted WHEN 'normal' THEN 10 WHEN 'suspicious' THEN 55 ELSE 90 END AS ai,
         CASE rule_level WHEN 'normal' THEN 0 WHEN 'low' THEN 1 WHEN 'suspicious' THEN 2 WHEN 'critical' THEN 4 ELSE 3 END AS rr,
         CASE predicted WHEN 'normal' THEN 0 WHEN 'suspicious' THEN 2 ELSE 3 END AS ar,
         CAST(round_even(CASE predicted WHEN 'normal' THEN 10 WHEN 'suspicious' THEN 55 ELSE 90 END * least(0.85::DOUBLE, greatest(0.6::DOUBLE, confidence))
           + rule_score * (1 - least(0.85::DOUBLE, greatest(0.6::DOUBLE, confidence))), 0) AS BIGINT) AS blend
       FROM rule_scores r JOIN predictions p USING (id))))))))""", "rule_scores", "predictions")
def combine_rule_ai(spark, d):
    from moneytrail.operators.rules import is_mandatory
    rows = is_mandatory(assessed(spark, d)).select("id", "rule_score", "rule_level", "mandatory",
                                                   F.concat(F.col("rule_score").cast("string"), F.lit(" points")).alias("rule_reason"))
    model = views.predictions(spark, d).select("id", F.col("predicted").alias("ai_level"),
                                               F.col("confidence").alias("ai_confidence"))
    return risk.combine_rule_ai(rows.join(model, "id")).select("id", "final_score", "final_level", "final_reason", "ai_reason")


@query("wealth_segments", """
SELECT t.id, coalesce(a.wealth_segment, 'average') AS wealth_segment FROM transactions t LEFT JOIN accounts a ON a.account_number = t.sender_account""",
       "transactions", "accounts")
def wealth_segments(spark, d):
    return risk.with_wealth_segment(views.transactions(spark, d), views.accounts(spark, d)).select("id", "wealth_segment")


@query("calibrate_labelled_risk", """
SELECT id, s::BIGINT AS calibrated_score, CASE WHEN calm THEN 'normal' WHEN actual IN ('normal','suspicious') THEN CASE WHEN s >= 60 THEN 'high_risk' ELSE 'suspicious' END
  WHEN s >= 80 THEN 'critical' ELSE 'high_risk' END AS calibrated_level FROM (
 SELECT *, CASE WHEN calm THEN 20 WHEN actual = 'normal' THEN greatest(rule_score, 35) WHEN actual = 'suspicious' THEN greatest(rule_score, 45) ELSE greatest(rule_score, 70) END AS s
 FROM (SELECT r.id, r.rule_score, p.actual, p.actual = 'normal' AND NOT r.critical_rule AS calm FROM rule_scores r JOIN predictions p USING (id)))""",
       "rule_scores", "predictions")
def calibrate_labelled_risk(spark, d):
    from moneytrail.operators.rules import is_mandatory
    rows = is_mandatory(assessed(spark, d)).select("id", F.col("rule_score").alias("risk_score"), "mandatory")
    labels = views.predictions(spark, d).select("id", F.col("actual").alias("generated_label"))
    return risk.calibrate_labelled_risk(rows.join(labels, "id")).select("id", "calibrated_score",
                                                                        "calibrated_level")


define("existing_alerts", "SELECT id AS transaction_id FROM transactions WHERE channel = 'branch'", "transactions")


def scored_by_rules(spark, d):
    rows = assessed(spark, d)
    return rows.withColumnsRenamed({"rule_level": "risk_level", "rule_reason": "reason"}).withColumn(
        "risk_score", F.col("rule_score"))


@query("generate_alerts", """
SELECT id AS transaction_id, sender_account AS account_number, rule_score AS risk_score, rule_level AS risk_level, 'open' AS status
FROM rule_scores WHERE rule_level IN ('suspicious','high_risk','critical') AND id NOT IN (SELECT transaction_id FROM existing_alerts)""",
       "rule_scores", "existing_alerts")
def generate_alerts(spark, d):
    existing = views.transactions(spark, d).where("channel = 'branch'").select(F.col("id").alias("transaction_id"))
    return risk.generate_alerts(scored_by_rules(spark, d), existing).select(
        "transaction_id", "account_number", "risk_score", "risk_level", "status")


@query("generate_ctrs", """
SELECT id AS transaction_id, sender_account AS account_number, CAST(amount AS DOUBLE) AS amount, 'pending' AS status FROM transactions
WHERE transaction_type IN ('deposit','withdraw') AND amount >= 10000 AND id NOT IN (SELECT transaction_id FROM existing_alerts)""",
       "transactions", "existing_alerts")
def generate_ctrs(spark, d):
    tx = views.transactions(spark, d)
    existing = tx.where("channel = 'branch'").select(F.col("id").alias("transaction_id"))
    return risk.generate_ctrs(tx, existing).select("transaction_id", "account_number",
                                                   F.col("amount").cast("double").alias("amount"), "status")


@query("ml_adjust", """
SELECT id, CASE WHEN a THEN 'suspicious' WHEN b AND predicted <> 'super_suspicious' AND confidence < 0.70 THEN 'super_suspicious' ELSE predicted END AS predicted,
  CASE WHEN a THEN greatest(confidence, 0.62) WHEN b THEN greatest(confidence, 0.72) ELSE confidence END AS confidence
FROM (SELECT *, anomaly < -0.05 AND predicted = 'normal' AS a, NOT (anomaly < -0.05 AND predicted = 'normal') AND anomaly < -0.15 AS b FROM predictions)""",
       "predictions")
def ml_adjust(spark, d):
    return risk.adjust_prediction(views.predictions(spark, d)).select("id", "predicted", "confidence")


@query("ml_adjust_batch", """
SELECT id, CASE WHEN a THEN 'suspicious' WHEN b AND predicted <> 'super_suspicious' AND confidence < 0.75 THEN 'super_suspicious' ELSE predicted END AS predicted,
  CASE WHEN a THEN greatest(confidence, 0.65) WHEN b THEN greatest(confidence, 0.78) ELSE confidence END AS confidence
FROM (SELECT *, anomaly < -0.05 AND predicted = 'normal' AS a, NOT (anomaly < -0.05 AND predicted = 'normal') AND anomaly < -0.15 AS b FROM predictions)""",
       "predictions")
def ml_adjust_batch(spark, d):
    return risk.adjust_prediction(views.predictions(spark, d), "batch").select("id", "predicted", "confidence")


@query("ml_risk_score", f"SELECT id, round({ML_RISK.format(p='predicted', c='confidence', a='anomaly')}, 6)::DOUBLE AS ml_risk_score FROM predictions",
       "predictions")
def ml_risk_score(spark, d):
    score = risk.ml_risk_score(F.col("predicted"), F.col("confidence"), F.col("anomaly"))
    return views.predictions(spark, d).select("id", F.round(score, 6).alias("ml_risk_score"))


@query("level_maps", f"""
SELECT id, rule_score, {RISK_LEVEL.format('rule_score')} AS level, CASE WHEN rule_score >= 75 THEN 'critical' WHEN rule_score >= 50 THEN 'high' WHEN rule_score >= 25 THEN 'medium' ELSE 'low' END AS composite,
  CASE WHEN rule_level IN ('normal','low') AND rule_score < 25 THEN 'normal' WHEN rule_level IN ('high_risk','critical') OR rule_score >= 60 THEN 'super_suspicious'
    WHEN rule_level = 'suspicious' OR rule_score >= 25 THEN 'suspicious' ELSE 'normal' END AS label,
  CASE rule_level WHEN 'normal' THEN 0 WHEN 'low' THEN 1 WHEN 'suspicious' THEN 2 WHEN 'critical' THEN 4 ELSE 3 END::BIGINT AS rank
FROM rule_scores""", "rule_scores")
def level_maps(spark, d):
    score = F.col("rule_score")
    return assessed(spark, d).select(
        "id", "rule_score", scalars.risk_level_from_score(score).alias("level"),
        scalars.composite_level(score).alias("composite"),
        scalars.training_label(F.col("rule_level"), score).alias("label"),
        scalars.risk_rank(F.col("rule_level")).cast("long").alias("rank"))


@query("country_risk", """
SELECT id, CASE WHEN destination_country IN ('IR','RU','ZW') THEN 1.0 WHEN destination_country IN ('NG','AE') THEN 0.5 ELSE 0.0 END::DOUBLE AS risk
FROM transactions""", "transactions")
def country_risk(spark, d):
    return views.transactions(spark, d).select("id", scalars.country_risk(F.col("destination_country")).alias("risk"))

