"""Training sets, metrics, feedback, experiments, catalogue; models are checked by rows and in the tests."""

from pyspark.sql import functions as F

from checks.features import AS_OF_US, model_vector
from checks.registry import define, query
from checks.rules import assessed
from moneytrail.functions.scalars import training_label
from moneytrail.operators import explain, feedback, forest, learning
from moneytrail.operators.features import FEATURES_25
from moneytrail.sources import views
import checks.features  # noqa: F401

LABEL = """CASE WHEN rule_level IN ('normal','low') AND rule_score < 25 THEN 'normal' WHEN rule_level IN ('high_risk','critical') OR rule_score >= 60 THEN 'super_suspicious'
  WHEN rule_level = 'suspicious' OR rule_score >= 25 THEN 'suspicious' ELSE 'normal' END"""


def labelled(spark, d):
    """Model vectors of all transactions, labelled by the ground truth of the predictions view."""
    truth = views.predictions(spark, d).select("id", F.col("actual").alias("label"))
    return model_vector(spark, d).join(truth, "id")


@query("training_label_distribution", f"SELECT {LABEL} AS label, count(*) AS n FROM rule_scores GROUP BY 1", "rule_scores")
def training_label_distribution(spark, d):
    rows = assessed(spark, d).select("id", training_label(F.col("rule_level"), F.col("rule_score")).alias("label"))
    return learning.label_distribution(rows)


@query("training_set", """
SELECT p.actual AS label, count(*) AS n, round(avg(f.amount), 6) AS mean_amount FROM features_25 f JOIN predictions p USING (id) GROUP BY 1""",
       "features_25", "predictions")
def training_set(spark, d):
    rows = learning.training_set(labelled(spark, d), FEATURES_25, learning.bootstrap_rows(spark))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("amount"), 6).alias("mean_amount"))


@query("classification_metrics", """
WITH c AS (SELECT l, (SELECT count(*) FROM predictions WHERE actual = l) AS s, (SELECT count(*) FROM predictions WHERE predicted = l) AS c,
  (SELECT count(*) FROM predictions WHERE actual = l AND predicted = l) AS h FROM (SELECT unnest(['normal','suspicious','super_suspicious']) AS l)),
p AS (SELECT *, CASE WHEN c > 0 THEN h::DOUBLE / c ELSE 0 END AS pr, CASE WHEN s > 0 THEN h::DOUBLE / s ELSE 0 END AS rc FROM c)
SELECT sum(s)::BIGINT AS rows, round(sum(h) / sum(s), 9) AS accuracy, round(sum(pr * s) / sum(s), 9) AS precision_weighted, round(sum(rc * s) / sum(s), 9) AS recall_weighted,
  round(sum(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END * s) / sum(s), 9) AS f1_weighted FROM p""", "predictions")
def classification_metrics(spark, d):
    m = learning.classification_metrics(views.predictions(spark, d))
    return m.select("rows", *[F.round(c, 9).alias(c) for c in m.columns if c != "rows"])


@query("confusion_matrix", "SELECT actual, predicted, count(*) AS n FROM predictions GROUP BY 1, 2", "predictions")
def confusion_matrix(spark, d):
    return learning.confusion_matrix(views.predictions(spark, d))


_SUMMARY = ["amount", "sender_avg_amount", "sender_tx_count", "sender_volume_24h", "amount_to_sender_avg"]


@query("feature_summary", "\nUNION ALL ".join(f"""
SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, round(min({c}), 6) AS min, round(max({c}), 6) AS max,
  round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.75), 6) AS q75 FROM features_25""" for c in _SUMMARY),
       "features_25")
def feature_summary(spark, d):
    rows = model_vector(spark, d).select("id", *_SUMMARY)
    out = explain.feature_summary(rows, _SUMMARY)
    return out.select("feature", *[F.round(c, 6).alias(c) for c in out.columns if c != "feature"])


@query("global_importance", "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg(abs({c} - m_{c})), 6) AS mean_abs FROM features_25, (SELECT avg({c}) AS m_{c} FROM features_25)"
    for c in _SUMMARY), "features_25")
def global_importance(spark, d):
    """Over a stand-in attribution table: the deviation of a feature from its mean."""
    rows = model_vector(spark, d).select("id", *_SUMMARY)
    means = rows.agg(*[F.avg(c).alias(c) for c in _SUMMARY]).first()
    pairs = ", ".join(f"'{c}', {c} - {means[c]!r}D" for c in _SUMMARY)
    long = rows.selectExpr("id", f"stack({len(_SUMMARY)}, {pairs}) AS (feature, attribution)")
    return explain.global_importance(long).select("feature", F.round("mean_abs", 6).alias("mean_abs"))


def _feedback(spark, d):
    p = views.predictions(spark, d)
    return feedback.feedback(p, p.where("anomaly < 0.1").select("id", "actual"))


@query("feedback", """
SELECT id, predicted AS predicted_label, actual AS actual_label, confidence, predicted = actual AS is_correct FROM predictions WHERE anomaly < 0.1""", "predictions")
def feedback_rows(spark, d):
    return _feedback(spark, d)


@query("label_queue", "SELECT id, actual AS label FROM predictions WHERE anomaly < 0.1 AND predicted <> actual", "predictions")
def label_queue(spark, d):
    return feedback.label_queue(_feedback(spark, d))


def _history(spark, d):
    e = views.model_events(spark, d)
    return e.select("ts_us", "f1", F.when(F.col("action") == "deployed", "train").otherwise("eval").alias("kind"))


define("retrain_row", f"""
SELECT n AS new_labels, (({AS_OF_US} + 86400000000 * 40) - t.ts_us) // 86400000000 AS days_since_retrain, e.f1 AS recent_f1, t.f1 AS trained_f1
FROM (SELECT count(*) AS n FROM predictions WHERE anomaly < 0.1 AND predicted <> actual),
  (SELECT ts_us, f1 FROM model_events WHERE action = 'deployed' ORDER BY ts_us DESC, f1 DESC LIMIT 1) t,
  (SELECT ts_us, f1 FROM model_events ORDER BY ts_us DESC, f1 DESC LIMIT 1) e""", "predictions", "model_events")


@query("retrain_triggers", """
SELECT *, new_labels >= 100 AS enough_labels, days_since_retrain >= 30 AS too_old, recent_f1 < trained_f1 * 0.85::DOUBLE AS drifted,
  new_labels >= 100 OR days_since_retrain >= 30 OR recent_f1 < trained_f1 * 0.85::DOUBLE AS should_retrain FROM retrain_row""", "retrain_row")
def retrain_triggers(spark, d):
    return feedback.retrain_triggers(label_queue(spark, d), _history(spark, d), AS_OF_US + 86_400_000_000 * 40)


@query("ab_results", """
SELECT arm, count(*) AS total_predictions, count(*) FILTER (anomaly < 0.1) AS labeled_predictions,
  (count(*) FILTER (anomaly < 0.1 AND predicted = actual))::DOUBLE / count(*) FILTER (anomaly < 0.1) AS accuracy FROM predictions GROUP BY 1""", "predictions")
def ab_results(spark, d):
    rows = views.predictions(spark, d).withColumn("actual", F.when(F.col("anomaly") < 0.1, F.col("actual")))
    return feedback.ab_results(rows)


@query("ab_assign", "SELECT id, CASE WHEN id % 10000 < 3000 THEN 'a' ELSE 'b' END AS arm FROM transactions", "transactions")
def ab_assign(spark, d):
    return feedback.assign_arm(views.transactions(spark, d).select("id"), 0.3, by_hash=False)


define("catalog", """
WITH p AS (SELECT model_id, min(ts_us) AS registered_us, max((ts_us, id)) FILTER (action = 'deployed') AS up, max((ts_us, id)) FILTER (action = 'undeployed') AS down, count(*) AS events
  FROM model_events GROUP BY 1)
SELECT model_id, registered_us, up[1] AS deployed_us, coalesce(up = (SELECT max(up) FROM p) AND (down IS NULL OR down < up), false) AS is_deployed, events FROM p""", "model_events")


@query("model_catalog", "SELECT * FROM catalog", "catalog")
def model_catalog(spark, d):
    return feedback.model_catalog(views.model_events(spark, d))


@query("model_comparison", """
SELECT 'f1' AS metric, arg_max(f1, (ts_us, id)) FILTER (model_id = 'model-1') AS "model-1", arg_max(f1, (ts_us, id)) FILTER (model_id = 'model-2') AS "model-2" FROM model_events
UNION ALL SELECT 'accuracy', arg_max(accuracy, (ts_us, id)) FILTER (model_id = 'model-1'), arg_max(accuracy, (ts_us, id)) FILTER (model_id = 'model-2') FROM model_events""", "model_events")
def model_comparison(spark, d):
    return feedback.model_comparison(views.model_events(spark, d), ["f1", "accuracy"], ["model-1", "model-2"])


@query("performance_summary", """
SELECT id, model_id, ts_us, f1, (SELECT count(*) FROM predictions WHERE anomaly < 0.1 AND predicted <> actual) AS new_labels_pending,
  (SELECT model_id FROM catalog WHERE is_deployed) AS current_model FROM model_events ORDER BY ts_us DESC, id DESC LIMIT 10""", "model_events", "catalog", "predictions")
def performance_summary(spark, d):
    return feedback.performance_summary(views.model_events(spark, d), label_queue(spark, d))


@query("system_status", """
SELECT (SELECT count(*) FROM catalog WHERE is_deployed) > 0 AS is_initialized, (SELECT model_id FROM catalog WHERE is_deployed) AS current_model, (SELECT deployed_us FROM catalog WHERE is_deployed) AS deployed_us,
  new_labels AS new_labels_pending, new_labels >= 100 OR days_since_retrain >= 30 OR recent_f1 < trained_f1 * 0.85::DOUBLE AS should_retrain, true AS explainability FROM retrain_row""", "catalog", "retrain_row")
def system_status(spark, d):
    return feedback.system_status(views.model_events(spark, d), label_queue(spark, d), _history(spark, d),
                                  AS_OF_US + 86_400_000_000 * 40, {"explainability": True})


@query("bootstrap_labels", """
SELECT label, count(*) AS n, round(sum(amount), 2) AS amount FROM (SELECT p.actual AS label, f.amount FROM features_25 f JOIN predictions p USING (id)
  UNION ALL SELECT unnest(['normal','normal','normal','suspicious','suspicious','suspicious','super_suspicious','super_suspicious','super_suspicious','suspicious']),
    unnest([45.0::DOUBLE, 120, 350, 9500, 9800, 5500, 15000, 25000, 12000, 500])) GROUP BY 1""", "features_25", "predictions")
def bootstrap_labels(spark, d):
    rows = labelled(spark, d).unionByName(learning.bootstrap_rows(spark))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


# --- models: no SQL form ---------------------------------------------------------------------------------------

@query("train_predict")
def train_predict(spark, d):
    rows = learning.training_set(labelled(spark, d), FEATURES_25)
    model = learning.train_classifier(rows, FEATURES_25)
    return learning.best_class(learning.predict_proba(model, rows), learning.classes_of(model))


@query("train_ensemble")
def train_ensemble(spark, d):
    rows = learning.training_set(labelled(spark, d), FEATURES_25)
    model = learning.train_ensemble(rows, FEATURES_25)
    return learning.best_class(model.predict_proba(rows), model.classes)


@query("cross_validation")
def cross_validation(spark, d):
    rows = learning.training_set(labelled(spark, d), FEATURES_25)
    return learning.cross_validate(rows, FEATURES_25, trees=10, depth=5)


@query("retrain")
def retrain(spark, d):
    rows = learning.training_set(labelled(spark, d), FEATURES_25)
    return feedback.retrain(rows, FEATURES_25, 0.5, AS_OF_US)[1]


@query("isolation_scores")
def isolation_scores(spark, d):
    return forest.isolation_forest(model_vector(spark, d), FEATURES_25)


@query("oversample")
def oversample(spark, d):
    return learning.oversample(labelled(spark, d), FEATURES_25)


@query("attribution")
def attribution(spark, d):
    rows = learning.training_set(labelled(spark, d), FEATURES_25)
    model = learning.train_classifier(rows, FEATURES_25)
    return explain.attribute(rows, model, FEATURES_25, "super_suspicious")
