"""Prediction feedback, retraining triggers, experiments, model catalogue, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moneytrail.constants import DAY_US
from moneytrail.operators import learning


def feedback(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Predictions that have a ground-truth label, with whether they were right."""
    rows = predictions.select("id", F.col("predicted").alias("predicted_label"), "confidence").join(
        labels.select("id", F.col("actual").alias("actual_label")), "id")
    return rows.withColumn("is_correct", F.col("predicted_label") == F.col("actual_label"))


def label_queue(feedback_rows: DataFrame) -> DataFrame:
    """Wrong predictions, to learn from."""
    return feedback_rows.where(~F.col("is_correct")).select("id", F.col("actual_label").alias("label"))


def retrain_triggers(labels: DataFrame, history: DataFrame, as_of_us: int, min_labels: int = 100,
                     max_age_days: int = 30, drift: float = 0.15) -> DataFrame:
    """One row: pending labels, days since the last training, drift of the last score, and whether to retrain.

    ``history`` has ``ts_us`` and ``f1`` per training and evaluation, ``kind`` ``train`` or ``eval``.
    """
    pending = labels.agg(F.count(F.lit(1)).alias("new_labels"))
    past = history.agg(F.max(F.when(F.col("kind") == "train", F.struct("ts_us", "f1"))).alias("t"),
                       F.max(F.struct("ts_us", "f1")).alias("e"), F.count(F.lit(1)).alias("entries"))
    joined = pending.select("new_labels", F.lit(None).cast("struct<ts_us:bigint,f1:double>").alias("t"),
                            F.lit(None).cast("struct<ts_us:bigint,f1:double>").alias("e"),
                            F.lit(None).cast("long").alias("entries")).unionByName(
        past.select(F.lit(None).cast("long").alias("new_labels"), "t", "e", "entries"))
    row = joined.agg(F.max("new_labels").alias("new_labels"), F.max("t").alias("t"), F.max("e").alias("e"),
                     F.max("entries").alias("entries"))
    days = F.floor((F.lit(as_of_us) - F.col("t.ts_us")) / DAY_US)
    enough = F.col("new_labels") >= min_labels
    old = F.coalesce(days >= max_age_days, F.lit(False))
    worse = F.coalesce((F.col("entries") >= 2) & (F.col("e.f1") < F.col("t.f1") * (1 - drift)), F.lit(False))
    return row.select("new_labels", days.alias("days_since_retrain"), F.col("e.f1").alias("recent_f1"),
                      F.col("t.f1").alias("trained_f1"), enough.alias("enough_labels"), old.alias("too_old"),
                      worse.alias("drifted"), (enough | old | worse).alias("should_retrain"))


def retrain(labelled: DataFrame, columns: list[str], current_f1: float | None, trained_us: int, trees: int = 200,
            depth: int = 12):
    """Train, cross-validate, and promote only if f1 improves: ``(model, history row)``.  The forest is as large as a first one."""
    model = learning.train_classifier(labelled, columns, trees, depth)
    scores = learning.cross_validate(labelled, columns, trees, depth)
    f1 = None if scores is None else scores.first()["f1_weighted"]
    promoted = current_f1 is None or (f1 is not None and f1 > current_f1)
    row = labelled.sparkSession.createDataFrame([(trained_us, "train", f1, promoted)],
                                                "ts_us long, kind string, f1 double, promoted boolean")
    return (model if promoted else None), row


def ab_results(df: DataFrame) -> DataFrame:
    """Per arm: predictions, labelled ones, accuracy among those."""
    right = F.count_if(F.col("actual").isNotNull() & (F.col("predicted") == F.col("actual")))
    labelled = F.count("actual")
    return df.groupBy("arm").agg(F.count(F.lit(1)).alias("total_predictions"), labelled.alias("labeled_predictions"),
                                 F.when(labelled > 0, right / labelled).otherwise(0.0).alias("accuracy"))


def assign_arm(df: DataFrame, split: float = 0.5, by_hash: bool = True) -> DataFrame:
    """Deterministic arm per id: ``a`` for about the ``split`` share."""
    place = F.pmod(F.xxhash64("id"), F.lit(10_000)) if by_hash else F.pmod("id", F.lit(10_000))
    return df.withColumn("arm", F.when(place < int(round(split * 10_000)), "a").otherwise("b"))


def model_catalog(events: DataFrame, deployed_only: bool = False) -> DataFrame:
    """Latest state of every model, newest registration first, and which one is current.

    ``events`` has ``id``, ``model_id``, ``ts_us``, ``action``.  Deploying a model undeploys the one before it, so a
    model is deployed only if the latest deployment of all is its own and it was not undeployed since.
    """
    at = F.struct("ts_us", "id")
    per = events.groupBy("model_id").agg(
        F.min("ts_us").alias("registered_us"), F.max(F.when(F.col("action") == "deployed", at)).alias("up"),
        F.max(F.when(F.col("action") == "undeployed", at)).alias("down"), F.count(F.lit(1)).alias("events"))
    newest = per.agg(F.max("up")).scalar()
    live = F.coalesce((F.col("up") == newest) & (F.col("down").isNull() | (F.col("down") < F.col("up"))), F.lit(False))
    out = per.select("model_id", "registered_us", F.col("up.ts_us").alias("deployed_us"), live.alias("is_deployed"),
                     "events")
    out = out.where("is_deployed") if deployed_only else out
    return out.orderBy(F.col("registered_us").desc(), "model_id")


def model_comparison(events: DataFrame, metrics: list[str], models: list[str]) -> DataFrame:
    """Metric by model: the latest value of each."""
    pairs = ", ".join(f"'{m}', {m}" for m in metrics)
    long = events.where(F.col("model_id").isin(models)).selectExpr(
        "model_id", "ts_us", "id", f"stack({len(metrics)}, {pairs}) AS (metric, value)")
    last = long.groupBy("metric", "model_id").agg(F.max_by("value", F.struct("ts_us", "id")).alias("value"))
    return last.groupBy("metric").pivot("model_id", models).agg(F.max("value"))


def performance_summary(events: DataFrame, labels: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` evaluations with the current model and the number of pending labels on each row."""
    recent = events.orderBy(F.col("ts_us").desc(), F.col("id").desc()).limit(n).select("id", "model_id", "ts_us", "f1")
    current = model_catalog(events, True).select(F.col("model_id").alias("current_model")).limit(1)
    pending = labels.agg(F.count(F.lit(1)).alias("new_labels_pending"))
    one = pending.withColumn("_k", F.lit(1)).join(current.withColumn("_k", F.lit(1)), "_k", "left")
    return recent.withColumn("_k", F.lit(1)).join(F.broadcast(one), "_k", "left").drop("_k")  # one row


def system_status(events: DataFrame, labels: DataFrame, history: DataFrame, as_of_us: int, features: dict) -> DataFrame:
    """One row: current model, pending labels, whether to retrain, enabled features."""
    trig = retrain_triggers(labels, history, as_of_us).select(
        F.lit(1).alias("_k"), F.col("new_labels").alias("new_labels_pending"), "should_retrain")
    current = model_catalog(events, True).limit(1).select(
        F.lit(1).alias("_k"), F.col("model_id").alias("current_model"), F.col("deployed_us").alias("deployed_us"))
    return trig.join(F.broadcast(current), "_k", "left").select(  # one row
        F.col("current_model").isNotNull().alias("is_initialized"), "current_model", "deployed_us",
        "new_labels_pending", "should_retrain", *[F.lit(v).alias(k) for k, v in features.items()])
