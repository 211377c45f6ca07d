"""Event envelopes and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def transaction_payload(df: DataFrame) -> DataFrame:
    """The columns a transaction event carries, with the defaults clients rely on."""
    return df.select(
        "id", "sender_account", "receiver_account", F.col("amount").cast("double").alias("amount"),
        F.col("transaction_type").alias("type"), "transaction_type", "timestamp", "risk_level",
        F.coalesce(F.col("risk_score").cast("double"), F.lit(0.0)).alias("risk_score"),
        F.coalesce("rule_level", F.lit("normal")).alias("rule_level"),
        F.coalesce(F.col("rule_score").cast("double"), F.lit(0.0)).alias("rule_score"),
        F.coalesce("ai_risk_level", F.lit("unavailable")).alias("ai_risk_level"),
        F.coalesce(F.col("ai_confidence").cast("double"), F.lit(0.0)).alias("ai_confidence"),
        F.coalesce("ctr_required", F.lit(False)).alias("ctr_required"),
        F.coalesce("sar_required", F.lit(False)).alias("sar_required"),
        F.coalesce("channel", F.lit("online")).alias("channel"),
        F.coalesce("description", F.lit("")).alias("description"))


def balance_payload(accounts: DataFrame) -> DataFrame:
    return accounts.select(F.col("id").alias("user_id"), "username", "account_number",
                           F.coalesce(F.col("balance").cast("double"), F.lit(0.0)).alias("balance"), "kyc_status")


def envelope(df: DataFrame, event: str, key: Column, publisher: str = "moneytrail") -> DataFrame:
    """``(topic, key, value)`` rows: the payload row as JSON inside ``{event, data, publisher}``."""
    data = F.struct(*[F.col(c) for c in df.columns])
    return df.select(F.lit("aml-events").alias("topic"), key.cast("string").alias("key"),
                     F.to_json(F.struct(F.lit(event).alias("event"), data.alias("data"),
                                        F.lit(publisher).alias("publisher"))).alias("value"))


def write_events(df: DataFrame, sink: str = "json", path: str | None = None, **options) -> None:
    """Write envelopes to a Kafka topic (``sink="kafka"``, broker in ``options``) or to JSON files."""
    if sink == "kafka":
        df.write.format("kafka").options(**options).save()
    else:
        df.write.mode("append").format(sink).options(**options).save(path)
