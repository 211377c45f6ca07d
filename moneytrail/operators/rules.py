"""Typology rules R01 to R11, their history columns, and the rollup to a score and level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moneytrail.constants import (COUNTRY_LISTS, CTR_THRESHOLD, DAILY_OUTFLOW, DAY_US, HOUR_US, LARGE_CASH,
                                  RULE_STRUCTURING_BAND, SAR_LEVELS, SAR_TRANSFER, SMALL_DEPOSIT)
from moneytrail.functions.scalars import is_night, money_text, risk_level_from_score
from moneytrail.operators.windows import RECEIVER, SENDER, distinct_measure, on_sender
from moneytrail.plans.hot import NO_HOT_KEYS, HotKeys
from moneytrail.plans.scan import Measure, count_measure, neighbours, prior
from moneytrail.sources.schema import RULE_HIT

HISTORY = ["prior_count_1h", "prior_cents_1h", "small_deposit_count_1h", "small_deposit_cents_1h",
           "outflow_cents_24h", "recipients_1h"]


def rule_history(df: DataFrame, hot: HotKeys = NO_HOT_KEYS, partitioned: bool = False) -> DataFrame:
    """The six history columns the rules read: one shuffle on the sender, none if ``df`` is ``partitioned`` by it."""
    kind = F.col("transaction_type")
    transfer = kind == "transfer"
    small = (kind == "deposit") & (F.col("amount") < SMALL_DEPOSIT)
    outflow = kind.isin("transfer", "withdraw")
    rows = df.withColumn("_on", F.coalesce(transfer, F.lit(False)))
    rows = rows if partitioned else on_sender(rows, hot)
    rows = neighbours(rows, [SENDER, RECEIVER, "_on"], hot=hot)
    rows = prior(rows, SENDER, [
        count_measure("prior_count_1h", None, HOUR_US),
        Measure("prior_cents_1h", F.col("cents"), "sum", HOUR_US),
        count_measure("small_deposit_count_1h", small, HOUR_US),
        Measure("small_deposit_cents_1h", F.when(small, F.col("cents")), "sum", HOUR_US),
        Measure("outflow_cents_24h", F.when(outflow, F.col("cents")), "sum", DAY_US),
        distinct_measure("_others_1h", F.col("_on"), HOUR_US)], hot=hot, partitioned=True)
    known = F.coalesce(F.col("_on") & (F.col("_prev") >= F.col("ts_us") - HOUR_US), F.lit(False))
    return (rows.withColumn("recipients_1h", F.col("_others_1h") + F.when(known, 0).otherwise(1))
            .drop("_on", "_next", "_prev", "_others_1h"))


def _hit(when: Column, rule: str, points: int, reason: Column, severity: str, typology: str, **evidence) -> Column:
    pairs = [x for k, v in evidence.items() for x in (F.lit(k), v.cast("string"))]
    facts = F.create_map(*pairs) if pairs else F.lit(None)
    return F.when(when, F.struct(
        F.lit(rule).alias("rule_id"), F.lit(points).cast("long").alias("score_delta"), reason.alias("reason"),
        F.lit(severity).alias("severity"), F.lit(typology).alias("typology"),
        facts.cast("map<string,string>").alias("evidence")))


def _dollars(cents: Column) -> Column:
    return money_text((cents / 100).cast("decimal(20,2)"))


def rule_structs() -> list[Column]:
    """One nullable struct per rule, in rule order."""
    amount, cents, kind = F.col("amount"), F.col("cents"), F.col("transaction_type")
    cash = kind.isin("deposit", "withdraw")
    transfer = kind == "transfer"
    lo, hi = RULE_STRUCTURING_BAND
    small_n = F.col("small_deposit_count_1h") + 1
    small_total = cents + F.col("small_deposit_cents_1h")
    hour_n = F.col("prior_count_1h") + 1
    hour_total = cents + F.col("prior_cents_1h")
    recipients = F.col("recipients_1h")
    outflow = cents + F.col("outflow_cents_24h")
    hour = F.hour("ts")
    country = F.upper(F.coalesce(F.nullif(F.col("destination_country"), F.lit("")), F.lit("ZW")))
    text = F.concat
    return [
        F.coalesce(
            _hit(cash & (amount >= CTR_THRESHOLD), "R01", 45,
                 text(F.lit("Cash transaction of "), money_text(amount), F.lit(" meets the CTR threshold")),
                 "critical", "Large Cash", amount=amount, threshold=F.lit(CTR_THRESHOLD)),
            _hit(cash & (amount >= LARGE_CASH), "R01", 20,
                 text(F.lit("Large cash transaction of "), money_text(amount)), "warning", "Large Cash",
                 amount=amount)),
        _hit(amount.between(lo, hi), "R02", 50,
             text(money_text(amount), F.lit(" falls in the structuring watch band")), "critical", "Structuring",
             amount=amount),
        _hit((kind == "deposit") & (amount < SMALL_DEPOSIT) & (small_n >= 3), "R03", 40,
             text(small_n.cast("string"), F.lit(" small deposits totalling "), _dollars(small_total),
                  F.lit(" within 60 minutes")), "critical", "Smurfing", count=small_n, total=small_total / 100),
        _hit(hour_n >= 5, "R04", 35,
             text(hour_n.cast("string"), F.lit(" transactions totalling "), _dollars(hour_total),
                  F.lit(" within 60 minutes")), "critical", "Velocity / Layering", count=hour_n,
             total=hour_total / 100),
        _hit(transfer & (recipients >= 3), "R05", 35,
             text(F.lit("Transfers to "), recipients.cast("string"), F.lit(" recipients within 60 minutes")),
             "critical", "Fan-Out / Layering", recipients=recipients),
        _hit(transfer & (amount >= 1000) & (cents % 100_000 == 0), "R06", 15,
             text(F.lit("Round-number transfer of $"), F.format_number(amount, 0)), "info", "Round Amount",
             amount=amount),
        _hit(transfer & (amount >= SAR_TRANSFER), "R07", 30,
             text(F.lit("Transfer of "), money_text(amount), F.lit(" meets SAR review threshold")), "critical",
             "SAR Trigger", amount=amount),
        _hit(transfer & (F.col(SENDER) == F.col(RECEIVER)), "R08", 25,
             F.lit("Self-transfer indicates a possible pass-through account"), "warning", "Self-Transfer"),
        _hit(kind.isin("transfer", "withdraw") & (outflow > DAILY_OUTFLOW * 100), "R09", 30,
             text(F.lit("24-hour outflow of "), _dollars(outflow), F.lit(" exceeds the monitoring threshold")),
             "warning", "Unusual Volume", outflow=outflow / 100),
        _hit((amount >= 1000) & is_night(hour), "R10", 20,
             text(money_text(amount), F.lit(" transaction at "), F.lpad(hour.cast("string"), 2, "0"),
                  F.lit(":00 is off-hours activity")), "warning", "Off-Hours Activity", hour=hour),
        _hit(country.isin(COUNTRY_LISTS["rules_high"]), "R11", 55,
             text(F.lit("Transaction involves high-risk jurisdiction "), country), "critical",
             "High-Risk Geography", country=country),
    ]


def assess_rules(df: DataFrame, hot: HotKeys = NO_HOT_KEYS, enabled: bool = True,
                 partitioned: bool = False) -> DataFrame:
    """Add ``rules`` (array of hits), ``rule_score``, ``rule_level`` and ``rule_reason``."""
    if not enabled:
        return df.withColumns({"rules": F.array().cast(f"array<{RULE_HIT.simpleString()}>"),
                               "rule_score": F.lit(0).cast("long"), "rule_level": F.lit("normal"),
                               "rule_reason": F.lit("Rule engine disabled - AI-only mode")})
    rows = rule_history(df, hot, partitioned).withColumn("rules", F.array_compact(F.array(*rule_structs())))
    return rollup(rows).drop(*HISTORY)


def rollup(df: DataFrame) -> DataFrame:
    """Score (capped at 100), level and joined reasons of the ``rules`` array."""
    total = F.aggregate(F.transform("rules", lambda h: h["score_delta"]), F.lit(0).cast("long"), lambda a, x: a + x)
    reasons = F.concat_ws("; ", F.transform("rules", lambda h: h["reason"]))
    return (df.withColumn("rule_score", F.least(F.lit(100), total).cast("long"))
            .withColumns({"rule_level": risk_level_from_score(F.col("rule_score")),
                          "rule_reason": F.when(reasons == "", "No rule indicators").otherwise(reasons)}))


def rule_hits(assessed: DataFrame) -> DataFrame:
    """One row per transaction and rule."""
    return assessed.select("id", F.explode("rules").alias("hit")).select("id", "hit.*")


def ctr_required(df: DataFrame) -> DataFrame:
    return df.withColumn("ctr_required", F.coalesce(F.col("transaction_type").isin("deposit", "withdraw")
                                                    & (F.col("amount") >= CTR_THRESHOLD), F.lit(False)))


def sar_required(df: DataFrame, level: str = "risk_level") -> DataFrame:
    flagged = F.exists("rules", lambda h: h["rule_id"] == "R07") | F.col(level).isin(SAR_LEVELS)
    return df.withColumn("sar_required", F.coalesce(flagged, F.lit(False)))


def is_mandatory(df: DataFrame) -> DataFrame:
    """A sanctions hit or a critical rule; such a risk may not be lowered by a model."""
    critical = F.exists("rules", lambda h: h["severity"] == "critical")
    if "screening_sanctioned" in df.columns:
        critical = critical | F.coalesce("screening_sanctioned", F.lit(False))
    elif "screening_hits" in df.columns:
        critical = critical | F.coalesce(F.exists("screening_hits", lambda h: h["list_type"] == "sanctions"),
                                         F.lit(False))
    return df.withColumn("mandatory", F.coalesce(critical, F.lit(False)))
