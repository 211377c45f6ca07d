"""Eleven laundering-pattern detectors and the pattern score.

Scope of "history" per pattern: the sender's own payments (structuring, layering, rapid movement, burst, shell
company), the receiver's ledger (funnel), the pair (circular, round trip), the sender's ledger (mule, dormant).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moneytrail.constants import (DAY_US, PATTERN_DESCRIPTION, PATTERN_EXPLANATION, PATTERN_STRUCTURING_BAND,
                                  RAPID_MOVEMENT, SHELL_MEAN)
from moneytrail.operators.history import party_history, sender_history
from moneytrail.operators.ledger import reverse_transfers, similar_reverse
from moneytrail.operators.windows import RECEIVER, SENDER
from moneytrail.plans.hot import NO_HOT_KEYS, HotKeys

SENDER_GROUPS = ("lifetime", "moments", "velocity", "band", "transfers", "large")


def pattern_history(df: DataFrame, hot: HotKeys = NO_HOT_KEYS, hot_accounts: HotKeys = NO_HOT_KEYS,
                    more: tuple = ()) -> DataFrame:
    """Everything the detectors read, as columns, with ``more`` groups of sender history."""
    rows = sender_history(df, SENDER_GROUPS + more, hot)
    rows = reverse_transfers(rows, hot_accounts)
    rows = rows.join(similar_reverse(df), "id", "left")
    return rows.join(party_history(df, hot_accounts), "id", "left")


def with_owners(df: DataFrame, accounts: DataFrame, as_of_us: int) -> DataFrame:
    """Owner of both accounts and the sender's account age in whole days at ``as_of_us``."""
    age = F.floor((F.lit(as_of_us) - F.unix_micros("created_at")) / DAY_US)
    owner = accounts.select(F.col("account_number").alias(SENDER), F.col("customer_id").alias("sender_customer_id"),
                            age.alias("account_age_days"))
    other = accounts.select(F.col("account_number").alias(RECEIVER),
                            F.col("customer_id").alias("receiver_customer_id"))
    return df.join(owner, SENDER, "left").join(other, RECEIVER, "left")


def coefficient_of_variation() -> tuple[Column, Column]:
    """Mean in dollars and population deviation over mean, current row included."""
    n = (F.col("prior_count") + 1).cast("double")
    total = (F.col("prior_cents") + F.col("cents")).cast("double")
    big = F.col("cents").cast("decimal(38,0)")
    squares = (F.col("prior_squares") + big * big).cast("double")
    mean = total / n
    spread = F.sqrt(F.greatest(squares / n - mean * mean, F.lit(0.0)))
    return mean / 100, spread / F.when(mean > 0, mean)


def pattern_flags() -> dict[str, Column]:
    """One boolean per detector, in evaluation order."""
    amount, kind = F.col("amount"), F.col("transaction_type")
    own = F.col(SENDER).eqNullSafe(F.col(RECEIVER))
    in_senders = F.col("r_in_partners") + F.when(F.col("r_self_count") > 0, 1).otherwise(0)
    out_receivers = F.col("r_out_partners") + F.when(F.col("r_self_count") > 0, 1).otherwise(0)
    ins = F.col("s_in_count") + F.col("s_self_count")
    outs = F.col("s_out_count") + F.col("s_self_count")
    in_cents = F.col("s_in_cents") + F.col("s_self_cents")
    out_cents = F.col("s_out_cents") + F.col("s_self_cents")
    idle = F.floor((F.col("ts_us") - F.col("s_last_us")) / DAY_US)
    mean, variation = coefficient_of_variation()
    known_owner = F.coalesce(F.col("sender_customer_id").cast("string"), F.lit("")) != ""
    return {
        "structuring": amount.between(*PATTERN_STRUCTURING_BAND) & (F.col("band_count") >= 2),
        "layering": (F.lower(kind) == "transfer") & (F.col("transfer_count_1h") >= 3)
        & (F.col("transfer_recipients_1h") >= 2),
        "funnel_account": (in_senders >= 5) & (out_receivers <= 2),
        "self_transfer": own,
        "circular_transfer": ~own & (F.col("reverse_count") > 0),
        "money_mule": (ins >= 3) & (outs >= 3) & (out_cents * 10 >= in_cents * 8),
        "rapid_movement": (amount >= RAPID_MOVEMENT) & (F.col("large_count_24h") >= 2),
        "round_tripping": F.coalesce(F.col("round_trip"), F.lit(False)),
        "self_laundering": known_owner & (F.col("sender_customer_id") == F.col("receiver_customer_id"))
        & F.col("s_last_us").isNotNull(),
        "dormant_activation": F.when(F.col("s_last_us").isNotNull(), idle > 90)
        .otherwise(F.coalesce(F.col("account_age_days") > 90, F.lit(False))),
        "transaction_burst": (F.col("count_1h") >= 10) | (F.col("count_24h") >= 10),
        "shell_company_behavior": (F.col("prior_count") >= 4) & (mean > SHELL_MEAN) & (variation < 0.2),
    }


def _pattern(flag: Column, kind: str, level: str | Column, description: str | Column, **metrics) -> Column:
    pairs = [x for k, v in metrics.items() for x in (F.lit(k), v.cast("double"))]
    text = F.lit(description) if isinstance(description, str) else description
    return F.when(F.coalesce(flag, F.lit(False)), F.struct(
        F.lit(kind).alias("type"), text.alias("description"),
        (F.lit(level) if isinstance(level, str) else level).alias("risk_level"),
        (F.create_map(*pairs) if pairs else F.lit(None)).cast("map<string,double>").alias("metrics")))


def pattern_structs() -> list[Column]:
    f, c, text = pattern_flags(), F.col, PATTERN_DESCRIPTION
    mean, variation = coefficient_of_variation()
    senders = c("r_in_partners") + F.when(c("r_self_count") > 0, 1).otherwise(0)
    receivers = c("r_out_partners") + F.when(c("r_self_count") > 0, 1).otherwise(0)
    in_cents, out_cents = c("s_in_cents") + c("s_self_cents"), c("s_out_cents") + c("s_self_cents")
    hourly = c("count_1h") >= 10
    first = c("s_last_us").isNull()
    return [
        _pattern(f["structuring"], "structuring", "high", text["structuring"], count=c("band_count") + 1,
                 total_amount=(c("band_cents") + c("cents")) / 100),
        _pattern(f["layering"], "layering", "high", text["layering"], transfer_count=c("transfer_count_1h") + 1,
                 unique_recipients=c("transfer_recipients_1h"), time_window_hours=F.lit(1)),
        _pattern(f["funnel_account"], "funnel_account", "high", text["funnel_account"], unique_senders=senders,
                 unique_receivers=receivers, ratio=senders / F.greatest(receivers, F.lit(1))),
        _pattern(f["self_transfer"], "self_transfer", "medium", text["self_transfer"]),
        _pattern(f["circular_transfer"], "circular_transfer", "high", text["circular_transfer"],
                 earlier=c("reverse_count")),
        _pattern(f["money_mule"], "money_mule", "high", text["money_mule"], total_in=in_cents / 100,
                 total_out=out_cents / 100,
                 pass_through_ratio=F.when(in_cents > 0, out_cents / in_cents).otherwise(0)),
        _pattern(f["rapid_movement"], "rapid_movement", "high", text["rapid_movement"],
                 total_amount=(c("large_cents_24h") + c("cents")) / 100, transaction_count=c("large_count_24h") + 1,
                 time_window_hours=F.lit(24)),
        _pattern(f["round_tripping"], "round_tripping", "high", text["round_tripping"], outbound_amount=c("amount")),
        _pattern(f["self_laundering"], "self_laundering", "medium", text["self_laundering"]),
        _pattern(f["dormant_activation"], "dormant_activation", "medium",
                 F.when(first, text["first_activation"]).otherwise(text["dormant_activation"]),
                 days=F.when(first, c("account_age_days")).otherwise(
                     F.floor((c("ts_us") - c("s_last_us")) / DAY_US))),
        _pattern(f["transaction_burst"], "transaction_burst", F.when(hourly, "high").otherwise("medium"),
                 F.when(hourly, text["burst_1h"]).otherwise(text["burst_24h"]),
                 count=F.when(hourly, c("count_1h")).otherwise(c("count_24h")) + 1),
        _pattern(f["shell_company_behavior"], "shell_company_behavior", "medium", text["shell_company_behavior"],
                 average_amount=mean, variation_coefficient=variation),
    ]


def pattern_score(patterns: Column) -> Column:
    """25, 15 and 5 points per high, medium and other pattern; extra for two and for three high ones; at most 100."""
    points = F.aggregate(F.transform(patterns, lambda p: F.when(p["risk_level"] == "high", 25)
                                     .when(p["risk_level"] == "medium", 15).otherwise(5)),
                         F.lit(0), lambda a, x: a + x)
    high = F.size(F.filter(patterns, lambda p: p["risk_level"] == "high"))
    return F.least(F.lit(100), points + F.when(high >= 3, 20).when(high >= 2, 10).otherwise(0)).cast("long")


def summarize_patterns(df: DataFrame) -> DataFrame:
    high = F.filter("patterns", lambda p: p["risk_level"] == "high")
    return df.withColumns({"pattern_count": F.size("patterns").cast("long"),
                           "high_risk_patterns": F.transform(high, lambda p: p["type"]),
                           "pattern_score": pattern_score(F.col("patterns"))})


def detect_patterns(df: DataFrame, accounts: DataFrame, as_of_us: int, hot: HotKeys = NO_HOT_KEYS,
                    hot_accounts: HotKeys = NO_HOT_KEYS, also: dict[str, list[str]] | None = None) -> DataFrame:
    """Add ``patterns``, ``pattern_count``, ``high_risk_patterns`` and ``pattern_score``.

    ``accounts`` needs ``account_number``, ``customer_id`` and ``created_at``.  ``also`` names further groups of
    sender history and the columns of theirs to keep, so that they share the detectors' scan.
    """
    also = also or {}
    rows = with_owners(pattern_history(df, hot, hot_accounts, tuple(also)), accounts, as_of_us)
    rows = rows.withColumn("patterns", F.array_compact(F.array(*pattern_structs())))
    return summarize_patterns(rows).select(*df.columns, *[c for cs in also.values() for c in cs], "patterns", "pattern_count", "high_risk_patterns",
                                           "pattern_score")


def explain_pattern(kind: Column) -> Column:
    known = F.element_at(F.create_map(*[F.lit(x) for kv in PATTERN_EXPLANATION.items() for x in kv]), kind)
    return F.coalesce(known, F.concat(F.lit("Suspicious pattern detected: "), kind))




