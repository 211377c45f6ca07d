"""The 82-column feature vector and the 25-column model vector, as named columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moneytrail.constants import (COUNTRY_LISTS, DAY_US, FEATURE_CHANNELS, MODEL_CHANNEL_CODE,
                                  PATTERN_STRUCTURING_BAND, RAPID_MOVEMENT, RULE_STRUCTURING_BAND, SAR_TRANSFER,
                                  TX_TYPES)
from moneytrail.functions.scalars import channel_ordinal, country_risk, is_night, one_hot, safe_ratio
from moneytrail.operators.history import party_history, sender_history
from moneytrail.operators.ledger import reverse_transfers
from moneytrail.operators.medians import running_median
from moneytrail.operators.windows import RECEIVER, SENDER
from moneytrail.plans.hot import NO_HOT_KEYS, HotKeys

TRANSACTION = ["amount", "amount_log", "amount_sqrt"] + [f"transaction_type_{t}" for t in TX_TYPES]
BEHAVIOUR = ["amount_to_sender_avg", "amount_to_sender_max", "amount_to_sender_median", "sender_tx_count",
             "sender_avg_amount", "sender_max_amount", "sender_median_amount", "sender_amount_std",
             "sender_amount_skew", "amount_deviation_from_avg", "amount_deviation_from_max"]
TIME = ["hour", "day_of_week", "day_of_month", "month", "is_weekend", "is_night", "is_early_morning",
        "is_business_hours", "is_holiday", "is_salary_day"]
VELOCITY = ["sender_tx_count_1h", "sender_tx_count_24h", "sender_tx_count_7d", "sender_volume_1h",
            "sender_volume_24h", "sender_volume_7d", "amount_to_sender_volume_24h", "amount_to_sender_volume_7d",
            "velocity_ratio_1h", "velocity_ratio_24h"]
RELATIONSHIP = ["is_new_recipient", "recipient_reuse_count", "unique_recipients_24h", "unique_recipients_7d",
                "is_self_transfer", "is_circular_transfer", "shared_recipient_count", "recipient_risk_score"]
GEOGRAPHY = ["is_cross_border", "origin_country_risk", "destination_country_risk", "country_risk_difference",
             "high_risk_country_involved"]
CHANNEL = [f"channel_{c}" for c in FEATURE_CHANNELS]
ACCOUNT = ["account_age_days", "is_dormant_account", "dormancy_period_days", "previous_alert_count",
           "previous_sar_count", "is_pep", "is_sanctioned", "is_high_risk_customer", "kyc_status_verified",
           "kyc_status_pending", "kyc_status_rejected"]
NETWORK = ["is_layering_pattern", "is_structuring_pattern", "is_smurfing_pattern", "is_funnel_account",
           "is_rapid_movement", "is_hub_account", "network_centrality", "cluster_density"]
COMPOSITE = ["risk_score_composite", "anomaly_score_composite", "behavioral_drift_score", "velocity_spike_score"]
FEATURES_82 = (TRANSACTION + BEHAVIOUR + TIME + VELOCITY + RELATIONSHIP + GEOGRAPHY + CHANNEL + ACCOUNT + NETWORK
               + COMPOSITE)


def _flag(col: Column) -> Column:
    return F.coalesce(col, F.lit(False)).cast("double")


def _dollars(cents: Column) -> Column:
    return cents / 100.0


def transaction_features() -> dict[str, Column]:
    amount = F.col("amount").cast("double")
    return {"amount": amount, "amount_log": F.log1p(amount), "amount_sqrt": F.sqrt(amount),
            **one_hot(F.lower("transaction_type"), TX_TYPES, "transaction_type_")}


def behaviour_features() -> dict[str, Column]:
    """Statistics over earlier amounts with the current one; neutral values on the first transaction."""
    amount = F.col("amount").cast("double")
    first = F.col("prior_count") == 0
    n = (F.col("prior_count") + 1).cast("double")
    big = F.col("cents").cast("decimal(38,0)")
    mean = (F.col("prior_cents") + F.col("cents")) / n
    squares = (F.col("prior_squares") + big * big).cast("double") / n
    cubes = (F.col("prior_cubes") + big * big * big).cast("double") / n
    variance = F.greatest(squares - mean * mean, F.lit(0.0))
    third = cubes - 3 * mean * squares + 2 * mean * mean * mean
    # an account that repeats one amount has no spread; what is left of it is rounding
    flat = variance <= squares * 1e-12
    avg, largest = _dollars(mean), _dollars(F.greatest("prior_max_cents", "cents"))
    median = F.col("median_cents2") / 200.0
    return {
        "sender_tx_count": F.when(first, 0.0).otherwise(n),
        "sender_avg_amount": avg, "sender_max_amount": largest, "sender_median_amount": median,
        "sender_amount_std": F.when(first | flat, 0.0).otherwise(F.sqrt(variance) / 100),
        "sender_amount_skew": F.when((n < 3) | flat, 0.0).otherwise(third / (variance * F.sqrt(variance))),
        "amount_to_sender_avg": F.when(first, 1.0).otherwise(safe_ratio(amount, avg, 1.0)),
        "amount_to_sender_max": F.when(first, 1.0).otherwise(safe_ratio(amount, largest, 1.0)),
        "amount_to_sender_median": F.when(first, 1.0).otherwise(safe_ratio(amount, median, 1.0)),
        "amount_deviation_from_avg": safe_ratio(F.abs(amount - avg), avg, 0.0),
        "amount_deviation_from_max": safe_ratio(F.abs(amount - largest), largest, 0.0),
    }


def time_features() -> dict[str, Column]:
    hour, weekday, day = F.hour("ts"), F.weekday("ts"), F.dayofmonth("ts")
    return {"hour": F.coalesce(hour, F.lit(12)).cast("double"),
            "day_of_week": F.coalesce(weekday, F.lit(0)).cast("double"),
            "day_of_month": F.coalesce(day, F.lit(1)).cast("double"),
            "month": F.coalesce(F.month("ts"), F.lit(1)).cast("double"),
            "is_weekend": _flag(weekday >= 5), "is_night": _flag(is_night(hour)),
            "is_early_morning": _flag((hour >= 5) & (hour < 8)),
            "is_business_hours": F.coalesce((hour >= 9) & (hour < 17), F.lit(True)).cast("double"),
            "is_holiday": F.lit(0.0), "is_salary_day": _flag(day.isin(1, 15))}


def velocity_features() -> dict[str, Column]:
    amount = F.col("amount").cast("double")
    out = {}
    for w in ("1h", "24h", "7d"):
        out[f"sender_tx_count_{w}"] = F.col(f"count_{w}").cast("double")
        out[f"sender_volume_{w}"] = _dollars(F.col(f"cents_{w}"))
    for w in ("24h", "7d"):
        out[f"amount_to_sender_volume_{w}"] = safe_ratio(amount, out[f"sender_volume_{w}"], 1.0)
    for w in ("1h", "24h"):
        average = out[f"sender_volume_{w}"] / F.when(F.col(f"count_{w}") > 0, F.col(f"count_{w}"))
        out[f"velocity_ratio_{w}"] = safe_ratio(amount, average, 1.0)
    return out


def relationship_features(recipient_risk: Column | None = None) -> dict[str, Column]:
    """``shared_recipient_count`` is the receiver's true fan-in so far when it is known, else 0."""
    return {"is_new_recipient": _flag(F.col("is_new_recipient")),
            "recipient_reuse_count": F.col("recipient_reuse_count").cast("double"),
            "unique_recipients_24h": F.col("unique_recipients_24h").cast("double"),
            "unique_recipients_7d": F.col("unique_recipients_7d").cast("double"),
            "is_self_transfer": _flag(F.col(SENDER) == F.col(RECEIVER)),
            "is_circular_transfer": _flag((F.col("reverse_count") > 0)
                                          | ((F.col(SENDER) == F.col(RECEIVER)) & ~F.col("is_new_recipient"))),
            "shared_recipient_count": F.lit(0.0),
            "recipient_risk_score": F.coalesce(recipient_risk, F.lit(0.0)) if recipient_risk is not None
            else F.lit(0.0)}


def geography_features(origin: Column, destination: Column) -> dict[str, Column]:
    o, d = F.upper(F.coalesce(origin, F.lit(""))), F.upper(F.coalesce(destination, F.lit("")))
    high = COUNTRY_LISTS["features_high"]
    return {"is_cross_border": _flag((o != "") & (d != "") & (o != d)), "origin_country_risk": country_risk(o),
            "destination_country_risk": country_risk(d),
            "country_risk_difference": F.abs(country_risk(o) - country_risk(d)),
            "high_risk_country_involved": _flag(o.isin(high) | d.isin(high))}


def channel_features() -> dict[str, Column]:
    return one_hot(F.lower(F.coalesce("channel", F.lit("online"))), FEATURE_CHANNELS, "channel_")


def account_features(as_of_us: int) -> dict[str, Column]:
    """Needs the joined account columns and ``last_tx_us`` of the sender."""
    age = F.floor((F.lit(as_of_us) - F.unix_micros("account_created_at")) / DAY_US)
    idle = F.floor((F.lit(as_of_us) - F.col("last_tx_us")) / DAY_US)
    kyc = F.lower(F.coalesce("kyc_status", F.lit("pending")))
    return {"account_age_days": F.coalesce(F.greatest(age, F.lit(0)).cast("double"), F.lit(365.0)),
            "is_dormant_account": _flag(idle > 90),
            "dormancy_period_days": F.coalesce(F.greatest(idle, F.lit(0)).cast("double"), F.lit(0.0)),
            "previous_alert_count": F.coalesce(F.col("previous_alert_count").cast("double"), F.lit(0.0)),
            "previous_sar_count": F.coalesce(F.col("previous_sar_count").cast("double"), F.lit(0.0)),
            "is_pep": _flag(F.col("pep_flag")), "is_sanctioned": _flag(F.col("sanctioned_flag")),
            "is_high_risk_customer": _flag(F.col("risk_rating") == "high"),
            **one_hot(kyc, ["verified", "pending", "rejected"], "kyc_status_")}


def network_features() -> dict[str, Column]:
    """Over the sender's ledger in both directions, except the payment counts."""
    any_in = (F.col("s_in_count") + F.col("s_self_count")) > 0
    any_out = (F.col("s_out_count") + F.col("s_self_count")) > 0
    receivers = F.col("s_out_partners") + F.when(any_in, 1).otherwise(0)
    senders = F.col("s_in_partners") + F.when(any_out, 1).otherwise(0)
    links = F.col("s_partners") + F.when(any_in | any_out, 1).otherwise(0)
    near = _flag(F.col("band_count") >= 2)
    return {"is_layering_pattern": _flag(F.col("transfer_count") >= 3), "is_structuring_pattern": near,
            "is_smurfing_pattern": near, "is_funnel_account": _flag((any_in | any_out) & (receivers * 2 < senders)),
            "is_rapid_movement": _flag((F.col("amount") > RAPID_MOVEMENT) & (F.col("count_24h") >= 5)),
            "is_hub_account": _flag(links > 10), "network_centrality": links.cast("double"),
            "cluster_density": F.least(F.lit(1.0), links / 20.0)}


def composite_features() -> dict[str, Column]:
    c = F.col
    risk = (c("is_high_risk_customer") + c("is_pep") + c("is_sanctioned") + c("high_risk_country_involved")
            + c("is_structuring_pattern") + c("is_layering_pattern"))
    drift, pace, new = c("amount_deviation_from_avg"), c("velocity_ratio_24h"), c("is_new_recipient")
    return {"risk_score_composite": risk / 6, "anomaly_score_composite": (drift + pace + new + c("is_night")) / 4,
            "behavioral_drift_score": drift * 0.4 + pace * 0.3 + new * 0.3,
            "velocity_spike_score": F.greatest("velocity_ratio_1h", "velocity_ratio_24h")}


def clean_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN, infinities and NULL become 0."""
    keep = [f"`{c}`" for c in df.columns if c not in columns]
    return df.selectExpr(*keep, *[f"if(`{c}` IS NULL OR isnan(`{c}`) OR abs(`{c}`) = double('Infinity'), 0D, `{c}`) "
                                  f"AS `{c}`" for c in columns])


def features_82(df: DataFrame, accounts: DataFrame, as_of_us: int, hot: HotKeys = NO_HOT_KEYS,
                hot_accounts: HotKeys = NO_HOT_KEYS, columns: list[str] | None = None) -> DataFrame:
    """``id`` and the 82 features of every transaction, or the named ones; only the history they read is computed.

    ``accounts`` may carry ``sanctioned_flag``; ``df`` may carry ``origin_country``, ``recipient_risk_score``,
    ``previous_alert_count`` and ``previous_sar_count``.
    """
    columns = FEATURES_82 if columns is None else columns
    composite = any(c in COMPOSITE for c in columns)

    def wanted(group: list[str]) -> bool:
        return composite or any(c in group for c in columns)

    have = set(df.columns)
    extra = {"origin_country": F.lit("ZW"), "previous_alert_count": F.lit(0), "previous_sar_count": F.lit(0),
             "recipient_risk_score": F.lit(0.0)}
    rows = df.select("*", *[v.alias(k) for k, v in extra.items() if k not in have])
    made = {**transaction_features(), **time_features(), **channel_features(),
            **geography_features(F.col("origin_country"), F.col("destination_country"))}
    scans: list[str] = []
    if wanted(BEHAVIOUR):
        scans += ["lifetime", "moments"]
        made |= behaviour_features()
    if wanted(VELOCITY) or wanted(NETWORK):
        scans.append("velocity")
        made |= velocity_features()
    if wanted(RELATIONSHIP):
        scans.append("recipients")
        made |= relationship_features(F.col("recipient_risk_score").cast("double"))
    if wanted(NETWORK):
        scans += ["band", "transfer_count"]
        made |= network_features()
    if scans:
        rows = sender_history(rows, tuple(scans), hot)
    if wanted(RELATIONSHIP):
        rows = reverse_transfers(rows, hot_accounts)
    if wanted(BEHAVIOUR):
        rows = rows.join(running_median(df, hot), "id")
    if wanted(NETWORK) or wanted(ACCOUNT):
        rows = rows.join(party_history(df, hot_accounts), "id").withColumn("last_tx_us", F.col("s_last_us"))
    if wanted(ACCOUNT):
        made |= account_features(as_of_us)
        flags = accounts.select(
            F.col("account_number").alias(SENDER), F.col("created_at").alias("account_created_at"), "kyc_status",
            "pep_flag", "risk_rating",
            (F.col("sanctioned_flag") if "sanctioned_flag" in accounts.columns else F.lit(False))
            .alias("sanctioned_flag"))
        rows = rows.join(flags, SENDER, "left")
    out = rows.select("id", *[made[n].alias(n) for n in FEATURES_82 if n in made and (composite or n in columns)])
    if composite:
        out = out.select("*", *[c.alias(n) for n, c in composite_features().items()])
    return clean_numbers(out.select("id", *columns), columns)


# --- the 25-column model vector -----------------------------------------------------------------------------

FEATURES_25 = ["amount", "hour", "is_deposit", "is_withdraw", "is_transfer", "is_self", "is_night",
               "sender_avg_amount", "sender_max_amount", "sender_tx_count", "amount_to_sender_avg",
               "amount_to_sender_max", "sender_tx_count_24h", "sender_volume_24h", "amount_to_sender_volume_24h",
               "is_new_recipient", "channel_code", "is_ctr_amount", "is_structuring_amount", "same_day_count",
               "same_day_total", "same_recipient_count", "rapid_transfer_count", "structuring_indicators",
               "layering_indicators"]


def sequence_profile(df: DataFrame, hot: HotKeys = NO_HOT_KEYS) -> DataFrame:
    """The sender's history before each transaction, as the model reads it."""
    rows = sender_history(df, ("lifetime", "new_recipient", "sequence"), hot)
    amount = F.col("amount").cast("double")
    avg = F.when(F.col("prior_count") > 0, F.col("prior_cents") / F.col("prior_count") / 100).otherwise(0.0)
    largest = F.coalesce(_dollars(F.col("prior_max_cents")), F.lit(0.0))
    volume = _dollars(F.col("cents_24h"))
    return rows.select(
        *df.columns, avg.alias("sender_avg_amount"), largest.alias("sender_max_amount"),
        F.col("prior_count").cast("double").alias("sender_tx_count"),
        safe_ratio(amount, avg, 1.0).alias("amount_to_sender_avg"),
        safe_ratio(amount, largest, 1.0).alias("amount_to_sender_max"),
        F.col("count_24h").cast("double").alias("sender_tx_count_24h"), volume.alias("sender_volume_24h"),
        safe_ratio(amount, volume, 1.0).alias("amount_to_sender_volume_24h"),
        _flag(F.col("is_new_recipient")).alias("is_new_recipient"),
        F.col("same_day_count").cast("double").alias("same_day_count"),
        _dollars(F.col("same_day_cents")).alias("same_day_total"),
        F.col("same_recipient_count").cast("double").alias("same_recipient_count"),
        F.col("rapid_transfer_count").cast("double").alias("rapid_transfer_count"))


def model_columns(rows: DataFrame) -> DataFrame:
    """``id`` and the 25 model columns of rows that carry the sequence profile (given or computed)."""
    amount, kind, hour = F.col("amount").cast("double"), F.col("transaction_type"), F.coalesce(F.hour("ts"), F.lit(12))
    transfer = kind == "transfer"

    def bit(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)).cast("int")

    made = {
        "amount": amount, "hour": hour.cast("double"), "is_deposit": _flag(kind == "deposit"),
        "is_withdraw": _flag(kind == "withdraw"), "is_transfer": _flag(transfer),
        "is_self": _flag(F.col(SENDER) == F.col(RECEIVER)), "is_night": _flag(is_night(hour)),
        "channel_code": channel_ordinal(F.coalesce("channel", F.lit("online")), MODEL_CHANNEL_CODE).cast("double"),
        "is_ctr_amount": _flag(amount >= 10_000), "is_structuring_amount": _flag(
            amount.between(*RULE_STRUCTURING_BAND)),
        "structuring_indicators": (bit(amount.between(*PATTERN_STRUCTURING_BAND))
                                   + bit(F.col("same_day_count") >= 3)).cast("double"),
        "layering_indicators": (bit(F.col("rapid_transfer_count") >= 2) + bit(F.col("same_recipient_count") >= 2)
                                + bit(transfer & (amount >= SAR_TRANSFER))).cast("double"),
    }
    return rows.select("id", *[made.get(n, F.col(n).cast("double")).alias(n) for n in FEATURES_25])


def features_25(df: DataFrame, hot: HotKeys = NO_HOT_KEYS) -> DataFrame:
    return model_columns(sequence_profile(df, hot))
