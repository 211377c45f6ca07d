"""History columns several operators share, computed in as few scans as they need.

``sender_history`` is one shuffle on the sender for any choice of groups.  ``party_history`` looks at both ends of
a transaction through the account ledger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moneytrail.constants import DAY_US, HOUR_US, MINUTE_US, PATTERN_STRUCTURING_BAND, RAPID_MOVEMENT
from moneytrail.operators.ledger import account_ledger
from moneytrail.operators.windows import RECEIVER, SENDER, WEEK_US, distinct_measure, on_sender
from moneytrail.plans.hot import NO_HOT_KEYS, HotKeys
from moneytrail.plans.scan import Measure, count_measure, neighbours, prior

ALL_GROUPS = ("lifetime", "moments", "velocity", "recipients", "band", "transfers", "large", "sequence")


def sender_history(df: DataFrame, groups: tuple = ALL_GROUPS, hot: HotKeys = NO_HOT_KEYS) -> DataFrame:
    """The columns of the named groups. ``new_recipient`` and ``transfer_count`` are those columns of ``recipients`` and
    ``transfers`` alone: every window that is not asked for saves its rows of the scan."""
    cents, kind = F.col("cents"), F.col("transaction_type")
    one = F.lit(1).cast("long")
    big = cents.cast("decimal(38,0)")
    transfer = F.coalesce(kind == "transfer", F.lit(False))
    in_band = F.col("amount").between(*PATTERN_STRUCTURING_BAND)
    large = F.col("amount") >= RAPID_MOVEMENT // 2
    rows = on_sender(df, hot)
    measures: list[Measure] = []
    if "lifetime" in groups or "moments" in groups:
        measures += [count_measure("prior_count"), Measure("prior_cents", cents),
                     Measure("prior_max_cents", cents, "max")]
    if "moments" in groups:
        measures += [Measure("prior_squares", big * big), Measure("prior_cubes", (big * big * big))]
    if "velocity" in groups:
        for name, width in (("1h", HOUR_US), ("24h", DAY_US), ("7d", WEEK_US)):
            measures += [count_measure(f"count_{name}", None, width), Measure(f"cents_{name}", cents, "sum", width)]
    if "recipients" in groups or "new_recipient" in groups:
        rows = neighbours(rows, [SENDER, RECEIVER], hot=hot)
        rows = rows.withColumns({"is_new_recipient": F.col("_prev").isNull(), "_next_all": F.col("_next")})
        rows = rows.drop("_prev", "_next")
    if "recipients" in groups:
        rows = prior(rows, [SENDER, RECEIVER], [count_measure("recipient_reuse_count")], hot=hot)
        measures += [Measure(f"unique_recipients_{n}", one, "sum",
                             expires=F.least(F.col("_next_all"), F.col("ts_us") + w))
                     for n, w in (("24h", DAY_US), ("7d", WEEK_US))]
    if "band" in groups:
        measures += [count_measure("band_count", in_band), Measure("band_cents", F.when(in_band, cents))]
    if "transfers" in groups or "transfer_count" in groups:
        measures.append(count_measure("transfer_count", transfer))
    if "transfers" in groups:
        rows = neighbours(rows.withColumn("_on", transfer), [SENDER, RECEIVER, "_on"], hot=hot).drop("_prev")
        measures += [count_measure("transfer_count_1h", transfer, HOUR_US),
                     distinct_measure("transfer_recipients_1h", F.col("_on"), HOUR_US)]
    if "large" in groups:
        measures += [count_measure("large_count_24h", large, DAY_US),
                     Measure("large_cents_24h", F.when(large, cents), "sum", DAY_US)]
    if "sequence" in groups:
        rows = prior(rows, [SENDER, RECEIVER], [count_measure("same_recipient_count", None, DAY_US)], hot=hot,
                     partitioned=True)
        end_of_day = (F.floor(F.col("ts_us") / DAY_US) + 1) * DAY_US - 1
        measures += [Measure("same_day_count", one, "sum", expires=end_of_day),
                     Measure("same_day_cents", cents, "sum", expires=end_of_day),
                     count_measure("rapid_transfer_count", None, 10 * MINUTE_US)]
        if "velocity" not in groups:
            measures += [count_measure("count_24h", None, DAY_US), Measure("cents_24h", cents, "sum", DAY_US)]
    rows = prior(rows, SENDER, measures, hot=hot, partitioned=True)
    return rows.drop("_next", "_next_all", "_on")


PARTY_METRICS = ["in_count", "in_cents", "out_count", "out_cents", "self_count", "self_cents", "in_partners",
                 "out_partners", "partners", "last_us"]


def ledger_history(ledger: DataFrame, hot: HotKeys = NO_HOT_KEYS) -> DataFrame:
    """What an account did in both directions before each of its ledger entries.

    Partners exclude the account itself; transactions with itself are counted apart.  ``hot`` is about accounts.
    """
    rows = ledger if hot else hot.dealt(ledger, "account")
    side = F.col("direction")
    rows = neighbours(rows, ["account", "direction", "counterparty"], hot=hot).drop("_prev")
    rows = rows.withColumnRenamed("_next", "_next_side")
    rows = rows.withColumn("_self", side == "self")
    rows = neighbours(rows, ["account", "_self", "counterparty"], hot=hot).drop("_prev")
    one = F.lit(1).cast("long")
    measures = []
    for name in ("in", "out", "self"):
        measures += [count_measure(f"{name}_count", side == name),
                     Measure(f"{name}_cents", F.when(side == name, F.col("cents")))]
    for name in ("in", "out"):
        measures.append(Measure(f"{name}_partners", F.when(side == name, one), "sum",
                                expires=F.when(side == name, F.col("_next_side"))))
    measures.append(Measure("partners", F.when(side != "self", one), "sum",
                            expires=F.when(side != "self", F.col("_next"))))
    measures.append(Measure("last_us", F.col("ts_us"), "max"))
    return prior(rows, "account", measures, hot=hot, partitioned=True).drop("_next", "_next_side", "_self")


def party_history(df: DataFrame, hot: HotKeys = NO_HOT_KEYS) -> DataFrame:
    """``id`` with the ledger history of the sender (``s_*``) and of the receiver (``r_*``) at that moment."""
    ledger = account_ledger(df.select("id", "ts_us", "cents", "transaction_type", SENDER, RECEIVER))
    seen = ledger_history(ledger.select("id", "ts_us", "cents", "account", "direction", "counterparty"), hot)
    side = F.col("direction")
    return seen.groupBy("id").agg(
        *[F.max(F.when(side != "in", F.col(m))).alias(f"s_{m}") for m in PARTY_METRICS],
        *[F.max(F.when(side != "out", F.col(m))).alias(f"r_{m}") for m in PARTY_METRICS])


def prior_case_counts(df: DataFrame, alerts: DataFrame, sars: DataFrame, hot: HotKeys = NO_HOT_KEYS) -> DataFrame:
    """Alerts and SARs of the sender before each transaction."""
    one, none = F.lit(1).cast("long"), F.lit(None).cast("long")
    q = df.select("id", F.col(SENDER).alias("account"), "ts_us", none.alias("a"), none.alias("s"))
    a = alerts.select(none.alias("id"), F.col("account_number").alias("account"),
                      F.unix_micros("ts").alias("ts_us"), one.alias("a"), none.alias("s"))
    s = sars.select(none.alias("id"), F.col("account_number").alias("account"),
                    F.unix_micros("created_at").alias("ts_us"), none.alias("a"), one.alias("s"))
    seen = prior(q.unionByName(a).unionByName(s), "account",
                 [Measure("previous_alert_count", F.col("a")), Measure("previous_sar_count", F.col("s"))], hot=hot)
    return seen.where("id IS NOT NULL").select("id", "previous_alert_count", "previous_sar_count")
