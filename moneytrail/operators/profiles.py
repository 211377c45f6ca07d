"""Behavioural profiles of accounts, built from their newest 500 transactions in either direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moneytrail.constants import COUNTRY_LISTS, DAY_US, PROFILE_HISTORY, PROFILE_MIN_TX, PROFILE_RECENT
from moneytrail.functions.scalars import index_percentile
from moneytrail.operators.ledger import account_ledger
from moneytrail.operators.windows import latest_per_account, with_sequence
from moneytrail.plans.hot import NO_HOT_KEYS, HotKeys

DIMENSIONS = {
    # name: (expression over a ledger row, how many ranked values a profile keeps)
    "channel": ("coalesce(channel, 'online')", 3),
    "type": ("coalesce(transaction_type, 'unknown')", 3),
    "recipient": ("CASE WHEN transaction_type = 'transfer' THEN receiver_account END", 10),
    "country": ("coalesce(destination_country, 'ZW')", 10),
    "hour": ("cast(hour(ts) AS STRING)", 3),
    "weekday": ("cast(weekday(ts) AS STRING)", 3),
}


def profile_rows(tx: DataFrame, as_of_us: int, hot: HotKeys = NO_HOT_KEYS) -> DataFrame:
    """Ledger rows before ``as_of_us``, newest 500 per account, with ``seq``, ``n``, ``recency`` and ``gap_us``;
    accounts with fewer than five are left out."""
    ledger = account_ledger(tx.where(F.col("ts_us") < as_of_us))
    return with_sequence(latest_per_account(ledger, PROFILE_HISTORY, hot)).where(F.col("n") >= PROFILE_MIN_TX)


def distributions(rows: DataFrame) -> DataFrame:
    """One row per account, dimension and value: ``cnt``, ``freq``, ``rank`` (most frequent, then first seen)."""
    pairs = ", ".join(f"'{d}', {e}" for d, (e, _) in DIMENSIONS.items())
    long = rows.selectExpr("account", "n", "seq", "recency",
                           f"stack({len(DIMENSIONS)}, {pairs}) AS (dim, value)").where("value IS NOT NULL")
    counted = long.groupBy("account", "dim", "value").agg(
        F.max("n").alias("n"), F.count(F.lit(1)).alias("cnt"), F.min("seq").alias("first_seq"),
        F.count(F.when(F.col("recency") <= 5, 1)).alias("recent_cnt"))
    per = Window.partitionBy("account", "dim")
    return counted.select(
        "account", "dim", "value", "n", "cnt", "recent_cnt",
        (F.col("cnt") / F.sum("cnt").over(per)).alias("freq"),
        F.row_number().over(per.orderBy(F.col("cnt").desc(), "first_seq")).cast("long").alias("rank"))


def _ranked(dim: str, item: Column) -> Column:
    inside = F.collect_list(F.when(F.col("dim") == dim, F.struct("rank", item.alias("item"))))
    return F.transform(F.sort_array(inside), lambda x: x["item"])


def distribution_columns(counted: DataFrame) -> DataFrame:
    """The distributions folded into one row per account."""
    pair = F.struct(F.col("value").alias("key"), F.col("freq"))
    r, h = F.col("recent_cnt") / 5, (F.col("cnt") - F.col("recent_cnt")) / (F.col("n") - 5)
    shift = F.when((F.col("dim") == "channel") & (F.col("n") >= 10),
                   F.when((r > h * 2) & (r > 0.3), F.concat(F.lit("increased_"), "value"))
                   .when((r < h * 0.5) & (h > 0.3), F.concat(F.lit("decreased_"), "value")))
    wide = counted.groupBy("account").agg(
        _ranked("channel", pair).alias("channels"), _ranked("type", pair).alias("types"),
        _ranked("recipient", pair).alias("recipients"), _ranked("country", pair).alias("countries"),
        _ranked("hour", F.col("value").cast("int")).alias("hours"),
        _ranked("weekday", F.col("value").cast("int")).alias("weekdays"),
        F.coalesce(F.sum(F.when(F.col("dim") == "recipient", F.col("cnt"))), F.lit(0)).alias("transfers"),
        F.sort_array(F.collect_list(shift)).alias("recent_channel_shifts"))
    keys = lambda c: F.transform(F.slice(c, 1, 3), lambda x: x["key"])
    return wide.select(
        "account", F.map_from_entries("channels").alias("channel_distribution"), keys("channels").alias(
            "preferred_channels"),
        F.map_from_entries("types").alias("type_distribution"), keys("types").alias("preferred_types"),
        F.slice("recipients", 1, 10).alias("common_recipients"),
        F.when(F.col("transfers") > 0, F.size("recipients") / F.col("transfers")).otherwise(0.0)
        .alias("recipient_diversity"),
        F.slice("countries", 1, 10).alias("common_countries"), F.slice("hours", 1, 3).alias("peak_hours"),
        F.slice("weekdays", 1, 3).alias("peak_days"), "recent_channel_shifts")


def scalar_columns(rows: DataFrame, as_of_us: int) -> DataFrame:
    """Amount, rate, gap, burst, trend and monthly columns: one aggregation per account."""
    w = Window.partitionBy("account").orderBy("ts_us", "id")
    near = F.col("gap_us") <= 300_000_000
    rows = rows.withColumn("_near", F.coalesce(near, F.lit(False)))
    rows = rows.withColumn("_burst", F.col("_near") & F.coalesce(F.lag("_near").over(w), F.lit(False)))
    n, cents, gap = F.col("n"), F.col("cents"), F.col("gap_us") / 1e6
    since = lambda days: F.count(F.when(F.col("ts_us") >= as_of_us - days * DAY_US, 1))
    last = F.least(n, F.lit(10))
    first_part = (F.col("recency") <= 10) & ((last - F.col("recency")) < F.floor(last / 2))
    second_part = (F.col("recency") <= 10) & ((last - F.col("recency")) >= F.floor(last / 2))
    early = F.col("seq") <= F.floor(n / 2)

    def mean_gap(side: Column) -> Column:
        t = F.when(side, F.col("ts_us"))
        return (F.max(t) - F.min(t)) / 1e6 / F.greatest(F.count(t) - 1, F.lit(1))

    recent = F.when(F.col("recency") <= PROFILE_RECENT, F.struct("ts_us", "id", "sender_account", "receiver_account",
                                                                 "cents"))
    months = [F.sum(F.when(F.month("ts") == m, cents).otherwise(0)).alias(f"m{m}") for m in range(1, 13)]
    agg = rows.groupBy("account").agg(
        F.max("n").alias("total_transactions"), F.sum("cents").alias("sum_cents"),
        F.stddev_samp(cents).alias("std_cents"), F.sort_array(F.collect_list("cents")).alias("sorted"),
        since(1).alias("d1"), since(7).alias("d7"), since(30).alias("d30"),
        F.count_if(~F.coalesce("destination_country", F.lit("ZW")).isin(COUNTRY_LISTS["domestic"])).alias("abroad"),
        F.avg(gap).alias("gap_avg"), F.stddev_samp(gap).alias("gap_std"), F.count_if("_burst").alias("burst_count"),
        F.avg(F.when(first_part, cents)).alias("amt_a"), F.avg(F.when(second_part, cents)).alias("amt_b"),
        mean_gap(early).alias("gap_a"), mean_gap(~early).alias("gap_b"),
        F.sort_array(F.collect_list(recent)).alias("recent_transactions"), *months)
    n = F.col("total_transactions")
    middle = F.col("sorted")
    median = (F.element_at(middle, F.floor((n - 1) / 2).cast("int") + 1)
              + F.element_at(middle, F.floor(n / 2).cast("int") + 1)) / 200
    monthly = F.array(*[F.col(f"m{m}") / 100 for m in range(1, 13)])
    mean12 = F.aggregate(monthly, F.lit(0.0), lambda a, x: a + x) / 12
    var12 = F.aggregate(F.transform(monthly, lambda x: (x - mean12) * (x - mean12)), F.lit(0.0),
                        lambda a, x: a + x) / 11

    def trend(a: Column, b: Column, up: float, down: float, least: int, rising_when_above: bool) -> Column:
        over, under = b > a * up, b < a * down
        rise, fall = (over, under) if rising_when_above else (under, over)
        return F.when(n < least, "stable").when(rise, "increasing").when(fall, "decreasing").otherwise("stable")

    return agg.select(
        "account", n, (F.col("sum_cents") / n / 100).alias("avg_amount"), median.alias("median_amount"),
        F.coalesce(F.col("std_cents") / 100, F.lit(0.0)).alias("std_amount"),
        (F.element_at(middle, 1) / 100).alias("min_amount"), (F.element_at(middle, -1) / 100).alias("max_amount"),
        *[(index_percentile(middle, p) / 100).alias(f"p{p}") for p in (25, 50, 75, 90, 95)],
        F.when(n >= 30, F.col("d1")).otherwise(n / 30).alias("avg_daily_tx_count"),
        F.when(n >= 90, F.col("d7")).otherwise(n / 90 * 7).alias("avg_weekly_tx_count"),
        F.when(n >= 365, F.col("d30")).otherwise(n / 365 * 30).alias("avg_monthly_tx_count"),
        (F.col("abroad") / n).alias("international_ratio"),
        F.coalesce("gap_avg", F.lit(0.0)).alias("time_between_tx_avg"),
        F.coalesce("gap_std", F.lit(0.0)).alias("time_between_tx_std"), "burst_count",
        (F.col("burst_count") > 0).alias("has_bursts"), monthly.alias("monthly_spending_pattern"),
        F.sqrt(var12).alias("seasonal_variance"),
        trend(F.col("amt_a"), F.col("amt_b"), 1.2, 0.8, 3, True).alias("recent_amount_trend"),
        trend(F.col("gap_a"), F.col("gap_b"), 1.3, 0.7, 10, False).alias("recent_frequency_trend"),
        "recent_transactions")


def build_profiles(tx: DataFrame, as_of_us: int, hot: HotKeys = NO_HOT_KEYS) -> DataFrame:
    """One profile row per account with at least five transactions before ``as_of_us``; ``hot`` is about accounts.

    Everything after the newest-500 cut is bounded per account and stays on one partitioning by account.
    """
    rows = profile_rows(tx, as_of_us, hot)
    out = scalar_columns(rows, as_of_us).join(distribution_columns(distributions(rows)), "account")
    return out.withColumn("as_of_us", F.lit(as_of_us).cast("long"))


def income_cycle(balances: DataFrame) -> DataFrame:
    """Regular rises of more than a tenth in a balance series ``(account, ts_us, id, balance_cents)``.

    Looks at the newest 500 balances of an account; a cycle is the mean number of entries between rises when their
    spread is below 30 % of it.
    """
    rows = with_sequence(latest_per_account(balances, PROFILE_HISTORY))
    w = Window.partitionBy("account").orderBy("ts_us", "id")
    rows = rows.withColumn("_last", F.lag("balance_cents").over(w))
    rises = rows.withColumn("_rise", F.when(F.col("balance_cents") > F.col("_last") * 1.1, F.col("seq")))
    before = F.max("_rise").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rises = rises.withColumn("_step", F.when(F.col("_rise").isNotNull(), F.col("_rise") - before))
    per = rises.groupBy("account").agg(
        F.max("n").alias("n"), F.avg("balance_cents").alias("mean"), F.stddev_samp("balance_cents").alias("sd"),
        F.avg("_step").alias("step"), F.coalesce(F.stddev_samp("_step"), F.lit(0.0)).alias("step_sd"))
    regular = F.coalesce((F.col("n") >= 6) & (F.col("step_sd") < F.col("step") * 0.3), F.lit(False))
    return per.select("account", (F.col("mean") / 100).alias("avg_balance"),
                      F.coalesce(F.col("sd") / 100, F.lit(0.0)).alias("balance_volatility"),
                      regular.alias("income_cycle_detected"),
                      F.when(regular, F.floor("step")).cast("long").alias("income_cycle_period"))

