"""Activity of an account before each of its transactions.

``df -> df`` with added columns; history is strictly earlier (``ts < t``) and a window of N is ``[t - N, t)``.
Amounts are summed as integer cents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moneytrail.constants import DAY_US, HOUR_US, MINUTE_US
from moneytrail.plans.hot import NO_HOT_KEYS, HotKeys
from moneytrail.plans.scan import Measure, count_measure, neighbours, prior, running

WEEK_US = 7 * DAY_US
SENDER = "sender_account"
RECEIVER = "receiver_account"


def on_sender(df: DataFrame, hot: HotKeys) -> DataFrame:
    """Partition by sender once; pair and sender windows that follow reuse it."""
    return df if hot else hot.dealt(df, SENDER)


def distinct_measure(name: str, when: Column, width_us: int | None = None) -> Measure:
    """Distinct items over earlier rows, on rows that carry ``_next`` of their (key, item) pair."""
    ends = F.col("_next") if width_us is None else F.least(F.col("_next"), F.col("ts_us") + width_us)
    return Measure(name, F.when(when, F.lit(1).cast("long")), "sum", expires=F.when(when, ends))


def prior_activity(df: DataFrame, widths: dict[str, int] | None = None, hot: HotKeys = NO_HOT_KEYS) -> DataFrame:
    """Count and volume of the sender's transactions over the last hour, day and week."""
    widths = widths or {"1h": HOUR_US, "24h": DAY_US, "7d": WEEK_US}
    measures = []
    for name, width in widths.items():
        measures += [count_measure(f"count_{name}", None, width),
                     Measure(f"cents_{name}", F.col("cents"), "sum", width)]
    return prior(df, SENDER, measures, hot=hot)


def prior_sum_if(df: DataFrame, name: str, condition: Column, width_us: int,
                 hot: HotKeys = NO_HOT_KEYS) -> DataFrame:
    return prior(df, SENDER, [count_measure(f"{name}_count", condition, width_us),
                              Measure(f"{name}_cents", F.when(condition, F.col("cents")), "sum", width_us)], hot=hot)


def prior_distinct(df: DataFrame, column: str = RECEIVER, widths: dict[str, int] | None = None,
                   when: Column | None = None, hot: HotKeys = NO_HOT_KEYS) -> DataFrame:
    """Distinct values of ``column`` the sender used before (``distinct_*``) and with the current one added
    (``distinct_*_with_current``)."""
    widths = widths or {"1h": HOUR_US, "24h": DAY_US}
    flag = F.lit(True) if when is None else F.coalesce(when, F.lit(False))
    rows = on_sender(df.withColumn("_on", flag), hot)
    rows = neighbours(rows, [SENDER, column, "_on"], hot=hot)
    rows = prior(rows, SENDER, [distinct_measure(f"distinct_{n}", F.col("_on"), w) for n, w in widths.items()],
                 hot=hot)
    for name, width in widths.items():
        known = F.coalesce(F.col("_prev") >= F.col("ts_us") - width, F.lit(False)) & F.col("_on")
        rows = rows.withColumn(f"distinct_{name}_with_current",
                               F.col(f"distinct_{name}") + F.when(known, 0).otherwise(1))
    return rows.drop("_on", "_next", "_prev")


def same_day_prior(df: DataFrame, hot: HotKeys = NO_HOT_KEYS) -> DataFrame:
    """Earlier transactions of the sender on the same UTC day."""
    end_of_day = (F.floor(F.col("ts_us") / DAY_US) + 1) * DAY_US - 1
    return prior(df, SENDER, [
        Measure("same_day_count", F.lit(1).cast("long"), "sum", expires=end_of_day),
        Measure("same_day_cents", F.col("cents"), "sum", expires=end_of_day)], hot=hot)


def same_recipient_prior(df: DataFrame, width_us: int = DAY_US, hot: HotKeys = NO_HOT_KEYS) -> DataFrame:
    return prior(df, [SENDER, RECEIVER], [count_measure("same_recipient_count", None, width_us)], hot=hot)


def rapid_prior(df: DataFrame, hot: HotKeys = NO_HOT_KEYS) -> DataFrame:
    return prior(df, SENDER, [count_measure("rapid_transfer_count", None, 10 * MINUTE_US)], hot=hot)


def sender_prior(df: DataFrame, hot: HotKeys = NO_HOT_KEYS) -> DataFrame:
    """Lifetime count, volume and largest amount of the sender before each transaction."""
    return prior(df, SENDER, [count_measure("prior_count"), Measure("prior_cents", F.col("cents")),
                              Measure("prior_max_cents", F.col("cents"), "max")], hot=hot)


def is_new_recipient(df: DataFrame, hot: HotKeys = NO_HOT_KEYS) -> DataFrame:
    rows = neighbours(on_sender(df, hot), [SENDER, RECEIVER], hot=hot)
    return rows.withColumn("is_new_recipient", F.col("_prev").isNull()).drop("_prev", "_next")


# --- over an account ledger (both directions; see operators.ledger) ----------------------------------------

def days_since_previous(ledger: DataFrame, hot: HotKeys = NO_HOT_KEYS) -> DataFrame:
    """Whole days since the account's latest earlier activity; NULL on the first."""
    rows = prior(ledger, "account", [Measure("previous_us", F.col("ts_us"), "max")], hot=hot)
    return rows.withColumn("idle_days", F.floor((F.col("ts_us") - F.col("previous_us")) / DAY_US))


def latest_per_account(ledger: DataFrame, n: int, hot: HotKeys = NO_HOT_KEYS, parts: int = 64) -> DataFrame:
    """Newest ``n`` rows of each account, numbered from the newest (``recency`` 1).

    The rank filter is applied per task before the shuffle as well, so an account sends at most ``n`` rows per task. Rows of
    hot accounts are cut in two steps: to ``n`` in each of ``parts`` shares of an account, then to ``n`` of those.
    """
    newest = [F.col("ts_us").desc(), F.col("id").desc()]
    if hot:
        is_hot = hot.is_hot(F.col("account"))
        shares = Window.partitionBy("account", F.pmod(F.xxhash64("id"), F.lit(parts))).orderBy(*newest)
        few = ledger.where(is_hot).withColumn("recency", F.row_number().over(shares)).where(F.col("recency") <= n).drop("recency")
        ledger = ledger.where(~is_hot).unionByName(few)
    w = Window.partitionBy("account").orderBy(*newest)
    return ledger.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def with_sequence(latest: DataFrame) -> DataFrame:
    """Row number in time order, group size, gap to the row before; for rows already bounded per account."""
    w = Window.partitionBy("account").orderBy("ts_us", "id")
    whole = Window.partitionBy("account")
    return latest.select("*", F.row_number().over(w).alias("seq"), F.count(F.lit(1)).over(whole).alias("n"),
                         (F.col("ts_us") - F.lag("ts_us").over(w)).alias("gap_us"))


def gap_stats(sequenced: DataFrame) -> DataFrame:
    gap = F.col("gap_us") / 1e6
    return sequenced.groupBy("account").agg(F.coalesce(F.avg(gap), F.lit(0.0)).alias("gap_avg"),
                                            F.coalesce(F.stddev_samp(gap), F.lit(0.0)).alias("gap_std"))


def burst_rows(sequenced: DataFrame, gap_us: int = 300 * 1_000_000) -> DataFrame:
    """Rows that make an island of gaps of at most five minutes three or more long, with the island so far."""
    w = Window.partitionBy("account").orderBy("ts_us", "id")
    rows = sequenced.withColumn("_new", F.when(F.col("gap_us") <= gap_us, 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("_new").over(w))
    inside = Window.partitionBy("account", "island").orderBy("ts_us", "id")
    rows = rows.select("*", F.row_number().over(inside).alias("burst_len"),
                       F.sum("cents").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("burst_cents"))
    return rows.where("burst_len >= 3").drop("_new")


def bursts(sequenced: DataFrame, gap_us: int = 300 * 1_000_000) -> DataFrame:
    """Per account: number of burst rows, and the first five as ``bursts``."""
    rows = burst_rows(sequenced, gap_us)
    item = F.struct(F.col("seq"), (F.col("seq") - F.col("burst_len")).alias("start_index"),
                    (F.col("seq") - 1).alias("end_index"), F.col("burst_len").cast("long").alias("count"),
                    (F.col("burst_cents") / 100).alias("total_amount"))
    found = rows.groupBy("account").agg(F.count(F.lit(1)).alias("burst_count"),
                                        F.slice(F.sort_array(F.collect_list(item)), 1, 5).alias("bursts"))
    return found.withColumn("has_bursts", F.col("burst_count") > 0)


def amount_trend(sequenced: DataFrame) -> DataFrame:
    """Last ten amounts: mean of the second half against 1.2 and 0.8 times the mean of the first."""
    last = sequenced.where(F.col("recency") <= 10).withColumn("_m", F.least("n", F.lit(10)))
    first_half = (F.col("_m") - F.col("recency")) < F.floor(F.col("_m") / 2)
    halves = last.groupBy("account").agg(
        F.max("_m").alias("m"), F.avg(F.when(first_half, F.col("cents"))).alias("a"),
        F.avg(F.when(~first_half, F.col("cents"))).alias("b"))
    return halves.select("account", F.when(F.col("m") < 3, "stable").when(F.col("b") > F.col("a") * 1.2, "increasing")
                         .when(F.col("b") < F.col("a") * 0.8, "decreasing").otherwise("stable")
                         .alias("recent_amount_trend"))


def frequency_trend(sequenced: DataFrame) -> DataFrame:
    """Mean gap inside the second half of the history against the first; from ten transactions."""
    early = F.col("seq") <= F.floor(F.col("n") / 2)

    def mean_gap(side: Column) -> Column:
        t = F.when(side, F.col("ts_us"))
        return (F.max(t) - F.min(t)) / 1e6 / F.greatest(F.count(t) - 1, F.lit(1))

    halves = sequenced.groupBy("account").agg(F.max("n").alias("m"), mean_gap(early).alias("a"),
                                              mean_gap(~early).alias("b"))
    return halves.select("account", F.when(F.col("m") < 10, "stable").when(F.col("b") < F.col("a") * 0.7, "increasing")
                         .when(F.col("b") > F.col("a") * 1.3, "decreasing").otherwise("stable")
                         .alias("recent_frequency_trend"))


def channel_shifts(sequenced: DataFrame) -> DataFrame:
    """Channels whose share in the last five differs strongly from before; from ten transactions."""
    recent = F.col("recency") <= 5
    per = (sequenced.where(F.col("n") >= 10).groupBy("account", "channel")
           .agg(F.max("n").alias("n"), F.count(F.when(recent, 1)).alias("r"), F.count(F.when(~recent, 1)).alias("h")))
    r, h = F.col("r") / 5, F.col("h") / (F.col("n") - 5)
    shift = (F.when((r > h * 2) & (r > 0.3), F.concat(F.lit("increased_"), "channel"))
             .when((r < h * 0.5) & (h > 0.3), F.concat(F.lit("decreased_"), "channel")))
    return (per.select("account", shift.alias("shift")).where("shift IS NOT NULL").groupBy("account")
            .agg(F.sort_array(F.collect_list("shift")).alias("recent_channel_shifts")))


def running_balance(ledger: DataFrame, opening: Column | None = None, floor: bool = False,
                    hot: HotKeys = NO_HOT_KEYS) -> DataFrame:
    """Balance after each ledger entry (``balance_cents``), from ``opening`` cents (default 0).

    With ``floor`` a balance never drops below zero; that sequential rule has the closed form
    ``sum - min(0, lowest sum so far)``, so it needs two scans and no loop.
    """
    start = F.lit(0).cast("long") if opening is None else opening
    rows = running(ledger, "account", [Measure("_sum", F.col("signed_cents"))], hot=hot)
    rows = rows.withColumn("balance_cents", F.col("_sum") + start).drop("_sum")
    if not floor:
        return rows
    rows = running(rows, "account", [Measure("_lowest", F.col("balance_cents"), "min")], hot=hot)
    return rows.withColumn("balance_cents", F.col("balance_cents") - F.least(F.lit(0), "_lowest")).drop("_lowest")


def next_open_alert(alerts: DataFrame) -> DataFrame:
    """For each alert the open alert an analyst sees after it: the top of the queue, or the second if it is the top.

    Only the two newest open alerts can be the answer, so no sort of the whole queue is needed.
    """
    top = alerts.where("status = 'open'").orderBy(F.col("ts").desc(), F.col("id").desc()).limit(2)
    ranked = top.agg(F.sort_array(F.collect_list(F.struct(F.col("ts"), F.col("id"))), False).alias("top"))
    first, second = (ranked.select(F.get("top", F.lit(i))["id"]).scalar() for i in (0, 1))
    return alerts.select(*alerts.columns, F.when(first == F.col("id"), second).otherwise(first).alias("next_alert_id"))
