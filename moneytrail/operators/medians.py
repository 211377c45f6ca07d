"""Median of all amounts of an account up to each row.

Small accounts sort their short history in the JVM, larger ones run group by group over two heaps.  For accounts
too large for one task the median is found digit by digit: at each level every row counts the earlier values per digit among those that share its
prefix, by the same chunked scan the other history columns use, and goes down the digit its rank falls into.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moneytrail.operators.windows import SENDER
from moneytrail.plans.hot import NO_HOT_KEYS, HotKeys
from moneytrail.plans.scan import Measure, count_measure, prior
from moneytrail.session import stable

_SMALL = 256  # rows; sorting every prefix of so short a history is cheaper than leaving the JVM
_BITS = 4
_LEVELS = 16  # of four bits: all of a long
_FLIPPED = "(cents ^ shiftleft(1L, 63))"  # with its sign bit flipped a signed number sorts as an unsigned one


def _heap_medians(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["ts_us", "id"], kind="stable")
    times, cents = rows["ts_us"].to_numpy(), rows["cents"].to_numpy()
    below: list = []  # negated, so the largest of the lower half is on top
    above: list = []
    out = []
    waiting: list = []
    for i in range(len(times)):
        if i and times[i] != times[i - 1]:
            for value in waiting:
                _push(below, above, value)
            waiting = []
        waiting.append(int(cents[i]))
        out.append(_with_current(below, above, int(cents[i])))
    return pd.DataFrame({"id": rows["id"].to_numpy(), "median_cents2": out})


def _push(below: list, above: list, value: int) -> None:
    if below and value > -below[0]:
        heapq.heappush(above, value)
    else:
        heapq.heappush(below, -value)
    if len(below) > len(above) + 1:
        heapq.heappush(above, -heapq.heappop(below))
    elif len(above) > len(below):
        heapq.heappush(below, -heapq.heappop(above))


def _with_current(below: list, above: list, value: int) -> int:
    """Twice the median of the heaps' values and ``value``; ``below`` holds as many as ``above`` or one more."""
    if not below:
        return 2 * value
    low = -below[0]
    if len(below) > len(above):
        other = max(low, min(value, above[0])) if above else value
        if value < low:
            # the lower half now has two more than the upper: its top two are the middle
            second = max([value] + [-v for v in below[1:3]])
            return low + second
        return low + other
    # equal halves: the middle element of three candidates
    return 2 * sorted([low, value, above[0]])[1]


def running_median(df: DataFrame, hot: HotKeys = NO_HOT_KEYS) -> DataFrame:
    """``id`` and ``median_cents2``: twice the median, in cents, of strictly earlier amounts and the row's own."""
    rows = df.select("id", SENDER, "ts_us", "cents")
    usual = rows.where(~hot.is_hot(F.col(SENDER))) if hot else rows
    sized = usual.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(SENDER)))
    large = sized.where(F.col("_n") > _SMALL).drop("_n")
    out = _sorted_medians(sized.where(F.col("_n") <= _SMALL)).unionByName(
        large.groupBy(SENDER).applyInPandas(_heap_medians, "id long, median_cents2 long"))
    if hot:
        out = out.unionByName(_digit_medians(rows.where(hot.is_hot(F.col(SENDER))), hot))
    return out


def _sorted_medians(rows: DataFrame) -> DataFrame:
    before = Window.partitionBy(SENDER).orderBy("ts_us").rangeBetween(Window.unboundedPreceding, -1)
    seen = rows.select("id", F.col("cents"), F.collect_list("cents").over(before).alias("seen"))
    seen = seen.selectExpr("id", "array_sort(array_append(seen, cents)) AS s")
    return seen.selectExpr("id", "s[cast((size(s) - 1) div 2 AS INT)] + s[cast(size(s) div 2 AS INT)] AS median_cents2")


def _digit_medians(rows: DataFrame, hot: HotKeys) -> DataFrame:
    """Descend from the top digit; the row's own amount joins the counts as one more value."""
    sized = prior(rows, SENDER, [count_measure("before")], hot=hot)
    total = F.col("before") + 1
    ranks = F.array(F.floor((total - 1) / 2), F.floor(total / 2)).alias("ranks")
    asks = sized.select("id", SENDER, "ts_us", "cents", F.posexplode(ranks).alias("part", "rank"))
    # digits that all amounts share need no descent
    low, high = rows.agg(F.min("cents"), F.max("cents")).first()
    if low is None:
        return asks.selectExpr("id", "cents AS median_cents2")
    low, high = low + (1 << 63), high + (1 << 63)
    levels = next((n for n in range(_LEVELS) if low >> (n * _BITS) == high >> (n * _BITS)), _LEVELS)
    shared = low >> (levels * _BITS)
    asks = asks.withColumn("prefix", F.lit(shared if shared < 1 << 63 else shared - (1 << 64)).cast("long"))
    one = F.lit(1).cast("long")
    for level in reversed(range(levels)):
        digit = F.expr(f"shiftrightunsigned({_FLIPPED}, {level * _BITS}) & {(1 << _BITS) - 1}L")
        above = F.expr(f"shiftrightunsigned({_FLIPPED}, {(level + 1) * _BITS})" if level + 1 < _LEVELS else "0L")
        facts = rows.select(SENDER, "ts_us", above.alias("prefix"),
                            digit.alias("digit"))
        both = asks.unionByName(facts, allowMissingColumns=True)
        both = prior(both, [SENDER, "prefix"],
                     [Measure(f"d{d}", F.when(F.col("digit") == d, one)) for d in range(1 << _BITS)], hot=hot)
        both = both.where("id IS NOT NULL")
        own = above == F.col("prefix")
        counts = F.array(*[F.col(f"d{d}") + F.when(own & (digit == d), 1).otherwise(0)
                           for d in range(1 << _BITS)])
        both = both.withColumn("_counts", counts)
        # walk the digits: (digits passed, rank left)
        state = F.struct(F.lit(0).alias("d"), F.col("rank").cast("long").alias("rank"), F.lit(False).alias("done"))
        walked = F.aggregate("_counts", state, lambda s, n: F.when(s["done"] | (s["rank"] < n), F.struct(
            s["d"].alias("d"), s["rank"].alias("rank"), F.lit(True).alias("done"))).otherwise(F.struct(
                (s["d"] + 1).alias("d"), (s["rank"] - n).alias("rank"), F.lit(False).alias("done"))))
        both = both.withColumn("_w", walked)
        asks = both.select("id", SENDER, "ts_us", "cents", "part", F.col("_w.rank").alias("rank"),
                           F.shiftleft("prefix", _BITS).bitwiseOR(F.col("_w.d").cast("long")).alias("prefix"))
        asks = stable(asks)  # each level reads the one before; keep the lineage short
    return asks.groupBy("id").agg(F.sum(F.col("prefix").bitwiseXOR(F.expr("shiftleft(1L, 63)"))).alias("median_cents2"))
