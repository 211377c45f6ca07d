"""Prefix scans over time: what happened on a key strictly before each row.

All history columns of the package come from :func:`prior`.  A sliding window ``[t - N, t)`` is the running sum
of "+v at the row, -v when it leaves the window" over everything strictly earlier, so each row costs O(1)
instead of the O(frame) a sliding RANGE frame costs, and the sum can be cut anywhere: keys too large for one task
are split into time chunks, scanned per chunk, and the chunk totals are carried forward.  Distinct counts are the
same sum, with an item expiring as soon as it is seen again.
"""

from __future__ import annotations

from dataclasses import dataclass
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moneytrail.plans.hot import NO_HOT_KEYS, HotKeys

_FIRST = Window.unboundedPreceding


@dataclass(frozen=True)
class Measure:
    """One history column.

    ``op`` is sum, max or min of ``value`` over strictly earlier rows.  ``width_us`` keeps rows no older than that;
    ``expires`` (a timestamp column in microseconds) ends a row's contribution early.  Only sums may end.
    """

    name: str
    value: Column
    op: str = "sum"
    width_us: int | None = None
    expires: Column | None = None

    @property
    def ends(self) -> bool:
        return self.width_us is not None or self.expires is not None


_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def count_measure(name: str, when: Column | None = None, width_us: int | None = None) -> Measure:
    one = F.lit(1).cast("long")
    return Measure(name, one if when is None else F.when(when, one), "sum", width_us)


def prior(df: DataFrame, key: str | list[str], measures: list[Measure], ts_us: str = "ts_us",
          hot: HotKeys = NO_HOT_KEYS, partitioned: bool = False) -> DataFrame:
    """Add one column per measure: its value over rows of the same key with an earlier ``ts_us``.

    Sums without any earlier row are 0, max and min are NULL.  ``hot`` refers to the first key column.
    ``partitioned`` says the rows are already clustered by (a part of) the key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    columns = df.columns
    widths = sorted({m.width_us for m in measures if m.width_us is not None and m.expires is None})
    # measures that are given the very same column expire together, by one leave event
    timed = [m for m in measures if m.expires is not None]
    expiry = {m.name: next(o.name for o in timed if o.expires is m.expires) for m in timed}
    firsts = [m for m in timed if expiry[m.name] == m.name]
    endings = [("w", w) for w in widths] + [("m", m.name) for m in firsts]

    rows = df.select("*", *[m.value.alias(f"_v_{m.name}") for m in measures],
                     *[m.expires.alias(f"_x_{m.name}") for m in firsts])
    if endings:
        if not hot and not partitioned:
            # shuffle the plain rows; the leave events are made behind the exchange
            rows = hot.dealt(rows, *keys)
        # event 0 is the row itself; a leave event matters only when it takes something away
        times, takes = [f"WHEN 0 THEN `{ts_us}`"], ["_e = 0"]
        for i, (kind, what) in enumerate(endings, 1):
            times.append(f"WHEN {i} THEN " + (f"`{ts_us}` + {what}L" if kind == "w" else f"`_x_{what}`"))
            gone = " OR ".join(f"`_v_{m.name}` IS NOT NULL" for m in measures if _ends_with(m, kind, what, expiry))
            takes.append(f"(_e = {i} AND ({gone}))")
        rows = rows.selectExpr("*", f"explode(sequence(0, {len(endings)})) AS _e")
        rows = rows.selectExpr("*", f"CASE _e {' '.join(times)} END AS _t").where("_t IS NOT NULL")
        rows = rows.where(" OR ".join(takes)).selectExpr(
            *[f"`{c}`" if c in keys else f"if(_e = 0, `{c}`, NULL) AS `{c}`" for c in columns],
            "_e", "_t", *[f"{_delta(m, endings, expiry)} AS `_v_{m.name}`" for m in measures])
    else:
        rows = rows.selectExpr("*", f"`{ts_us}` AS _t", "0 AS _e")

    if hot:
        rows = rows.withColumn("_chunk", hot.chunk(F.col(keys[0]), F.col("_t")))
        groups = keys + ["_chunk"]
    else:
        groups = keys
    w = Window.partitionBy(*groups).orderBy("_t").rangeBetween(_FIRST, -1)
    out = rows.select("*", *[_AGG[m.op](f"_v_{m.name}").over(w).alias(m.name) for m in measures])
    out = out.where(F.col("_e") == 0)

    if hot:
        totals = (rows.where(hot.is_hot(F.col(keys[0])))
                  .groupBy(*groups).agg(*[_AGG[m.op](f"_v_{m.name}").alias(f"_c_{m.name}") for m in measures]))
        before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(_FIRST, -1)
        carry = totals.select(*groups, *[_AGG[m.op](f"_c_{m.name}").over(before).alias(f"_p_{m.name}")
                                         for m in measures])
        out = out.join(carry, groups, "left")
        out = out.select(*columns, *[_merge(m).alias(m.name) for m in measures])
    return out.selectExpr(*[f"`{c}`" for c in columns],
                          *[f"coalesce(`{m.name}`, 0) AS `{m.name}`" if m.op == "sum" else f"`{m.name}`"
                            for m in measures])


def _ends_with(m: Measure, kind: str, what, expiry: dict) -> bool:
    if m.expires is not None:
        return kind == "m" and what == expiry[m.name]
    return kind == "w" and what == m.width_us


def _delta(m: Measure, endings: list, expiry: dict) -> str:
    value = f"`_v_{m.name}`"
    leaves = [f"WHEN {i} THEN -{value}" for i, (kind, what) in enumerate(endings, 1)
              if m.ends and _ends_with(m, kind, what, expiry)]
    return f"CASE _e WHEN 0 THEN {value} {' '.join(leaves)} END"


def _merge(m: Measure) -> Column:
    local, carried = F.col(m.name), F.col(f"_p_{m.name}")
    if m.op == "sum":
        return F.when(carried.isNull(), local).otherwise(F.coalesce(local, F.lit(0)) + carried)
    return (F.greatest if m.op == "max" else F.least)(local, carried)  # both skip NULL


def neighbours(df: DataFrame, keys: list[str], ts_us: str = "ts_us", tie: str = "id",
               hot: HotKeys = NO_HOT_KEYS) -> DataFrame:
    """Add ``_prev`` (latest strictly earlier time) and ``_next`` (time of the following row) per key."""
    groups = list(keys)
    if hot:
        df = df.withColumn("_chunk", hot.chunk(F.col(keys[0]), F.col(ts_us)))
        groups = groups + ["_chunk"]
    order = Window.partitionBy(*groups).orderBy(ts_us, tie)
    before = Window.partitionBy(*groups).orderBy(ts_us).rangeBetween(_FIRST, -1)
    out = df.select("*", F.lead(ts_us).over(order).alias("_next"), F.max(ts_us).over(before).alias("_prev"))
    if not hot:
        return out
    edges = (df.where(hot.is_hot(F.col(keys[0]))).groupBy(*groups)
             .agg(F.min(ts_us).alias("_lo"), F.max(ts_us).alias("_hi")))
    by_chunk = Window.partitionBy(*keys).orderBy("_chunk")
    edges = edges.select(*groups, F.max("_hi").over(by_chunk.rowsBetween(_FIRST, -1)).alias("_hi_before"),
                         F.min("_lo").over(by_chunk.rowsBetween(1, Window.unboundedFollowing)).alias("_lo_after"))
    out = out.join(edges, groups, "left")
    return out.select(*df.drop("_chunk").columns, F.coalesce("_next", "_lo_after").alias("_next"),
                      F.coalesce("_prev", "_hi_before").alias("_prev"))


def running(df: DataFrame, key: str | list[str], measures: list[Measure], ts_us: str = "ts_us", tie: str = "id",
            hot: HotKeys = NO_HOT_KEYS) -> DataFrame:
    """Like :func:`prior`, but in ``(ts_us, tie)`` order and including the row itself."""
    keys = [key] if isinstance(key, str) else list(key)
    groups = list(keys)
    columns = df.columns
    rows = df.select("*", *[m.value.alias(f"_v_{m.name}") for m in measures])
    if hot:
        rows = rows.withColumn("_chunk", hot.chunk(F.col(keys[0]), F.col(ts_us)))
        groups.append("_chunk")
    w = Window.partitionBy(*groups).orderBy(ts_us, tie).rowsBetween(_FIRST, Window.currentRow)
    out = rows.select("*", *[_AGG[m.op](f"_v_{m.name}").over(w).alias(m.name) for m in measures])
    if hot:
        totals = (rows.where(hot.is_hot(F.col(keys[0]))).groupBy(*groups)
                  .agg(*[_AGG[m.op](f"_v_{m.name}").alias(f"_c_{m.name}") for m in measures]))
        before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(_FIRST, -1)
        carry = totals.select(*groups, *[_AGG[m.op](f"_c_{m.name}").over(before).alias(f"_p_{m.name}")
                                         for m in measures])
        out = out.join(carry, groups, "left").select(*columns, *[_merge(m).alias(m.name) for m in measures])
    return out.select(*columns, *[m.name for m in measures])
