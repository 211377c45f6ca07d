"""Which keys hold too many rows for one task, and how their history is cut into time chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moneytrail.constants import MINUTE_US

TASK_ROWS = 250_000


@dataclass(frozen=True)
class HotKeys:
    """Keys whose rows are spread over ``(key, chunk)`` groups; every other key stays in one group."""

    keys: tuple = ()
    chunk_us: int = MINUTE_US
    #: rows of the table, where they have been counted
    rows: int = 0

    def __bool__(self) -> bool:
        return bool(self.keys)

    def is_hot(self, key: Column) -> Column:
        return F.coalesce(key.isin(list(self.keys)), F.lit(False)) if self.keys else F.lit(False)

    def chunk(self, key: Column, ts_us: Column) -> Column:
        if not self.keys:
            return F.lit(0).cast("long")
        return F.when(self.is_hot(key), F.floor(ts_us / F.lit(self.chunk_us))).otherwise(F.lit(0)).cast("long")


    def dealt(self, df: DataFrame, *keys: str) -> DataFrame:
        """``df`` by ``keys``, for windows that follow. A large table is dealt over as many tasks as keep each at about
        ``TASK_ROWS`` rows: adaptive coalescing leaves one task per core, however much that is."""
        tasks = -(-self.rows // TASK_ROWS)
        return df.repartition(tasks, *keys) if tasks > df.sparkSession.sparkContext.defaultParallelism else df.repartition(*keys)


NO_HOT_KEYS = HotKeys()


def find_hot_keys(df: DataFrame, key: str, ts_us: str = "ts_us", max_rows: int = 1_000_000,
                  min_share: float = 1e-4, grain_us: int = MINUTE_US) -> HotKeys:
    """Count rows per key (partial aggregation, two columns read) and pick a chunk width for the large ones.

    A key is large above ``max(max_rows, min_share * total)`` rows, so at most ``1 / min_share`` keys can come
    back to the driver however much data there is.  The chunk width is a multiple of ``grain_us`` chosen from the
    densest grain, so a chunk holds about ``max_rows`` rows at most.
    """
    rows = df.count()  # often answered from file footers
    if rows <= max_rows:
        return HotKeys(rows=rows)
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.max("n").alias("most"), F.sum("n").alias("total")).first()
    if top["most"] is None or top["most"] <= max_rows:
        return HotKeys(rows=rows)
    limit = max(max_rows, int(top["total"] * min_share))
    keys = tuple(sorted(r[key] for r in counts.where((F.col("n") > limit) & F.col(key).isNotNull())
                        .select(key).collect()))
    if not keys:
        return HotKeys(rows=rows)
    densest = (df.where(F.col(key).isin(list(keys)))
               .groupBy(key, F.floor(F.col(ts_us) / grain_us).alias("grain")).count()
               .agg(F.max("count")).first()[0])
    return HotKeys(keys, grain_us * max(1, max_rows // max(1, densest)), rows)


def find_hot_accounts(tx: DataFrame, max_rows: int = 1_000_000, min_share: float = 1e-4) -> HotKeys:
    """Hot keys of the account ledger: an account's transactions in either direction."""
    rows = 2 * tx.count()
    if rows <= max_rows:
        return HotKeys(rows=rows)
    sides = F.explode(F.array("sender_account", "receiver_account")).alias("account")
    return find_hot_keys(tx.select(sides, "ts_us"), "account", "ts_us", max_rows, min_share)
