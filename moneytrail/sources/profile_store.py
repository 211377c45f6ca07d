"""Profiles on disk: new versions are added, gathered from time to time, and read as the latest of every account.

A version is a folder of its own, ``delta=<number>``.  After ``keep`` of them the latest row of every account is written to
``base=<number of the last one>``; readers take the newest base and the versions after it, so they read one row per account
and at most ``keep`` versions however often profiles were saved.  Folders count once Spark has marked them as complete:
what a lost job left half-written is overlooked and written over.  What a base replaces stays until the next base, for
readers that have begun before.  One writer at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moneytrail.session import delete_folder

_NUMBER = "_store_version"


class ProfileStore:
    def __init__(self, spark: SparkSession, path: str, key: str = "account", version: str = "as_of_us", keep: int = 8):
        if keep < 1:
            raise ValueError("keep at least one version")
        self.spark, self.path, self.key, self.version, self.keep = spark, path.rstrip("/"), key, version, keep

    def _complete(self, kind: str) -> list[int]:
        """Numbers of the complete folders of a kind, in order."""
        context = self.spark.sparkContext
        hadoop = context._jvm.org.apache.hadoop.fs.Path
        marks = hadoop(f"{self.path}/{kind}=*/_SUCCESS")
        found = marks.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(marks)
        return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found or [])

    def _folder(self, kind: str, number: int) -> str:
        return f"{self.path}/{kind}={number}"

    def save(self, profiles: DataFrame, number: int | None = None) -> int:
        """Add a version and return its number, the next one if none is given.

        A retried job passes the number it had: its folder is written over, and nothing happens if it was gathered already.
        """
        bases, deltas = self._complete("base"), self._complete("delta")
        last = max([*bases, *deltas], default=-1)
        number = last + 1 if number is None else number
        if bases and number <= bases[-1]:
            return number
        profiles.write.mode("overwrite").parquet(self._folder("delta", number))
        if sum(d > (bases[-1] if bases else -1) for d in {*deltas, number}) >= self.keep:
            self.gather()
        return number

    def gather(self) -> None:
        """Write the latest row of every account as the new base and delete what the base before it had replaced."""
        bases, deltas = self._complete("base"), self._complete("delta")
        if not deltas or bases and deltas[-1] <= bases[-1]:
            return
        self.load().write.mode("overwrite").parquet(self._folder("base", deltas[-1]))
        for b in bases[:-1]:
            delete_folder(self.spark, self._folder("base", b))
        for d in deltas:
            if bases and d <= bases[-1]:
                delete_folder(self.spark, self._folder("delta", d))

    def load(self) -> DataFrame:
        """One row per account: the largest ``version``, among equal ones what was saved last.  Columns that older versions
        lack are null there."""
        bases, deltas = self._complete("base"), self._complete("delta")
        base = bases[-1] if bases else -1
        folders = [("base", base)] * bool(bases) + [("delta", d) for d in deltas if d > base]
        if not folders:
            raise FileNotFoundError(f"no profiles in {self.path}")
        parts = [self.spark.read.parquet(self._folder(*f)).withColumn(_NUMBER, F.lit(f[1])) for f in folders]
        if len(parts) == 1 and bases:
            return parts[0].drop(_NUMBER)  # a base has one row per account already
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        w = Window.partitionBy(self.key).orderBy(F.col(self.version).desc_nulls_last(), F.col(_NUMBER).desc())
        return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", _NUMBER)
