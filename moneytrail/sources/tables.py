"""Readers and writers of the monitoring tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moneytrail.sources.profile_store import ProfileStore
from moneytrail.sources.schema import DEFAULTS, TABLES, conform_schema


def with_clock(df: DataFrame) -> DataFrame:
    """Add what the window operators order and sum by: ``ts_us`` (epoch microseconds) and ``cents`` (BIGINT)."""
    return df.withColumns({"ts_us": F.unix_micros(F.col("ts").cast("timestamp")),
                           "cents": F.round(F.col("amount") * 100).cast("long")})


def read_table(spark: SparkSession, name: str, path: str | None = None, format: str = "parquet",
               **options) -> DataFrame:
    """A monitoring table with its schema conformed; older files with fewer columns get the defaults.

    ``format="jdbc"`` reads a relational table (``url``, ``dbtable``, and ``partitionColumn`` with bounds for a
    parallel read); filters and column lists are pushed to the database.
    """
    reader = spark.read.format(format).options(**options)
    if format in ("parquet", "orc"):
        reader = reader.option("mergeSchema", "true")
    df = reader.load(path) if path else reader.load()
    return conform_schema(df, TABLES[name], DEFAULTS[name], keep_extra=True)


def read_transactions(spark: SparkSession, path: str | None = None, format: str = "parquet",
                      **options) -> DataFrame:
    return with_clock(read_table(spark, "transactions", path, format, **options))


def read_accounts(spark: SparkSession, path: str | None = None, format: str = "parquet", **options) -> DataFrame:
    return read_table(spark, "accounts", path, format, **options)


def read_watchlist(spark: SparkSession, path: str | None = None, format: str = "parquet", **options) -> DataFrame:
    return read_table(spark, "watchlist", path, format, **options)


def save_profiles(profiles: DataFrame, path: str, number: int | None = None) -> int:
    """Add a profile version to the store under ``path``; see :class:`ProfileStore`."""
    return ProfileStore(profiles.sparkSession, path).save(profiles, number)


def load_profiles(spark: SparkSession, path: str) -> DataFrame:
    """The latest profile of every account."""
    return ProfileStore(spark, path).load()


def latest_profiles(versions: DataFrame, key: str = "account", version: str = "as_of_us") -> DataFrame:
    """Latest version per account; the row number limit is applied before and after the shuffle."""
    w = Window.partitionBy(key).orderBy(F.col(version).desc())
    return versions.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
