"""Monitoring tables derived from the benchmark tables (``events``, ``orders``, ``customer``, ``supplier``).

Each view is a projection of one table, so filters and column lists reach the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moneytrail.sources.tables import with_clock

EVENT_AS_OF = "2024-01-02 06:00:00"
ORDER_AS_OF = "2001-08-02 00:00:00"


def _pick(values: list[str], index: str) -> str:
    return f"element_at(array({', '.join(repr(v) for v in values)}), cast({index} AS INT) + 1)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_T0 = "unix_micros(timestamp '2024-01-01 00:00:00')"
_EVENT_TS = f"timestamp_micros({_T0} + (unix_micros(cast(ts AS timestamp)) - {_T0}) div 24)"
_CHANNELS = ["online", "mobile", "atm", "branch", "card", "ach", "wire", "swift", "pos", "api"]
_COUNTRIES = ["ZW", "ZW", "ZW", "ZW", "US", "GB", "ZA", "AE", "NG", "IR", "RU", "KY"]


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(_table(spark, sf_dir, "events"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same transactions as a stream over the events table, a file or a folder of part files."""
    schema = _table(spark, sf_dir, "events").schema
    # a pattern that only this name matches: the source takes a file only by a pattern
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return from_events(raw)


def from_events(events: DataFrame) -> DataFrame:
    return with_clock(events.selectExpr(
        "event_id AS id", f"{_EVENT_TS} AS ts", "concat('ACC', user_id) AS sender_account",
        "CASE WHEN event_type IN ('purchase','view','click') "
        "THEN concat('ACC', cast(get_json_object(props, '$.k') AS INT)) "
        "ELSE concat('ACC', user_id) END AS receiver_account",
        "CASE event_type WHEN 'signup' THEN 'deposit' WHEN 'error' THEN 'withdraw' ELSE 'transfer' END "
        "AS transaction_type",
        "cast(CASE WHEN user_id % 5 = 0 THEN round(value * 6, 2) WHEN event_id % 10 = 0 "
        "THEN round(value / 5) * 1000 ELSE round(value * 200, 2) END AS DECIMAL(18,2)) AS amount",
        f"{_pick(_CHANNELS, '(event_id + user_id) % 10')} AS channel",
        f"{_pick(_COUNTRIES, '(event_id * 7 + user_id) % 12')} AS destination_country"))


def order_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_clock(_table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id",
        "timestamp_micros(unix_micros(cast(o_orderdate AS timestamp)) + (o_orderkey % 86400) * 1000000) AS ts",
        "concat('ACC', o_custkey) AS sender_account",
        "CASE WHEN o_orderstatus = 'O' THEN concat('ACC', (o_custkey * 7 + o_orderkey) % 150) "
        "ELSE concat('ACC', o_custkey) END AS receiver_account",
        "CASE o_orderstatus WHEN 'O' THEN 'transfer' WHEN 'F' THEN 'deposit' ELSE 'withdraw' END "
        "AS transaction_type",
        "cast(o_totalprice AS DECIMAL(18,2)) AS amount",
        f"{_pick(_CHANNELS, '(o_orderkey + o_custkey) % 10')} AS channel",
        f"{_pick(_COUNTRIES, '(o_orderkey * 7 + o_custkey) % 12')} AS destination_country"))


_FIRST = ["Tendai", "Amina", "Bruno", "Chipo", "Dmitri", "Elena", "Farai", "Grace", "Hassan", "Ines", "Jonas",
          "Kudzai", "Leila", "Marko", "Nyasha", "Olga", "Pedro", "Rudo", "Selim", "Tariro"]
_LAST = ["Moyo", "Okafor", "Petrov", "Silva", "Ncube", "Haddad", "Larsen", "Dube", "Ortega", "Banda", "Keller",
         "Sibanda", "Rossi", "Mutasa", "Novak", "Phiri", "Almeida", "Chirwa", "Vargas", "Zulu"]


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "concat('ACC', c_custkey) AS account_number",
        f"concat({_pick(_FIRST, 'c_custkey % 20')}, ' ', {_pick(_LAST, '(c_custkey div 20) % 20')}) AS username",
        "concat(lpad(cast(c_custkey % 90 + 10 AS STRING), 2, '0'), '-', lpad(cast(c_custkey AS STRING), 7, '0'), "
        "'A', lpad(cast(c_custkey % 100 AS STRING), 2, '0')) AS id_number",
        "cast(c_acctbal * 10 AS DECIMAL(18,2)) AS balance",
        "CASE WHEN c_custkey % 7 = 0 THEN 'pending' WHEN c_custkey % 31 = 0 THEN 'rejected' ELSE 'verified' END "
        "AS kyc_status",
        "c_custkey % 37 = 0 AS pep_flag",
        "CASE WHEN c_custkey % 11 = 0 THEN 'high' WHEN c_custkey % 5 = 0 THEN 'medium' ELSE 'standard' END "
        "AS risk_rating",
        "CASE WHEN c_acctbal < 1000 THEN 'low' WHEN c_acctbal < 6000 THEN 'average' WHEN c_acctbal < 9000 "
        "THEN 'high' ELSE 'ultra_high' END AS wealth_segment",
        "timestamp(date_add(DATE'2023-01-01', cast(c_custkey % 365 AS INT))) AS created_at")


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = accounts(spark, sf_dir).select(F.col("id").alias("_k"), "username", "id_number", "account_number")
    listed = _table(spark, sf_dir, "supplier").select("s_suppkey", ((F.col("s_suppkey") * 13 + 3) % 150).alias("_k"))
    return listed.join(people, "_k").selectExpr(
        "s_suppkey AS id",
        "CASE s_suppkey % 4 WHEN 0 THEN username WHEN 1 THEN replace(username, 'o', 'a') "
        "WHEN 2 THEN concat(split_part(username, ' ', 2), ' ', split_part(username, ' ', 1)) "
        "ELSE concat('Entity ', s_suppkey) END AS name",
        "CASE WHEN s_suppkey % 4 = 3 AND s_suppkey % 8 = 3 THEN id_number END AS id_number",
        "CASE WHEN s_suppkey % 8 = 7 THEN lower(account_number) END AS account_number",
        f"{_pick(['sanctions', 'pep', 'internal', 'adverse_media'], '(s_suppkey div 4) % 4')} AS list_type",
        "cast(NULL AS STRING) AS reason")


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions as untyped text with faults injected, and every 67th row twice."""
    return transactions(spark, sf_dir).selectExpr(
        "id",
        "CASE WHEN id % 50 = 0 THEN NULL WHEN id % 51 = 0 THEN 'abc' WHEN id % 53 = 0 THEN concat('-', amount) "
        "WHEN id % 71 = 0 THEN '10000000000' ELSE cast(amount AS STRING) END AS amount",
        "CASE WHEN id % 57 = 0 THEN 'invalid-date' WHEN id % 73 = 0 THEN NULL WHEN id % 79 = 0 "
        "THEN '1999-12-31T23:59:59' ELSE date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") END AS timestamp",
        "CASE WHEN id % 59 = 0 THEN 'barter' WHEN id % 83 = 0 THEN NULL WHEN id % 3 = 0 "
        "THEN concat(' ', upper(transaction_type)) ELSE transaction_type END AS transaction_type",
        "CASE WHEN id % 61 = 0 THEN 'pigeon' WHEN id % 62 = 0 THEN NULL ELSE upper(channel) END AS channel",
        "CASE WHEN id % 89 = 0 THEN NULL WHEN id % 97 = 0 THEN '' ELSE sender_account END AS sender_account",
        "receiver_account",
        "CASE WHEN id % 101 = 0 THEN 'weird' WHEN id % 2 = 0 THEN 'Normal ' END AS risk_level",
        "CASE WHEN id % 103 = 0 THEN '150' WHEN id % 107 = 0 THEN 'n/a' WHEN id % 2 = 0 THEN '12.5' END "
        "AS risk_score",
        "explode(sequence(0, CASE WHEN id % 67 = 0 THEN 1 ELSE 0 END)) AS copy_no")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model outputs and ground truth with known relations to the amount."""
    return transactions(spark, sf_dir).selectExpr(
        "id", "ts_us",
        "CASE WHEN amount >= 10000 THEN 'super_suspicious' WHEN amount >= 5000 THEN 'suspicious' ELSE 'normal' END "
        "AS predicted",
        "CASE WHEN amount + (id % 7) * 1500 >= 12000 THEN 'super_suspicious' "
        "WHEN amount + (id % 7) * 1500 >= 7000 THEN 'suspicious' ELSE 'normal' END AS actual",
        "0.5 + (id % 50) / 100.0D AS confidence", "((id % 41) - 20) / 100.0D AS anomaly",
        "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS arm")


def case_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).selectExpr(
        "id", "ts_us", "id div 50 AS alert_id", "concat('ACC', (id div 50) % 150) AS account_number",
        "CASE WHEN transaction_type = 'deposit' THEN 'resolve' WHEN transaction_type = 'withdraw' THEN 'escalate' "
        "WHEN id % 3 = 0 THEN 'file_sar' ELSE 'note' END AS action")


def auth_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-in attempts: errors are failures, sign-ups are successes, time compressed for bursts."""
    ts = f"({_T0} + (unix_micros(cast(ts AS timestamp)) - {_T0}) div 2000)"
    return (_table(spark, sf_dir, "events").where("event_type IN ('error', 'signup')")
            .selectExpr("event_id AS id", "concat('user', user_id) AS identifier", f"{ts} AS ts_us",
                        "event_type = 'signup' AS success"))


def model_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "concat('model-', event_id % 7) AS model_id",
        "unix_micros(cast(ts AS timestamp)) AS ts_us",
        "CASE event_type WHEN 'purchase' THEN 'deployed' WHEN 'error' THEN 'undeployed' "
        "WHEN 'signup' THEN 'registered' ELSE 'evaluated' END AS action",
        "round(value / 500, 4) AS f1", "round(value / 400, 4) AS accuracy")
