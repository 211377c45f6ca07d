"""Validation, cleaning, statistics and duplicate removal."""

from pyspark.sql import functions as F

from checks.registry import define, query
from moneytrail.operators import validation
from moneytrail.sources import views

AS_OF = views.EVENT_AS_OF
NUM = "CASE WHEN abs({0}) < 1e7 THEN CAST({0} AS VARCHAR) ELSE CAST(CAST({0} AS DECIMAL(28,1)) AS VARCHAR) END"
LEVELS = "('normal','low','medium','high','suspicious','high_risk','critical','super_suspicious')"
CHANNELS = "('online','mobile','atm','branch','card','ach','wire','swift','pos','api')"
TYPES = "('deposit','withdraw','transfer','payment','wire')"

define("checked", f"""
SELECT *, [x FOR x IN [
  CASE WHEN amount IS NULL THEN 'Missing required field: amount' END,
  CASE WHEN transaction_type IS NULL THEN 'Missing required field: transaction_type' END,
  CASE WHEN sender_account IS NULL THEN 'Missing required field: sender_account' END,
  CASE WHEN a IS NULL THEN 'Invalid amount value: ' || amount END,
  CASE WHEN a < 0.01 THEN 'Amount ' || {NUM.format('a')} || ' below minimum 0.01' END,
  CASE WHEN a > 10000000 THEN 'Amount ' || {NUM.format('a')} || ' exceeds maximum 10000000' END,
  CASE WHEN timestamp IS NULL THEN 'Missing timestamp' END,
  CASE WHEN timestamp IS NOT NULL AND p IS NULL THEN 'Invalid timestamp format: ' || timestamp END,
  CASE WHEN p < TIMESTAMP '2000-01-01' THEN 'Timestamp ' || strftime(p, '%Y-%m-%d %H:%M:%S') || '+00:00 before minimum 2000-01-01 00:00:00+00:00' END,
  CASE WHEN ty NOT IN {TYPES} THEN 'Invalid transaction type: ' || ty END,
  CASE WHEN ch NOT IN {CHANNELS} THEN 'Invalid channel: ' || ch END,
  CASE WHEN sender_account = '' THEN 'Invalid sender account: ' END,
  CASE WHEN rl NOT IN {LEVELS} THEN 'Invalid risk level: ' || rl END,
  CASE WHEN rs < 0 OR rs > 100 THEN 'Risk score ' || {NUM.format('rs')} || ' out of range [0, 100]' END,
  CASE WHEN risk_score IS NOT NULL AND rs IS NULL THEN 'Invalid risk score: ' || risk_score END
  ] IF x IS NOT NULL] AS errors
FROM (SELECT *, TRY_CAST(coalesce(amount, '0.0') AS DOUBLE) AS a, TRY_CAST(timestamp AS TIMESTAMP) AS p,
  lower(trim(coalesce(transaction_type, 'transfer'))) AS ty, lower(trim(coalesce(channel, 'online'))) AS ch,
  lower(trim(risk_level)) AS rl, TRY_CAST(risk_score AS DOUBLE) AS rs FROM raw_transactions)""", "raw_transactions")


def validated(spark, d):
    return validation.validate_transactions(views.raw_transactions(spark, d), AS_OF)


@query("validate_rows", f"""
SELECT id, CAST(copy_no AS BIGINT) AS copy_no, len(errors) = 0 AS is_valid, array_to_string(errors, ' | ') AS errors,
  CASE WHEN a IS NULL THEN 0.0 ELSE least(greatest(a, 0.01), 10000000) END AS amount,
  strftime(coalesce(p, TIMESTAMP '{AS_OF}'), '%Y-%m-%d %H:%M:%S') AS timestamp,
  CASE WHEN ty IN {TYPES} THEN ty ELSE 'transfer' END AS transaction_type,
  CASE WHEN ch IN {CHANNELS} THEN ch ELSE 'online' END AS channel,
  CASE WHEN coalesce(sender_account, '') = '' THEN 'UNKNOWN' ELSE sender_account END AS sender_account,
  CASE WHEN rl IN {LEVELS} THEN rl WHEN rl IS NOT NULL THEN 'normal' END AS risk_level,
  CASE WHEN risk_score IS NOT NULL THEN coalesce(least(greatest(rs, 0), 100), 0) END AS risk_score
FROM checked""", "checked")
def validate_rows(spark, d):
    rows = validated(spark, d)
    return rows.select("id", F.col("copy_no").cast("long").alias("copy_no"), "is_valid",
                       F.array_join("errors", " | ").alias("errors"), "amount",
                       F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "transaction_type",
                       "channel", "sender_account", "risk_level", "risk_score")


@query("validation_errors", "SELECT id, unnest(errors) AS error FROM checked", "checked")
def validation_errors(spark, d):
    return validation.split_valid(validated(spark, d))[2]


@query("validation_split", """
SELECT len(errors) = 0 AS valid, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum FROM checked GROUP BY 1""", "checked")
def validation_split(spark, d):
    valid, invalid, _ = validation.split_valid(validated(spark, d))
    both = valid.unionByName(invalid)
    return both.groupBy(F.col("is_valid").alias("valid")).agg(F.count(F.lit(1)).alias("n"),
                                                              F.sum("id").alias("id_sum"))


@query("validation_stats", """
SELECT count(*) AS total_validated, count(*) FILTER (len(errors) = 0) AS passed,
  count(*) FILTER (len(errors) > 0) AS failed, (count(*) FILTER (len(errors) = 0))::DOUBLE / count(*) AS pass_rate
FROM checked""", "checked")
def validation_stats(spark, d):
    return validation.validation_stats(validated(spark, d))


@query("validation_histogram", "SELECT error, count(*) AS n FROM (SELECT unnest(errors) AS error FROM checked) "
       "GROUP BY 1", "checked")
def validation_histogram(spark, d):
    return validation.error_histogram(validated(spark, d))


@query("dedupe", """
SELECT id, CAST(copy_no AS BIGINT) AS copy_no, amount FROM (SELECT *, row_number() OVER (PARTITION BY id
  ORDER BY timestamp NULLS LAST, copy_no) AS rn FROM raw_transactions) WHERE rn = 1""", "raw_transactions")
def dedupe(spark, d):
    rows = validation.dedupe_transactions(views.raw_transactions(spark, d), "id", "timestamp", "copy_no")
    return rows.select("id", F.col("copy_no").cast("long").alias("copy_no"), "amount")
