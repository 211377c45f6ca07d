"""Typology rules, their history windows, and the sequence windows."""

from pyspark.sql import functions as F

from checks.registry import define, query
from moneytrail.constants import HOUR_US
from moneytrail.functions.register import register_functions
from moneytrail.operators import rules, windows
from moneytrail.plans.hot import find_hot_keys
from moneytrail.sources import views

H1 = "RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING"
H24 = "RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING"
D7 = "RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING"
PAST = "RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING"
BY_SENDER = "PARTITION BY sender_account ORDER BY ts"
RISK_LEVEL = ("CASE WHEN {0} >= 80 THEN 'critical' WHEN {0} >= 60 THEN 'high_risk' WHEN {0} >= 40 THEN 'suspicious' "
              "WHEN {0} >= 25 THEN 'low' ELSE 'normal' END")

define("rule_history", f"""
SELECT t.*, count(*) OVER ({BY_SENDER} {H1}) AS n1,
  coalesce(sum(amount) OVER ({BY_SENDER} {H1}), 0) AS v1,
  count(*) FILTER (transaction_type = 'deposit' AND amount < 500) OVER ({BY_SENDER} {H1}) AS sd_n,
  coalesce(sum(amount) FILTER (transaction_type = 'deposit' AND amount < 500) OVER ({BY_SENDER} {H1}), 0) AS sd_v,
  coalesce(sum(amount) FILTER (transaction_type IN ('transfer','withdraw')) OVER ({BY_SENDER} {H24}), 0) AS out24,
  len(list_distinct(list_append(coalesce(list(receiver_account) FILTER (transaction_type = 'transfer')
      OVER ({BY_SENDER} {H1}), []), receiver_account))) AS rec1
FROM transactions t""", "transactions")

M = "format('{{:,.2f}}', CAST({0} AS DOUBLE))"
define("rule_hit_rows", f"""
SELECT id, 'R01' AS rule_id, 45 AS score_delta, 'critical' AS severity, 'Large Cash' AS typology,
  'Cash transaction of $' || {M.format('amount')} || ' meets the CTR threshold' AS reason
  FROM rule_history WHERE transaction_type IN ('deposit','withdraw') AND amount >= 10000
UNION ALL SELECT id, 'R01', 20, 'warning', 'Large Cash', 'Large cash transaction of $' || {M.format('amount')}
  FROM rule_history WHERE transaction_type IN ('deposit','withdraw') AND amount >= 3000 AND amount < 10000
UNION ALL SELECT id, 'R02', 50, 'critical', 'Structuring', '$' || {M.format('amount')} || ' falls in the structuring watch band'
  FROM rule_history WHERE amount BETWEEN 8500 AND 9999
UNION ALL SELECT id, 'R03', 40, 'critical', 'Smurfing', (sd_n + 1) || ' small deposits totalling $' || {M.format('amount + sd_v')} || ' within 60 minutes'
  FROM rule_history WHERE transaction_type = 'deposit' AND amount < 500 AND sd_n + 1 >= 3
UNION ALL SELECT id, 'R04', 35, 'critical', 'Velocity / Layering', (n1 + 1) || ' transactions totalling $' || {M.format('amount + v1')} || ' within 60 minutes'
  FROM rule_history WHERE n1 + 1 >= 5
UNION ALL SELECT id, 'R05', 35, 'critical', 'Fan-Out / Layering', 'Transfers to ' || rec1 || ' recipients within 60 minutes'
  FROM rule_history WHERE transaction_type = 'transfer' AND rec1 >= 3
UNION ALL SELECT id, 'R06', 15, 'info', 'Round Amount', 'Round-number transfer of $' || format('{{:,.0f}}', CAST(amount AS DOUBLE))
  FROM rule_history WHERE transaction_type = 'transfer' AND amount >= 1000 AND amount % 1000 = 0
UNION ALL SELECT id, 'R07', 30, 'critical', 'SAR Trigger', 'Transfer of $' || {M.format('amount')} || ' meets SAR review threshold'
  FROM rule_history WHERE transaction_type = 'transfer' AND amount >= 5000
UNION ALL SELECT id, 'R08', 25, 'warning', 'Self-Transfer', 'Self-transfer indicates a possible pass-through account'
  FROM rule_history WHERE transaction_type = 'transfer' AND sender_account = receiver_account
UNION ALL SELECT id, 'R09', 30, 'warning', 'Unusual Volume', '24-hour outflow of $' || {M.format('amount + out24')} || ' exceeds the monitoring threshold'
  FROM rule_history WHERE transaction_type IN ('transfer','withdraw') AND amount + out24 > 20000
UNION ALL SELECT id, 'R10', 20, 'warning', 'Off-Hours Activity', '$' || {M.format('amount')} || ' transaction at ' || lpad(CAST(hour(ts) AS VARCHAR), 2, '0') || ':00 is off-hours activity'
  FROM rule_history WHERE amount >= 1000 AND (hour(ts) < 5 OR hour(ts) >= 23)
UNION ALL SELECT id, 'R11', 55, 'critical', 'High-Risk Geography', 'Transaction involves high-risk jurisdiction ' || destination_country
  FROM rule_history WHERE destination_country IN ('IR','KP','MM','RU','SY','YE','ML','BF','SO')""", "rule_history")

define("rule_scores", f"""
SELECT t.*, CAST(least(100, coalesce(s, 0)) AS BIGINT) AS rule_score,
  {RISK_LEVEL.format('least(100, coalesce(s, 0))')} AS rule_level,
  coalesce(crit, false) AS critical_rule, coalesce(r07, false) AS r07, coalesce(nrules, 0) AS nrules
FROM transactions t LEFT JOIN (
  SELECT id, sum(score_delta) AS s, bool_or(severity = 'critical') AS crit, bool_or(rule_id = 'R07') AS r07,
    count(*) AS nrules FROM rule_hit_rows GROUP BY id) h USING (id)""", "transactions", "rule_hit_rows")


def assessed(spark, d):
    tx = views.transactions(spark, d)
    return rules.assess_rules(tx, find_hot_keys(tx, "sender_account"))


@query("rule_hits", "SELECT id, rule_id, CAST(score_delta AS BIGINT) AS score_delta, severity, typology, reason "
       "FROM rule_hit_rows", "rule_hit_rows")
def rule_hits(spark, d):
    return rules.rule_hits(assessed(spark, d)).drop("evidence")


@query("rule_scores", "SELECT id, rule_score, rule_level, CAST(nrules AS BIGINT) AS n_rules FROM rule_scores",
       "rule_scores")
def rule_scores(spark, d):
    return assessed(spark, d).select("id", "rule_score", "rule_level",
                                     F.size("rules").cast("long").alias("n_rules"))


for _rule in [f"R{i:02d}" for i in range(1, 12)]:
    @query(f"rule_{_rule.lower()}", f"SELECT severity, count(*) AS hits, CAST(sum(score_delta) AS BIGINT) AS points "
           f"FROM rule_hit_rows WHERE rule_id = '{_rule}' GROUP BY severity", "rule_hit_rows")
    def _one_rule(spark, d, rule=_rule):
        return (rules.rule_hits(assessed(spark, d)).where(F.col("rule_id") == rule).groupBy("severity")
                .agg(F.count(F.lit(1)).alias("hits"), F.sum("score_delta").alias("points")))


@query("rule_flags", "SELECT id, transaction_type IN ('deposit','withdraw') AND amount >= 10000 AS ctr_required, "
       "r07 OR rule_level IN ('suspicious','super_suspicious','high_risk','critical') AS sar_required, "
       "critical_rule AS mandatory FROM rule_scores", "rule_scores")
def rule_flags(spark, d):
    rows = rules.ctr_required(assessed(spark, d))
    return rules.is_mandatory(rules.sar_required(rows, "rule_level")).select("id", "ctr_required", "sar_required",
                                                                             "mandatory")


@query("velocity_windows", f"""
SELECT id, count(*) OVER ({BY_SENDER} {H1}) AS count_1h, count(*) OVER ({BY_SENDER} {H24}) AS count_24h,
  count(*) OVER ({BY_SENDER} {D7}) AS count_7d,
  coalesce(CAST(sum(amount) OVER ({BY_SENDER} {H1}) AS DOUBLE), 0) AS volume_1h,
  coalesce(CAST(sum(amount) OVER ({BY_SENDER} {H24}) AS DOUBLE), 0) AS volume_24h,
  coalesce(CAST(sum(amount) OVER ({BY_SENDER} {D7}) AS DOUBLE), 0) AS volume_7d FROM transactions""", "transactions")
def velocity_windows(spark, d):
    tx = views.transactions(spark, d)
    rows = windows.prior_activity(tx, hot=find_hot_keys(tx, "sender_account"))
    return rows.select("id", "count_1h", "count_24h", "count_7d",
                       *[(F.col(f"cents_{w}") / 100).alias(f"volume_{w}") for w in ("1h", "24h", "7d")])


@query("conditional_windows", f"""
SELECT id, count(*) FILTER (transaction_type = 'deposit' AND amount < 500) OVER ({BY_SENDER} {H1}) AS small_count,
  coalesce(CAST(sum(amount) FILTER (transaction_type = 'deposit' AND amount < 500) OVER ({BY_SENDER} {H1}) AS DOUBLE), 0)
  AS small_volume FROM transactions""", "transactions")
def conditional_windows(spark, d):
    tx = views.transactions(spark, d)
    rows = windows.prior_sum_if(tx, "small", (F.col("transaction_type") == "deposit") & (F.col("amount") < 500),
                                HOUR_US, find_hot_keys(tx, "sender_account"))
    return rows.select("id", "small_count", (F.col("small_cents") / 100).alias("small_volume"))


@query("fan_out_windows", f"""
SELECT id, CAST(count(DISTINCT receiver_account) OVER ({BY_SENDER} {H1}) AS BIGINT) AS distinct_1h,
  CAST(count(DISTINCT receiver_account) OVER ({BY_SENDER} {H24}) AS BIGINT) AS distinct_24h,
  CAST(len(list_distinct(list_append(coalesce(list(receiver_account) OVER ({BY_SENDER} {H1}), []), receiver_account)))
    AS BIGINT) AS distinct_1h_with_current FROM transactions""", "transactions")
def fan_out_windows(spark, d):
    tx = views.transactions(spark, d)
    return windows.prior_distinct(tx, hot=find_hot_keys(tx, "sender_account")).select(
        "id", "distinct_1h", "distinct_24h", "distinct_1h_with_current")


@query("sequence_windows", f"""
SELECT id, count(*) OVER (PARTITION BY sender_account, CAST(ts AS DATE) ORDER BY ts {PAST}) AS same_day_count,
  coalesce(CAST(sum(amount) OVER (PARTITION BY sender_account, CAST(ts AS DATE) ORDER BY ts {PAST}) AS DOUBLE), 0)
    AS same_day_total,
  count(*) OVER (PARTITION BY sender_account, receiver_account ORDER BY ts {H24}) AS same_recipient_count,
  count(*) OVER ({BY_SENDER} RANGE BETWEEN INTERVAL 10 MINUTES PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)
    AS rapid_transfer_count
FROM transactions""", "transactions")
def sequence_windows(spark, d):
    tx = views.transactions(spark, d)
    hot = find_hot_keys(tx, "sender_account")
    rows = windows.rapid_prior(windows.same_recipient_prior(windows.same_day_prior(tx, hot), hot=hot), hot)
    return rows.select("id", "same_day_count", (F.col("same_day_cents") / 100).alias("same_day_total"),
                       "same_recipient_count", "rapid_transfer_count")


@query("sender_prior", f"""
SELECT id, count(*) OVER ({BY_SENDER} {PAST}) AS prior_count,
  coalesce(CAST(sum(amount) OVER ({BY_SENDER} {PAST}) AS DOUBLE), 0) AS prior_volume,
  CAST(max(amount) OVER ({BY_SENDER} {PAST}) AS DOUBLE) AS prior_max FROM transactions""", "transactions")
def sender_prior(spark, d):
    tx = views.transactions(spark, d)
    return windows.sender_prior(tx, find_hot_keys(tx, "sender_account")).select(
        "id", "prior_count", (F.col("prior_cents") / 100).alias("prior_volume"),
        (F.col("prior_max_cents") / 100).alias("prior_max"))


@query("new_recipients", f"""
SELECT id, count(*) OVER (PARTITION BY sender_account, receiver_account ORDER BY ts {PAST}) = 0 AS is_new_recipient
FROM transactions""", "transactions")
def new_recipients(spark, d):
    tx = views.transactions(spark, d)
    return windows.is_new_recipient(tx, find_hot_keys(tx, "sender_account")).select("id", "is_new_recipient")


@query("cash_reporting", """
SELECT transaction_type, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total, CAST(max(amount) AS DOUBLE) AS largest
FROM transactions WHERE transaction_type IN ('deposit','withdraw') AND amount >= 10000 GROUP BY 1""", "transactions")
def cash_reporting(spark, d):
    rows = rules.ctr_required(views.transactions(spark, d)).where("ctr_required")
    return rows.groupBy("transaction_type").agg(
        F.count(F.lit(1)).alias("n"), (F.sum("cents") / 100).alias("total"), (F.max("cents") / 100).alias("largest"))


@query("sql_functions", f"""
SELECT id, {RISK_LEVEL.format('rule_score')} AS level, CASE WHEN rule_score >= 75 THEN 'critical' WHEN rule_score >= 50 THEN 'high' WHEN rule_score >= 25 THEN 'medium' ELSE 'low' END AS composite,
  CASE rule_level WHEN 'normal' THEN 0 WHEN 'low' THEN 1 WHEN 'suspicious' THEN 2 WHEN 'critical' THEN 4 ELSE 3 END::BIGINT AS rank FROM rule_scores""", "rule_scores")
def sql_functions(spark, d):
    register_functions(spark)
    return assessed(spark, d).selectExpr("id", "aml_risk_level(rule_score) AS level",
                                         "aml_composite_level(rule_score) AS composite",
                                         "cast(aml_risk_rank(rule_level) AS BIGINT) AS rank")
