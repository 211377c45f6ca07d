"""The 82 features, by group, and the 25-column model vector."""

from pyspark.sql import functions as F

from checks.registry import define, query
from checks.rules import BY_SENDER, D7, H1, H24, PAST
from moneytrail.operators import features, history
from moneytrail.plans.hot import find_hot_accounts, find_hot_keys
from moneytrail.sources import views

AS_OF_US = 1704175200000000  # 2024-01-02 06:00:00
UPTO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

define("party_seen", f"""
SELECT id, account, direction,
  count(*) FILTER (direction = 'in') OVER w AS in_n, count(*) FILTER (direction = 'out') OVER w AS out_n,
  count(*) FILTER (direction = 'self') OVER w AS self_n,
  coalesce(sum(amount) FILTER (direction = 'in') OVER w, 0) AS in_v,
  coalesce(sum(amount) FILTER (direction = 'out') OVER w, 0) AS out_v,
  coalesce(sum(amount) FILTER (direction = 'self') OVER w, 0) AS self_v,
  count(DISTINCT CASE WHEN direction = 'in' THEN counterparty END) OVER w AS in_p,
  count(DISTINCT CASE WHEN direction = 'out' THEN counterparty END) OVER w AS out_p,
  count(DISTINCT CASE WHEN direction <> 'self' THEN counterparty END) OVER w AS partners,
  max(epoch_us(ts)) OVER w AS last_us
FROM ledger WINDOW w AS (PARTITION BY account ORDER BY ts {PAST})""", "ledger")

define("features_82", f"""
SELECT *, (is_high_risk_customer + is_pep + is_sanctioned + high_risk_country_involved + is_structuring_pattern
    + is_layering_pattern) / 6 AS risk_score_composite,
  (amount_deviation_from_avg + velocity_ratio_24h + is_new_recipient + is_night) / 4 AS anomaly_score_composite,
  amount_deviation_from_avg * 0.4::DOUBLE + velocity_ratio_24h * 0.3::DOUBLE + is_new_recipient * 0.3::DOUBLE AS behavioral_drift_score,
  greatest(velocity_ratio_1h, velocity_ratio_24h) AS velocity_spike_score
FROM (SELECT id, amt AS amount, ln(1 + amt) AS amount_log, sqrt(amt) AS amount_sqrt,
  (transaction_type = 'deposit')::DOUBLE AS transaction_type_deposit, (transaction_type = 'withdraw')::DOUBLE AS transaction_type_withdraw,
  (transaction_type = 'transfer')::DOUBLE AS transaction_type_transfer, 0.0::DOUBLE AS transaction_type_payment, 0.0::DOUBLE AS transaction_type_wire,
  CASE WHEN n0 = 0 OR av = 0 THEN 1.0 ELSE amt / av END AS amount_to_sender_avg, CASE WHEN n0 = 0 OR mx = 0 THEN 1.0 ELSE amt / mx END AS amount_to_sender_max,
  CASE WHEN n0 = 0 OR med = 0 THEN 1.0 ELSE amt / med END AS amount_to_sender_median,
  CASE WHEN n0 = 0 THEN 0.0 ELSE n0 + 1.0::DOUBLE END AS sender_tx_count, av AS sender_avg_amount, mx AS sender_max_amount, med AS sender_median_amount,
  CASE WHEN n0 = 0 OR flat THEN 0.0 ELSE sqrt(vr) / 100 END AS sender_amount_std,
  CASE WHEN n0 < 2 OR flat THEN 0.0 ELSE (cb - 3 * mean * sq + 2 * mean * mean * mean) / (vr * sqrt(vr)) END AS sender_amount_skew,
  CASE WHEN av > 0 THEN abs(amt - av) / av ELSE 0 END AS amount_deviation_from_avg, CASE WHEN mx > 0 THEN abs(amt - mx) / mx ELSE 0 END AS amount_deviation_from_max,
  hour(ts)::DOUBLE AS hour, (isodow(ts) - 1)::DOUBLE AS day_of_week, day(ts)::DOUBLE AS day_of_month, month(ts)::DOUBLE AS month,
  (isodow(ts) >= 6)::DOUBLE AS is_weekend, (hour(ts) < 5 OR hour(ts) >= 23)::DOUBLE AS is_night, (hour(ts) BETWEEN 5 AND 7)::DOUBLE AS is_early_morning,
  (hour(ts) BETWEEN 9 AND 16)::DOUBLE AS is_business_hours, 0.0::DOUBLE AS is_holiday, (day(ts) IN (1, 15))::DOUBLE AS is_salary_day,
  n1::DOUBLE AS sender_tx_count_1h, n24::DOUBLE AS sender_tx_count_24h, n7::DOUBLE AS sender_tx_count_7d,
  v1 AS sender_volume_1h, v24 AS sender_volume_24h, v7 AS sender_volume_7d,
  CASE WHEN v24 > 0 THEN amt / v24 ELSE 1.0 END AS amount_to_sender_volume_24h, CASE WHEN v7 > 0 THEN amt / v7 ELSE 1.0 END AS amount_to_sender_volume_7d,
  CASE WHEN v1 > 0 THEN amt / (v1 / n1) ELSE 1.0 END AS velocity_ratio_1h, CASE WHEN v24 > 0 THEN amt / (v24 / n24) ELSE 1.0 END AS velocity_ratio_24h,
  (reuse = 0)::DOUBLE AS is_new_recipient, reuse::DOUBLE AS recipient_reuse_count, u24::DOUBLE AS unique_recipients_24h, u7::DOUBLE AS unique_recipients_7d,
  (sender_account = receiver_account)::DOUBLE AS is_self_transfer, (rev > 0)::DOUBLE AS is_circular_transfer, 0.0::DOUBLE AS shared_recipient_count,
  0.0::DOUBLE AS recipient_risk_score,
  (destination_country <> 'ZW')::DOUBLE AS is_cross_border, 1.0::DOUBLE AS origin_country_risk, dr AS destination_country_risk,
  1.0::DOUBLE - dr AS country_risk_difference, 1.0::DOUBLE AS high_risk_country_involved,
  (channel = 'online')::DOUBLE AS channel_online, (channel = 'mobile')::DOUBLE AS channel_mobile, (channel = 'atm')::DOUBLE AS channel_atm,
  (channel = 'branch')::DOUBLE AS channel_branch, (channel = 'card')::DOUBLE AS channel_card, (channel = 'wire')::DOUBLE AS channel_wire,
  (channel = 'swift')::DOUBLE AS channel_swift,
  (({AS_OF_US} - epoch_us(created_at)) // 86400000000)::DOUBLE AS account_age_days,
  coalesce((({AS_OF_US} - s_last) // 86400000000 > 90)::DOUBLE, 0) AS is_dormant_account,
  coalesce((({AS_OF_US} - s_last) // 86400000000)::DOUBLE, 0) AS dormancy_period_days, 0.0::DOUBLE AS previous_alert_count, 0.0::DOUBLE AS previous_sar_count,
  pep_flag::DOUBLE AS is_pep, 0.0::DOUBLE AS is_sanctioned, (risk_rating = 'high')::DOUBLE AS is_high_risk_customer,
  (kyc_status = 'verified')::DOUBLE AS kyc_status_verified, (kyc_status = 'pending')::DOUBLE AS kyc_status_pending, (kyc_status = 'rejected')::DOUBLE AS kyc_status_rejected,
  (tr >= 3)::DOUBLE AS is_layering_pattern, (band >= 2)::DOUBLE AS is_structuring_pattern, (band >= 2)::DOUBLE AS is_smurfing_pattern,
  (hist AND (s_out_p + any_in) * 2 < s_in_p + any_out)::DOUBLE AS is_funnel_account, (amt > 50000 AND n24 >= 5)::DOUBLE AS is_rapid_movement,
  (s_partners + hist::INT > 10)::DOUBLE AS is_hub_account, (s_partners + hist::INT)::DOUBLE AS network_centrality,
  least(1.0, (s_partners + hist::INT) / 20.0::DOUBLE) AS cluster_density
FROM (SELECT t.*, CAST(t.amount AS DOUBLE) AS amt, a.created_at, a.kyc_status, a.pep_flag, a.risk_rating,
  s.last_us AS s_last, s.out_p AS s_out_p, s.in_p AS s_in_p, s.partners AS s_partners, (s.in_n + s.self_n > 0)::INT AS any_in, (s.out_n + s.self_n > 0)::INT AS any_out,
  s.last_us IS NOT NULL AS hist,
  CASE WHEN destination_country IN ('IR','RU','ZW') THEN 1.0 WHEN destination_country IN ('NG','AE') THEN 0.5 ELSE 0.0 END::DOUBLE AS dr,
  s1 / n / 100 AS av, s1 / n AS mean, s2::DOUBLE / n AS sq, s3::DOUBLE / n AS cb,
  greatest(s2::DOUBLE / n - (s1 / n) * (s1 / n), 0.0) AS vr, greatest(s2::DOUBLE / n - (s1 / n) * (s1 / n), 0.0) <= s2::DOUBLE / n * 1e-12 AS flat
 FROM (SELECT *, (amount * 100)::BIGINT AS c,
  count(*) OVER ({BY_SENDER} {PAST}) AS n0, (count(*) OVER ({BY_SENDER} {PAST}) + 1)::DOUBLE AS n,
  (sum((amount * 100)::HUGEINT) OVER ({BY_SENDER} {UPTO}))::DOUBLE AS s1, sum((amount * 100)::HUGEINT * (amount * 100)::HUGEINT) OVER ({BY_SENDER} {UPTO}) AS s2,
  sum((amount * 100)::HUGEINT * (amount * 100)::HUGEINT * (amount * 100)::HUGEINT) OVER ({BY_SENDER} {UPTO}) AS s3,
  CAST(max(amount) OVER ({BY_SENDER} {UPTO}) AS DOUBLE) AS mx,
  (median((amount * 100)::DOUBLE) OVER ({BY_SENDER} {UPTO})) / 100 AS med,
  count(*) OVER ({BY_SENDER} {H1}) AS n1, count(*) OVER ({BY_SENDER} {H24}) AS n24, count(*) OVER ({BY_SENDER} {D7}) AS n7,
  coalesce(CAST(sum(amount) OVER ({BY_SENDER} {H1}) AS DOUBLE), 0) AS v1, coalesce(CAST(sum(amount) OVER ({BY_SENDER} {H24}) AS DOUBLE), 0) AS v24,
  coalesce(CAST(sum(amount) OVER ({BY_SENDER} {D7}) AS DOUBLE), 0) AS v7,
  count(*) OVER (PARTITION BY sender_account, receiver_account ORDER BY ts {PAST}) AS reuse,
  count(DISTINCT receiver_account) OVER ({BY_SENDER} {H24}) AS u24, count(DISTINCT receiver_account) OVER ({BY_SENDER} {D7}) AS u7,
  count(*) FILTER (transaction_type = 'transfer') OVER ({BY_SENDER} {PAST}) AS tr,
  count(*) FILTER (amount BETWEEN 8000 AND 9999) OVER ({BY_SENDER} {PAST}) AS band
  FROM transactions) t
 JOIN accounts a ON a.account_number = t.sender_account JOIN party_seen s ON s.id = t.id AND s.direction <> 'in')
 LEFT JOIN (SELECT a.id AS rid, count(*) AS rev FROM transactions a JOIN transactions b ON b.sender_account = a.receiver_account
   AND b.receiver_account = a.sender_account AND b.ts < a.ts GROUP BY 1) ON rid = id)""",
       "transactions", "accounts", "party_seen")


def full_vector(spark, d, columns=features.FEATURES_82):
    tx = views.transactions(spark, d)
    return features.features_82(tx, views.accounts(spark, d), AS_OF_US, find_hot_keys(tx, "sender_account"),
                                find_hot_accounts(tx), columns)


def rounded(df, columns):
    return df.select("id", *[F.round(c, 6).alias(c) for c in columns])


def rounded_sql(columns, table):
    return "SELECT id, " + ", ".join(f"round(coalesce({c}, 0), 6) + 0.0 AS {c}" for c in columns) + f" FROM {table}"


for _name, _columns in {
    "features_txn": features.TRANSACTION, "features_behavior": features.BEHAVIOUR, "features_time": features.TIME,
    "features_velocity": features.VELOCITY, "features_relationship": features.RELATIONSHIP,
    "features_geo_channel": features.GEOGRAPHY + features.CHANNEL, "features_account": features.ACCOUNT,
    "features_network": features.NETWORK, "features_composite": features.COMPOSITE,
    "features_82": features.FEATURES_82,
}.items():
    @query(_name, rounded_sql(_columns, "features_82"), "features_82")
    def _group(spark, d, columns=_columns):
        return rounded(full_vector(spark, d, columns), columns)


define("sequence_profile", f"""
SELECT *, CASE WHEN n0 > 0 THEN s0 / n0 / 100 ELSE 0.0 END AS avg_amt,
  coalesce(mx0, 0) AS max_amt FROM (SELECT *, CAST(amount AS DOUBLE) AS amt,
  count(*) OVER ({BY_SENDER} {PAST}) AS n0, (sum((amount * 100)::BIGINT) OVER ({BY_SENDER} {PAST}))::DOUBLE AS s0,
  CAST(max(amount) OVER ({BY_SENDER} {PAST}) AS DOUBLE) AS mx0,
  count(*) OVER ({BY_SENDER} {H24}) AS n24, coalesce(CAST(sum(amount) OVER ({BY_SENDER} {H24}) AS DOUBLE), 0) AS v24,
  count(*) OVER (PARTITION BY sender_account, receiver_account ORDER BY ts {PAST}) AS reuse,
  count(*) OVER (PARTITION BY sender_account, CAST(ts AS DATE) ORDER BY ts {PAST}) AS sd_n,
  coalesce(CAST(sum(amount) OVER (PARTITION BY sender_account, CAST(ts AS DATE) ORDER BY ts {PAST}) AS DOUBLE), 0) AS sd_v,
  count(*) OVER (PARTITION BY sender_account, receiver_account ORDER BY ts {H24}) AS sr_n,
  count(*) OVER ({BY_SENDER} RANGE BETWEEN INTERVAL 10 MINUTES PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS rapid_n
  FROM transactions)""", "transactions")

define("features_25", """
SELECT id, amt AS amount, hour(ts)::DOUBLE AS hour, (transaction_type = 'deposit')::DOUBLE AS is_deposit,
  (transaction_type = 'withdraw')::DOUBLE AS is_withdraw, (transaction_type = 'transfer')::DOUBLE AS is_transfer,
  (sender_account = receiver_account)::DOUBLE AS is_self, (hour(ts) < 5 OR hour(ts) >= 23)::DOUBLE AS is_night,
  avg_amt AS sender_avg_amount, max_amt AS sender_max_amount, n0::DOUBLE AS sender_tx_count,
  CASE WHEN avg_amt > 0 THEN amt / avg_amt ELSE 1.0 END AS amount_to_sender_avg,
  CASE WHEN max_amt > 0 THEN amt / max_amt ELSE 1.0 END AS amount_to_sender_max,
  n24::DOUBLE AS sender_tx_count_24h, v24 AS sender_volume_24h,
  CASE WHEN v24 > 0 THEN amt / v24 ELSE 1.0 END AS amount_to_sender_volume_24h, (reuse = 0)::DOUBLE AS is_new_recipient,
  CASE channel WHEN 'mobile' THEN 1.0 WHEN 'atm' THEN 2.0 WHEN 'branch' THEN 3.0 WHEN 'card' THEN 4.0 WHEN 'ach' THEN 5.0
    WHEN 'wire' THEN 6.0 WHEN 'swift' THEN 7.0 ELSE 0.0 END::DOUBLE AS channel_code,
  (amount >= 10000)::DOUBLE AS is_ctr_amount, (amount BETWEEN 8500 AND 9999)::DOUBLE AS is_structuring_amount,
  sd_n::DOUBLE AS same_day_count, sd_v AS same_day_total, sr_n::DOUBLE AS same_recipient_count, rapid_n::DOUBLE AS rapid_transfer_count,
  ((amount BETWEEN 8000 AND 9999)::INT + (sd_n >= 3)::INT)::DOUBLE AS structuring_indicators,
  ((rapid_n >= 2)::INT + (sr_n >= 2)::INT + (transaction_type = 'transfer' AND amount >= 5000)::INT)::DOUBLE AS layering_indicators
FROM sequence_profile""", "sequence_profile")


def model_vector(spark, d):
    tx = views.transactions(spark, d)
    return features.features_25(tx, find_hot_keys(tx, "sender_account"))


@query("features_25", rounded_sql(features.FEATURES_25, "features_25"), "features_25")
def features_25(spark, d):
    return rounded(model_vector(spark, d), features.FEATURES_25)


@query("prior_case_counts", f"""
SELECT id, count(*) FILTER (alert) OVER w AS previous_alert_count, count(*) FILTER (alert AND sid >= 20000) OVER w AS previous_sar_count
FROM (SELECT id, sender_account AS account, ts, false AS alert, NULL AS sid, 0 AS kind FROM transactions
  UNION ALL SELECT NULL, sender_account, ts, true, amount, 1 FROM transactions WHERE amount >= 10000)
WINDOW w AS (PARTITION BY account ORDER BY ts {PAST}) QUALIFY kind = 0""", "transactions")
def prior_case_counts(spark, d):
    tx = views.transactions(spark, d)
    alerts = tx.where("amount >= 10000").select("id", F.col("sender_account").alias("account_number"), "ts", "amount")
    sars = alerts.where("amount >= 20000").select("id", "account_number", F.col("ts").alias("created_at"))
    return history.prior_case_counts(tx, alerts, sars, find_hot_keys(tx, "sender_account"))
