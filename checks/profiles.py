"""Behavioural profiles, window statistics over the newest history, anomaly and behavioural risk."""

import uuid

from pyspark.sql import functions as F

from checks.registry import define, query
from moneytrail.operators import anomaly, features, ledger, profiles, windows
from moneytrail.plans.hot import find_hot_accounts, find_hot_keys
from moneytrail.session import shared_folder
from moneytrail.sources import tables, views
from moneytrail.sources.profile_store import ProfileStore
import checks.features  # noqa: F401
import checks.ledgers  # noqa: F401

AS_OF_US = 1704132000000000  # 2024-01-01 18:00:00
_SEQ = "PARTITION BY account ORDER BY ts, id"


def _rows(ledger_name: str, as_of_us: int) -> str:
    return f"""
SELECT *, row_number() OVER ({_SEQ}) AS seq, count(*) OVER (PARTITION BY account) AS n, (amount * 100)::BIGINT AS cents,
  (epoch_us(ts) - lag(epoch_us(ts)) OVER ({_SEQ})) / 1e6 AS gap FROM (
    SELECT *, row_number() OVER (PARTITION BY account ORDER BY ts DESC, id DESC) AS recency FROM {ledger_name}
    WHERE epoch_us(ts) < {as_of_us}) WHERE recency <= 500 QUALIFY n >= 5"""


define("profile_rows", _rows("ledger", AS_OF_US), "ledger")

define("profile_values", """
SELECT account, n, seq, recency, 'channel' AS dim, channel AS value FROM profile_rows
UNION ALL SELECT account, n, seq, recency, 'type', transaction_type FROM profile_rows
UNION ALL SELECT account, n, seq, recency, 'recipient', receiver_account FROM profile_rows WHERE transaction_type = 'transfer'
UNION ALL SELECT account, n, seq, recency, 'country', destination_country FROM profile_rows
UNION ALL SELECT account, n, seq, recency, 'hour', CAST(hour(ts) AS VARCHAR) FROM profile_rows
UNION ALL SELECT account, n, seq, recency, 'weekday', CAST(isodow(ts) - 1 AS VARCHAR) FROM profile_rows""", "profile_rows")

define("profile_dist", """
SELECT *, cnt::DOUBLE / sum(cnt) OVER (PARTITION BY account, dim) AS freq,
  row_number() OVER (PARTITION BY account, dim ORDER BY cnt DESC, first_seq) AS rank,
  count(*) OVER (PARTITION BY account, dim) AS vals, sum(cnt) OVER (PARTITION BY account, dim) AS total FROM (
  SELECT account, dim, value, max(n) AS n, count(*) AS cnt, min(seq) AS first_seq, count(*) FILTER (recency <= 5) AS recent
  FROM profile_values GROUP BY ALL)""", "profile_values")

define("profile_scalars", f"""
SELECT account, max(n) AS n, sum(cents)::DOUBLE / max(n) / 100 AS avg_amount, median(cents) / 100 AS median_amount,
  stddev_samp(cents) / 100 AS std_amount, CAST(min(amount) AS DOUBLE) AS min_amount, CAST(max(amount) AS DOUBLE) AS max_amount,
  {", ".join(f"(list_sort(list(cents)))[(max(n) * {p}) // 100 + 1]::DOUBLE / 100 AS p{p}" for p in (25, 50, 75, 90, 95))},
  count(*) FILTER (epoch_us(ts) >= {AS_OF_US} - 86400000000) AS d1, count(*) FILTER (epoch_us(ts) >= {AS_OF_US} - 7 * 86400000000) AS d7,
  count(*) FILTER (epoch_us(ts) >= {AS_OF_US} - 30 * 86400000000) AS d30,
  (count(*) FILTER (destination_country NOT IN ('ZW','US','GB','')))::DOUBLE / max(n) AS international_ratio,
  coalesce(avg(gap), 0) AS gap_avg, coalesce(stddev_samp(gap), 0) AS gap_std FROM profile_rows GROUP BY account""", "profile_rows")


def base(spark, d):
    return views.transactions(spark, d)


def rows(spark, d):
    return profiles.profile_rows(base(spark, d), AS_OF_US)


def built(spark, d):
    return profiles.build_profiles(base(spark, d), AS_OF_US)


def _round(*names):
    return [F.round(n, 6).alias(n) for n in names]


_AMOUNTS = ["avg_amount", "median_amount", "std_amount", "min_amount", "max_amount", "p25", "p50", "p75", "p90", "p95"]


@query("profile_amounts", "SELECT account, n AS total_transactions, " +
       ", ".join(f"round({c}, 6) AS {c}" for c in _AMOUNTS) + " FROM profile_scalars", "profile_scalars")
def profile_amounts(spark, d):
    return built(spark, d).select("account", "total_transactions", *_round(*_AMOUNTS))


@query("profile_rates", """
SELECT account, round(CASE WHEN n >= 30 THEN d1 ELSE n / 30.0::DOUBLE END, 6) AS avg_daily_tx_count,
  round(CASE WHEN n >= 90 THEN d7 ELSE n / 90.0::DOUBLE * 7 END, 6) AS avg_weekly_tx_count,
  round(CASE WHEN n >= 365 THEN d30 ELSE n / 365.0::DOUBLE * 30 END, 6) AS avg_monthly_tx_count,
  round(international_ratio, 6) AS international_ratio FROM profile_scalars""", "profile_scalars")
def profile_rates(spark, d):
    return built(spark, d).select("account", *_round("avg_daily_tx_count", "avg_weekly_tx_count",
                                                     "avg_monthly_tx_count", "international_ratio"))


for _dim, (_, _k) in profiles.DIMENSIONS.items():
    @query(f"profile_distribution_{_dim}", f"""
SELECT account, value, cnt, round(freq, 6) AS freq, rank FROM profile_dist WHERE dim = '{_dim}' AND rank <= {_k}""",
           "profile_dist")
    def _dist(spark, d, dim=_dim, k=_k):
        out = profiles.distributions(rows(spark, d)).where((F.col("dim") == dim) & (F.col("rank") <= k))
        return out.select("account", "value", "cnt", F.round("freq", 6).alias("freq"), "rank")


@query("profile_peaks", """
SELECT account, string_agg(value, ',' ORDER BY rank) FILTER (dim = 'hour' AND rank <= 3) AS peak_hours,
  string_agg(value, ',' ORDER BY rank) FILTER (dim = 'weekday' AND rank <= 3) AS peak_days,
  string_agg(value, ',' ORDER BY rank) FILTER (dim = 'channel' AND rank <= 3) AS preferred_channels,
  round(coalesce(max(vals::DOUBLE / total) FILTER (dim = 'recipient'), 0), 6) AS recipient_diversity
FROM profile_dist GROUP BY account""", "profile_dist")
def profile_peaks(spark, d):
    return built(spark, d).select("account", F.array_join("peak_hours", ",").alias("peak_hours"),
                                  F.array_join("peak_days", ",").alias("peak_days"),
                                  F.array_join("preferred_channels", ",").alias("preferred_channels"),
                                  F.round("recipient_diversity", 6).alias("recipient_diversity"))


@query("profile_gaps", "SELECT account, round(gap_avg, 6) AS gap_avg, round(gap_std, 6) AS gap_std FROM "
       "profile_scalars", "profile_scalars")
def profile_gaps(spark, d):
    return windows.gap_stats(rows(spark, d)).select("account", *_round("gap_avg", "gap_std"))


@query("profile_bursts", """
SELECT account, sum(len - 2)::BIGINT AS burst_count FROM (
  SELECT account, isl, count(*) AS len FROM (
    SELECT account, sum(CASE WHEN gap <= 300 THEN 0 ELSE 1 END) OVER (PARTITION BY account ORDER BY ts, id) AS isl FROM profile_rows)
  GROUP BY ALL) WHERE len >= 3 GROUP BY account""", "profile_rows")
def profile_bursts(spark, d):
    return windows.bursts(rows(spark, d)).select("account", "burst_count")


@query("profile_burst_counts", """
SELECT account, coalesce(b, 0)::BIGINT AS burst_count FROM (SELECT DISTINCT account FROM profile_rows) LEFT JOIN (
SELECT account, sum(len - 2) AS b FROM (
  SELECT account, isl, count(*) AS len FROM (
    SELECT account, sum(CASE WHEN gap <= 300 THEN 0 ELSE 1 END) OVER (PARTITION BY account ORDER BY ts, id) AS isl FROM profile_rows)
  GROUP BY ALL) WHERE len >= 3 GROUP BY account) USING (account)""", "profile_rows")
def profile_burst_counts(spark, d):
    return built(spark, d).select("account", "burst_count")


@query("profile_monthly", """
SELECT account, round(m1, 6) AS january, round(sqrt(list_aggregate(v, 'var_samp')), 6) AS seasonal_variance FROM (
  SELECT account, CAST(sum(amount) FILTER (month(ts) = 1) AS DOUBLE) AS m1,
    [coalesce(CAST(sum(amount) FILTER (month(ts) = 1) AS DOUBLE), 0), 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0] AS v
  FROM profile_rows GROUP BY account)""", "profile_rows")
def profile_monthly(spark, d):
    return built(spark, d).select("account", F.round(F.element_at("monthly_spending_pattern", 1), 6).alias("january"),
                                  F.round("seasonal_variance", 6).alias("seasonal_variance"))


@query("profile_trends", """
SELECT account, CASE WHEN m < 3 THEN 'stable' WHEN b > a * 1.2 THEN 'increasing' WHEN b < a * 0.8 THEN 'decreasing' ELSE 'stable' END AS recent_amount_trend,
  CASE WHEN n < 10 THEN 'stable' WHEN gb < ga * 0.7 THEN 'increasing' WHEN gb > ga * 1.3 THEN 'decreasing' ELSE 'stable' END AS recent_frequency_trend
FROM (SELECT account, max(n) AS n, max(least(n, 10)) AS m,
  avg(cents) FILTER (recency <= 10 AND least(n, 10) - recency < least(n, 10) // 2) AS a,
  avg(cents) FILTER (recency <= 10 AND least(n, 10) - recency >= least(n, 10) // 2) AS b,
  avg(gap) FILTER (seq > 1 AND seq <= n // 2) AS ga, avg(gap) FILTER (seq > n // 2 + 1) AS gb FROM profile_rows GROUP BY account)""",
       "profile_rows")
def profile_trends(spark, d):
    return built(spark, d).select("account", "recent_amount_trend", "recent_frequency_trend")


@query("profile_trend_windows", """
SELECT account, CASE WHEN m < 3 THEN 'stable' WHEN b > a * 1.2 THEN 'increasing' WHEN b < a * 0.8 THEN 'decreasing' ELSE 'stable' END AS recent_amount_trend,
  CASE WHEN n < 10 THEN 'stable' WHEN gb < ga * 0.7 THEN 'increasing' WHEN gb > ga * 1.3 THEN 'decreasing' ELSE 'stable' END AS recent_frequency_trend
FROM (SELECT account, max(n) AS n, max(least(n, 10)) AS m,
  avg(cents) FILTER (recency <= 10 AND least(n, 10) - recency < least(n, 10) // 2) AS a,
  avg(cents) FILTER (recency <= 10 AND least(n, 10) - recency >= least(n, 10) // 2) AS b,
  avg(gap) FILTER (seq > 1 AND seq <= n // 2) AS ga, avg(gap) FILTER (seq > n // 2 + 1) AS gb FROM profile_rows GROUP BY account)""",
       "profile_rows")
def profile_trend_windows(spark, d):
    r = rows(spark, d)
    return windows.amount_trend(r).join(windows.frequency_trend(r), "account")


_SHIFTS = """
SELECT account, string_agg(shift, ',' ORDER BY shift) AS shifts FROM (
  SELECT account, CASE WHEN r > h * 2 AND r > 0.3 THEN 'increased_' || value WHEN r < h * 0.5 AND h > 0.3 THEN 'decreased_' || value END AS shift
  FROM (SELECT *, recent / 5.0::DOUBLE AS r, (cnt - recent)::DOUBLE / (n - 5) AS h FROM profile_dist WHERE dim = 'channel' AND n >= 10))
WHERE shift IS NOT NULL GROUP BY account"""


@query("profile_channel_shift", _SHIFTS, "profile_dist")
def profile_channel_shift(spark, d):
    return windows.channel_shifts(rows(spark, d)).select(
        "account", F.array_join("recent_channel_shifts", ",").alias("shifts"))


@query("profile_channel_shift_columns", _SHIFTS, "profile_dist")
def profile_channel_shift_columns(spark, d):
    return built(spark, d).select("account", F.array_join("recent_channel_shifts", ",").alias("shifts")).where(
        "shifts <> ''")


@query("profile_recent", f"""
SELECT account, count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM profile_rows WHERE recency <= 50
GROUP BY account""", "profile_rows")
def profile_recent(spark, d):
    t = F.col("recent_transactions")
    return built(spark, d).select("account", F.size(t).cast("long").alias("n"), t[0]["ts_us"].alias("first_us"),
                                  F.element_at(t, -1)["ts_us"].alias("last_us"))


@query("profile_latest_version", f"""
SELECT account, n AS total_transactions FROM profile_scalars""", "profile_scalars")
def profile_latest_version(spark, d):
    old = profiles.build_profiles(base(spark, d), AS_OF_US - 6 * 3600 * 1_000_000)
    both = built(spark, d).unionByName(old)
    return tables.latest_profiles(both).where(F.col("as_of_us") == AS_OF_US).select("account", "total_transactions")


@query("profile_store", """
SELECT account, n AS total_transactions FROM profile_scalars""", "profile_scalars")
def profile_store(spark, d):
    """An older version, the current one, and a late copy of the older, gathered twice on the way."""
    old = profiles.build_profiles(base(spark, d), AS_OF_US - 6 * 3600 * 1_000_000)
    store = ProfileStore(spark, f"{shared_folder(spark)}/profiles-{uuid.uuid4().hex}", keep=2)
    for version in (old, built(spark, d), old):
        store.save(version)
    return store.load().where(F.col("as_of_us") == AS_OF_US).select("account", "total_transactions")


@query("income_cycle", """
WITH b AS (SELECT account, ts, id, sum(signed) OVER (PARTITION BY account ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 100 AS bal FROM order_ledger),
r AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY ts, id) AS seq, count(*) OVER (PARTITION BY account) AS n, lag(bal) OVER (PARTITION BY account ORDER BY ts, id) AS last
  FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY ts DESC, id DESC) AS recency FROM b) WHERE recency <= 500),
s AS (SELECT *, CASE WHEN bal > last * 1.1::DOUBLE THEN seq END AS rise FROM r),
u AS (SELECT *, CASE WHEN rise IS NOT NULL THEN rise - max(rise) OVER (PARTITION BY account ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS step FROM s),
g AS (SELECT account, max(n) AS n, avg(bal::DOUBLE) / 100 AS m, coalesce(stddev_samp(bal::DOUBLE) / 100, 0) AS sd, avg(step) AS st, coalesce(stddev_samp(step), 0) AS ssd FROM u GROUP BY account)
SELECT account, round(m, 6) AS avg_balance, round(sd, 4) AS balance_volatility, coalesce(n >= 6 AND ssd < st * 0.3, false) AS income_cycle_detected,
  CASE WHEN n >= 6 AND ssd < st * 0.3 THEN floor(st)::BIGINT END AS income_cycle_period FROM g""", "order_ledger")
def income_cycle(spark, d):
    tx = views.order_transactions(spark, d)
    series = windows.running_balance(ledger.account_ledger(tx), hot=find_hot_accounts(tx))
    out = profiles.income_cycle(series)
    return out.select("account", F.round("avg_balance", 6).alias("avg_balance"),
                      F.round("balance_volatility", 4).alias("balance_volatility"), "income_cycle_detected",
                      "income_cycle_period")


define("anomaly_scores", """
WITH f AS (SELECT account, list(struct_pack(k := value, f := freq, r := rank) ORDER BY rank) FILTER (dim = 'channel') AS ch,
    list(struct_pack(k := value, f := freq, r := rank) ORDER BY rank) FILTER (dim = 'type') AS ty,
    list(TRY_CAST(value AS INT) ORDER BY rank) FILTER (dim = 'hour' AND rank <= 3) AS peaks,
    coalesce(max(vals::DOUBLE / total) FILTER (dim = 'recipient'), 0) AS diversity FROM profile_dist GROUP BY account),
t AS (SELECT s.*, p.*, f.peaks, f.diversity, hour(ts) AS hr, coalesce(c.freq, 0) AS cf, r.freq AS rf, g.freq AS gf, coalesce(y.freq, 0) AS yf,
    (SELECT count(*) FROM profile_dist z WHERE z.account = s.sender_account AND z.dim = 'recipient') AS nrec
  FROM sequence_profile s JOIN profile_scalars p ON p.account = s.sender_account JOIN f ON f.account = s.sender_account
  LEFT JOIN profile_dist c ON c.account = s.sender_account AND c.dim = 'channel' AND c.value = s.channel
  LEFT JOIN profile_dist r ON r.account = s.sender_account AND r.dim = 'recipient' AND r.rank <= 10 AND r.value = s.receiver_account
  LEFT JOIN profile_dist g ON g.account = s.sender_account AND g.dim = 'country' AND g.rank <= 10 AND g.value = s.destination_country
  LEFT JOIN profile_dist y ON y.account = s.sender_account AND y.dim = 'type' AND y.value = s.transaction_type),
d AS (SELECT id, n, CASE WHEN std_amount = 0 THEN 0 WHEN amt > p95 THEN greatest(least(100, z * 33.33::DOUBLE), 70) WHEN amt > p90 THEN greatest(least(100, z * 33.33::DOUBLE), 50)
    ELSE least(100, z * 33.33::DOUBLE) END AS amount_anomaly,
  CASE WHEN NOT list_contains(peaks, hr) THEN 30.0 ELSE 0.0 END::DOUBLE AS frequency_anomaly,
  CASE WHEN list_contains(peaks, hr) THEN 0.0 WHEN dist > 6 THEN 60.0 WHEN dist > 3 THEN 30.0 ELSE 0.0 END::DOUBLE AS timing_anomaly,
  CASE WHEN cf > 0.3 THEN 0.0 WHEN cf > 0.1 THEN 20.0 WHEN cf > 0 THEN 50.0 ELSE 70.0 END::DOUBLE AS channel_anomaly,
  CASE WHEN nrec = 0 THEN 0.0 WHEN rf > 0.3 THEN 0.0 WHEN rf > 0.1 THEN 20.0 WHEN rf IS NOT NULL THEN 40.0 WHEN diversity > 0.5 THEN 30.0 ELSE 60.0 END::DOUBLE AS recipient_anomaly,
  CASE WHEN gf > 0.5 THEN 0.0 WHEN gf > 0.1 THEN 20.0 WHEN gf IS NOT NULL THEN 40.0 WHEN international_ratio > 0.3 THEN 30.0 ELSE 70.0 END::DOUBLE AS geographic_anomaly,
  least(100, (amount BETWEEN 8500 AND 9999)::INT * 40 + (amount BETWEEN 4500 AND 4900)::INT * 35 + (amount BETWEEN 2500 AND 2900 AND transaction_type = 'deposit')::INT * 30
    + (rapid_n >= 2)::INT * 45 + (sr_n >= 2)::INT * 35 + (transaction_type = 'transfer' AND amount >= 5000)::INT * 25 + (yf < 0.1)::INT * 30)::DOUBLE AS pattern_anomaly
  FROM (SELECT *, abs(amt - avg_amount) / nullif(std_amount, 0) AS z, list_min([abs(hr - p) FOR p IN peaks]) AS dist FROM t))
SELECT *, round(amount_anomaly * 0.25::DOUBLE + frequency_anomaly * 0.15::DOUBLE + timing_anomaly * 0.1::DOUBLE + channel_anomaly * 0.1::DOUBLE
  + recipient_anomaly * 0.2::DOUBLE + geographic_anomaly * 0.1::DOUBLE + pattern_anomaly * 0.1::DOUBLE, 9) AS score FROM d""",
       "sequence_profile", "profile_scalars", "profile_dist")

LEVEL = "CASE WHEN {0} >= 80 THEN 'critical' WHEN {0} >= 60 THEN 'high' WHEN {0} >= 40 THEN 'medium' WHEN {0} >= 25 THEN 'low' ELSE 'normal' END"


def sequenced(spark, d):
    tx = base(spark, d)
    return features.sequence_profile(tx, find_hot_keys(tx, "sender_account"))


@query("anomaly_scores", f"""
SELECT id, {", ".join(f"round({x}_anomaly, 6) AS {x}_anomaly" for x in anomaly.DIMENSIONS)}, round(score, 6) AS anomaly_score,
  {LEVEL.format('score')} AS anomaly_level, round(least(1, n / 50.0::DOUBLE) * 0.7 + score / 100 * 0.3, 6) AS anomaly_confidence
FROM anomaly_scores""", "anomaly_scores")
def anomaly_scores(spark, d):
    out = anomaly.score_anomaly(sequenced(spark, d), built(spark, d))
    return out.select("id", *_round(*[f"{x}_anomaly" for x in anomaly.DIMENSIONS], "anomaly_score"), "anomaly_level",
                      F.round("anomaly_confidence", 6).alias("anomaly_confidence"))


define("behavioral_risk", f"""
SELECT t.id, coalesce(floor(score), 0)::BIGINT AS behavioral_score, CASE {LEVEL.format('score')} WHEN 'critical' THEN 'critical' WHEN 'high' THEN 'high_risk'
  WHEN 'medium' THEN 'suspicious' WHEN 'low' THEN 'low' ELSE 'normal' END AS behavioral_level
FROM transactions t LEFT JOIN anomaly_scores a ON a.id = t.id""", "transactions", "anomaly_scores")


@query("behavioral_risk", "SELECT * FROM behavioral_risk", "behavioral_risk")
def behavioral_risk(spark, d):
    out = anomaly.behavioral_risk(sequenced(spark, d), built(spark, d))
    return out.select("id", "behavioral_score", "behavioral_level")


def _dollars(x: str) -> str:
    return f"'$' || format('{{:,.2f}}', CAST({x} AS DOUBLE))"


@query("anomaly_reasons", f"""
WITH c AS (SELECT account, string_agg(value, ', ' ORDER BY rank) AS liked FROM profile_dist WHERE dim = 'channel' AND rank <= 3 GROUP BY 1)
SELECT a.id, concat_ws('; ',
    CASE WHEN amount_anomaly > 50 THEN 'Amount ' || {_dollars("s.amount")} || ' significantly deviates from normal range ('
      || {_dollars("avg_amount")} || ' ± ' || {_dollars("std_amount")} || ')' END,
    CASE WHEN frequency_anomaly > 50 THEN 'Transaction frequency unusual for this customer' END,
    CASE WHEN timing_anomaly > 50 THEN 'Transaction at ' || strftime(s.ts, '%H') || ':00 outside normal activity hours' END,
    CASE WHEN channel_anomaly > 50 THEN 'Unusual channel ''' || s.channel || ''' for this customer' END,
    CASE WHEN recipient_anomaly > 50 THEN 'New or unusual recipient' END,
    CASE WHEN geographic_anomaly > 50 THEN 'Unusual destination country ''' || s.destination_country || '''' END,
    CASE WHEN pattern_anomaly > 50 THEN 'Transaction pattern suggests layering or structuring' END) AS reasons,
  'Customer typically transacts ' || {_dollars("avg_amount")} || ' on average, prefers ' || coalesce(liked, '') || ' channels, and has '
    || p.n || ' historical transactions.' AS behavioral_context
FROM anomaly_scores a JOIN sequence_profile s USING (id) JOIN profile_scalars p ON p.account = s.sender_account LEFT JOIN c ON c.account = s.sender_account""",
       "anomaly_scores", "sequence_profile", "profile_scalars", "profile_dist")
def anomaly_reasons(spark, d):
    out = anomaly.score_anomaly(sequenced(spark, d), built(spark, d))
    return out.select("id", F.array_join("anomaly_reasons", "; ").alias("reasons"), "behavioral_context")
