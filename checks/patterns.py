"""Laundering-pattern detectors."""

from pyspark.sql import functions as F

from checks.features import AS_OF_US
from checks.registry import define, query
from checks.rules import BY_SENDER, H1, H24, PAST
from moneytrail.operators import patterns
from moneytrail.plans.hot import find_hot_accounts, find_hot_keys
from moneytrail.sources import views
import checks.ledgers  # noqa: F401

ORDER_AS_OF_US = 996710400000000  # 2001-08-02 00:00:00
ORDER = ["structuring", "layering", "funnel_account", "self_transfer", "circular_transfer", "money_mule",
         "rapid_movement", "round_tripping", "self_laundering", "dormant_activation", "transaction_burst",
         "shell_company_behavior"]


def _flags(table: str, ledger_name: str, as_of_us: int) -> str:
    seen = f"""
SELECT id, account, direction, count(*) FILTER (direction = 'in') OVER w AS in_n, count(*) FILTER (direction = 'out') OVER w AS out_n,
  count(*) FILTER (direction = 'self') OVER w AS self_n,
  coalesce(sum(amount) FILTER (direction <> 'out') OVER w, 0) AS ins, coalesce(sum(amount) FILTER (direction <> 'in') OVER w, 0) AS outs,
  count(DISTINCT CASE WHEN direction <> 'out' THEN counterparty END) OVER w AS senders,
  count(DISTINCT CASE WHEN direction <> 'in' THEN counterparty END) OVER w AS receivers,
  max(epoch_us(ts)) OVER w AS last_us
FROM {ledger_name} WINDOW w AS (PARTITION BY account ORDER BY ts {PAST})"""
    return f"""
WITH seen AS ({seen}),
rev AS (SELECT a.id, count(*) AS n, bool_or(abs(b.amount - a.amount) * 10 < greatest(a.amount, 1)) AS near
  FROM {table} a JOIN {table} b ON b.sender_account = a.receiver_account AND b.receiver_account = a.sender_account
  AND b.ts < a.ts WHERE a.sender_account <> a.receiver_account GROUP BY 1),
h AS (SELECT *, (amount * 100)::HUGEINT AS c, count(*) FILTER (amount BETWEEN 8000 AND 9999) OVER ({BY_SENDER} {PAST}) AS band,
  count(*) FILTER (transaction_type = 'transfer') OVER ({BY_SENDER} {H1}) AS t1,
  count(DISTINCT CASE WHEN transaction_type = 'transfer' THEN receiver_account END) OVER ({BY_SENDER} {H1}) AS r1,
  count(*) FILTER (amount >= 25000) OVER ({BY_SENDER} {H24}) AS big, count(*) OVER ({BY_SENDER} {H1}) AS n1,
  count(*) OVER ({BY_SENDER} {H24}) AS n24, count(*) OVER ({BY_SENDER} {PAST}) AS n0,
  coalesce(sum((amount * 100)::HUGEINT) OVER ({BY_SENDER} {PAST}), 0) AS s1,
  coalesce(sum((amount * 100)::HUGEINT * (amount * 100)::HUGEINT) OVER ({BY_SENDER} {PAST}), 0) AS s2 FROM {table}),
j AS (SELECT h.*, (s1 + c)::DOUBLE / (n0 + 1) AS mean, (s2 + c * c)::DOUBLE / (n0 + 1) AS sq, rev.n AS rn, rev.near,
  s.last_us, s.in_n + s.self_n AS s_in, s.out_n + s.self_n AS s_out, s.ins, s.outs, r.senders, r.receivers,
  a1.id // 2 AS c1, a2.id // 2 AS c2, ({as_of_us} - epoch_us(a1.created_at)) // 86400000000 AS age
  FROM h LEFT JOIN rev USING (id) JOIN seen s ON s.id = h.id AND s.direction <> 'in' JOIN seen r ON r.id = h.id AND r.direction <> 'out'
  LEFT JOIN accounts a1 ON a1.account_number = h.sender_account LEFT JOIN accounts a2 ON a2.account_number = h.receiver_account)
SELECT id, amount BETWEEN 8000 AND 9999 AND band >= 2 AS structuring, transaction_type = 'transfer' AND t1 >= 3 AND r1 >= 2 AS layering,
  senders >= 5 AND receivers <= 2 AS funnel_account, sender_account = receiver_account AS self_transfer,
  coalesce(rn, 0) > 0 AS circular_transfer, s_in >= 3 AND s_out >= 3 AND outs * 10 >= ins * 8 AS money_mule,
  amount >= 50000 AND big >= 2 AS rapid_movement, coalesce(near, false) AS round_tripping,
  coalesce(c1 = c2, false) AND last_us IS NOT NULL AS self_laundering,
  CASE WHEN last_us IS NOT NULL THEN (epoch_us(ts) - last_us) // 86400000000 > 90 ELSE coalesce(age > 90, false) END AS dormant_activation,
  n1 >= 10 OR n24 >= 10 AS transaction_burst, n1 >= 10 AS hourly_burst,
  n0 >= 4 AND mean / 100 > 10000 AND sqrt(greatest(sq - mean * mean, 0)) / mean < 0.2 AS shell_company_behavior FROM j"""


define("pattern_flags", _flags("transactions", "ledger", AS_OF_US), "transactions", "ledger", "accounts")
define("order_pattern_flags", _flags("order_transactions", "order_ledger", ORDER_AS_OF_US), "order_transactions",
       "order_ledger", "accounts")

HIGH = ["structuring", "layering", "funnel_account", "circular_transfer", "money_mule", "rapid_movement",
        "round_tripping"]
MEDIUM = ["self_transfer", "self_laundering", "dormant_activation", "shell_company_behavior"]
_high = " + ".join([f"{p}::BIGINT" for p in HIGH] + ["hourly_burst::BIGINT"])
_medium = " + ".join([f"{p}::BIGINT" for p in MEDIUM] + ["(transaction_burst AND NOT hourly_burst)::BIGINT"])
define("pattern_scores", f"""
SELECT id, least(100, high * 25 + medium * 15 + CASE WHEN high >= 3 THEN 20 WHEN high >= 2 THEN 10 ELSE 0 END)::BIGINT AS pattern_score,
  (high + medium)::BIGINT AS pattern_count, high AS high_count, types FROM (SELECT id, {_high} AS high, {_medium} AS medium,
  concat_ws(',', {', '.join(f"CASE WHEN {p} THEN '{p}' END" for p in ORDER)}) AS types FROM pattern_flags)""",
       "pattern_flags")


def detected(spark, d, view=views.transactions, as_of_us=AS_OF_US):
    tx = view(spark, d)
    accounts = views.accounts(spark, d).withColumn("customer_id", F.expr("id div 2"))
    return patterns.detect_patterns(tx, accounts, as_of_us, find_hot_keys(tx, "sender_account"),
                                    find_hot_accounts(tx))


@query("pattern_scores", "SELECT id, pattern_score, pattern_count, high_count::BIGINT AS high_count, types FROM "
       "pattern_scores", "pattern_scores")
def pattern_scores(spark, d):
    return detected(spark, d).select(
        "id", "pattern_score", "pattern_count", F.size("high_risk_patterns").cast("long").alias("high_count"),
        F.array_join(F.transform("patterns", lambda p: p["type"]), ",").alias("types"))


def flagged(spark, d, kind, view, as_of_us):
    tx = view(spark, d)
    accounts = views.accounts(spark, d).withColumn("customer_id", F.expr("id div 2"))
    rows = patterns.pattern_history(tx, find_hot_keys(tx, "sender_account"),
                                    find_hot_accounts(tx))
    rows = patterns.with_owners(rows, accounts, as_of_us)
    return rows.where(F.coalesce(patterns.pattern_flags()[kind], F.lit(False))).select("id")


for _kind in ORDER:
    # dormancy and shell companies need a long horizon: the order view
    _long = _kind in ("dormant_activation", "shell_company_behavior")

    @query(f"pattern_{_kind}", f"SELECT id FROM {'order_' if _long else ''}pattern_flags WHERE {_kind}",
           f"{'order_' if _long else ''}pattern_flags")
    def _one(spark, d, kind=_kind, long=_long):
        return flagged(spark, d, kind, views.order_transactions if long else views.transactions,
                       ORDER_AS_OF_US if long else AS_OF_US)


@query("pattern_explanations", """
SELECT type, CASE type WHEN 'self_transfer' THEN 'Suspicious pattern detected: self_transfer' ELSE 'known' END AS text, count(*) AS n
FROM (SELECT unnest(string_split(types, ',')) AS type FROM pattern_scores WHERE types <> '') GROUP BY 1, 2""",
       "pattern_scores")
def pattern_explanations(spark, d):
    rows = detected(spark, d).select(F.explode("patterns").alias("p")).select(F.col("p.type").alias("type"))
    text = patterns.explain_pattern(F.col("type"))
    return (rows.select("type", F.when(text.startswith("Suspicious pattern detected"), text).otherwise("known")
                        .alias("text")).groupBy("type", "text").agg(F.count(F.lit(1)).alias("n")))
