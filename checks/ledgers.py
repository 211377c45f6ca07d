"""Account ledger, balances, partners, reverse transfers."""

from pyspark.sql import functions as F

from checks.registry import define, query
from moneytrail.operators import ledger, windows
from moneytrail.plans.hot import find_hot_accounts
from moneytrail.sources import views

LEDGER = """
SELECT id, ts, amount, transaction_type, sender_account, receiver_account, channel, destination_country,
  sender_account AS account, CASE WHEN sender_account = receiver_account THEN 'self' ELSE 'out' END AS direction,
  receiver_account AS counterparty,
  CASE WHEN transaction_type = 'deposit' THEN amount WHEN transaction_type = 'transfer'
    AND sender_account = receiver_account THEN 0 ELSE -amount END AS signed
FROM {0}
UNION ALL
SELECT id, ts, amount, transaction_type, sender_account, receiver_account, channel, destination_country,
  receiver_account, 'in', sender_account, CASE WHEN transaction_type = 'transfer' THEN amount ELSE 0 END
FROM {0} WHERE sender_account <> receiver_account"""
define("ledger", LEDGER.format("transactions"), "transactions")
define("order_ledger", LEDGER.format("order_transactions"), "order_transactions")


@query("account_ledger", "SELECT id, account, direction, counterparty, CAST(signed AS DOUBLE) AS signed_amount "
       "FROM ledger", "ledger")
def account_ledger(spark, d):
    return ledger.account_ledger(views.transactions(spark, d)).select(
        "id", "account", "direction", "counterparty", (F.col("signed_cents") / 100).alias("signed_amount"))


@query("balances", """
SELECT account_number, CAST(balance AS DOUBLE) AS opening, coalesce(CAST(net AS DOUBLE), 0) AS net,
  CAST(balance + coalesce(net, 0) AS DOUBLE) AS balance
FROM accounts LEFT JOIN (SELECT account, sum(signed) AS net FROM ledger GROUP BY 1) ON account = account_number""",
       "accounts", "ledger")
def balances(spark, d):
    rows = ledger.balances(views.accounts(spark, d), ledger.account_ledger(views.transactions(spark, d)))
    return rows.select("account_number", (F.col("opening_cents") / 100).alias("opening"),
                       (F.col("net_cents") / 100).alias("net"), (F.col("balance_cents") / 100).alias("balance"))


RUN = "PARTITION BY account ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


@query("running_balance", f"SELECT id, account, CAST(sum(signed) OVER ({RUN}) AS DOUBLE) AS balance FROM ledger",
       "ledger")
def running_balance(spark, d):
    tx = views.transactions(spark, d)
    out = windows.running_balance(ledger.account_ledger(tx), hot=find_hot_accounts(tx))
    return out.select("id", "account", (F.col("balance_cents") / 100).alias("balance"))


@query("floored_balance", f"""
SELECT id, account, CAST(s - least(0, min(s) OVER ({RUN})) AS DOUBLE) AS balance
FROM (SELECT *, sum(signed) OVER ({RUN}) AS s FROM ledger)""", "ledger")
def floored_balance(spark, d):
    tx = views.transactions(spark, d)
    out = windows.running_balance(ledger.account_ledger(tx), floor=True, hot=find_hot_accounts(tx))
    return out.select("id", "account", (F.col("balance_cents") / 100).alias("balance"))


@query("days_since_previous", """
SELECT id, account, CAST((epoch_us(ts) - max(epoch_us(ts)) OVER (PARTITION BY account ORDER BY ts
  RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)) // 86400000000 AS BIGINT) AS idle_days
FROM order_ledger""", "order_ledger")
def days_since_previous(spark, d):
    tx = views.order_transactions(spark, d)
    return windows.days_since_previous(ledger.account_ledger(tx), find_hot_accounts(tx)).select("id", "account", "idle_days")


@query("fan_in_out", """
SELECT coalesce(s.account, r.account) AS account, coalesce(fan_out, 0) AS fan_out, coalesce(fan_in, 0) AS fan_in
FROM (SELECT sender_account AS account, count(DISTINCT receiver_account) AS fan_out FROM transactions GROUP BY 1) s
FULL JOIN (SELECT receiver_account AS account, count(DISTINCT sender_account) AS fan_in FROM transactions GROUP BY 1) r
ON s.account = r.account""", "transactions")
def fan_in_out(spark, d):
    return ledger.fan_in_out(views.transactions(spark, d))


@query("reverse_transfers", """
SELECT id, (SELECT count(*) FROM transactions b WHERE b.sender_account = a.receiver_account
    AND b.receiver_account = a.sender_account AND b.ts < a.ts AND a.sender_account <> a.receiver_account) AS reverse_count,
  (SELECT epoch_us(min(b.ts)) FROM transactions b WHERE b.sender_account = a.receiver_account
    AND b.receiver_account = a.sender_account AND b.ts < a.ts AND a.sender_account <> a.receiver_account) AS reverse_first_us
FROM transactions a""", "transactions")
def reverse_transfers(spark, d):
    tx = views.transactions(spark, d)
    hot = find_hot_accounts(tx)
    return ledger.reverse_transfers(tx, hot).select("id", "reverse_count", "reverse_first_us")


@query("round_trips", """
SELECT DISTINCT a.id FROM transactions a JOIN transactions b ON b.sender_account = a.receiver_account
  AND b.receiver_account = a.sender_account AND b.ts < a.ts
WHERE a.sender_account <> a.receiver_account AND abs(b.amount - a.amount) * 10 < greatest(a.amount, 1)""",
       "transactions")
def round_trips(spark, d):
    return ledger.similar_reverse(views.transactions(spark, d)).select("id")


@query("transaction_pairs", """
SELECT sender_account, receiver_account, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS volume,
  epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM transactions GROUP BY 1, 2""", "transactions")
def transaction_pairs(spark, d):
    return ledger.transaction_pairs(views.transactions(spark, d)).select(
        "sender_account", "receiver_account", "n", (F.col("cents") / 100).alias("volume"), "first_us", "last_us")


@query("latest_per_account", """
SELECT account, id, ts_us, recency FROM (
  SELECT account, id, epoch_us(ts) AS ts_us, row_number() OVER (PARTITION BY account ORDER BY ts DESC, id DESC) AS recency
  FROM ledger) WHERE recency <= 50""", "ledger")
def latest_rows(spark, d):
    rows = windows.latest_per_account(ledger.account_ledger(views.transactions(spark, d)), 50)
    return rows.select("account", "id", "ts_us", F.col("recency").cast("long").alias("recency"))
