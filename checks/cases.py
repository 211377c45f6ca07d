"""Alert lifecycle, ratings, reports, admission, onboarding and sign-in checks."""

from pyspark.sql import functions as F

from checks.registry import define, query
from checks.risk import scored_by_rules
from moneytrail.functions import scalars
from moneytrail.operators import cases, risk, windows
from moneytrail.plans.hot import find_hot_keys
from moneytrail.sources import views
import checks.risk  # noqa: F401

define("alert_rows", """
SELECT id, id AS transaction_id, sender_account AS account_number, rule_score AS risk_score, rule_level AS risk_level, ts,
  CASE WHEN id % 4 = 0 THEN 'resolved' WHEN id % 4 = 1 THEN 'escalated' ELSE 'open' END AS status
FROM rule_scores WHERE rule_level IN ('suspicious','high_risk','critical')""", "rule_scores")
define("sar_rows", """
SELECT id, id AS alert_id, account_number, ts AS created_at, CASE WHEN id % 3 = 0 THEN 'draft' ELSE 'submitted' END AS status
FROM alert_rows WHERE risk_level = 'critical'""", "alert_rows")
define("ctr_rows", """
SELECT id, id AS transaction_id, sender_account AS account_number, amount, ts AS created_at, CASE WHEN id % 2 = 0 THEN 'pending' ELSE 'filed' END AS status
FROM transactions WHERE transaction_type IN ('deposit','withdraw') AND amount >= 10000""", "transactions")


def alerts(spark, d):
    """Alerts of the rule engine with a status that varies by id."""
    rows = risk.generate_alerts(scored_by_rules(spark, d)).withColumn("id", F.col("transaction_id"))
    status = F.when(F.col("id") % 4 == 0, "resolved").when(F.col("id") % 4 == 1, "escalated").otherwise("open")
    return rows.withColumn("status", status)


def sars(spark, d):
    rows = alerts(spark, d).where("risk_level = 'critical'")
    return rows.select("id", F.col("id").alias("alert_id"), "account_number", F.col("ts").alias("created_at"),
                       F.unix_micros("ts").alias("ts_us"),
                       F.when(F.col("id") % 3 == 0, "draft").otherwise("submitted").alias("status"))


def ctrs(spark, d):
    rows = risk.generate_ctrs(views.transactions(spark, d)).withColumn("id", F.col("transaction_id"))
    return rows.withColumn("status", F.when(F.col("id") % 2 == 0, "pending").otherwise("filed"))


@query("alert_state", """
WITH a AS (SELECT DISTINCT alert_id FROM case_actions),
l AS (SELECT alert_id, arg_max(action, (ts_us, id)) AS action, max(ts_us) AS last_us, count(*) AS n FROM case_actions WHERE action <> 'note' GROUP BY 1)
SELECT a.alert_id AS id, CASE action WHEN 'resolve' THEN 'resolved' WHEN 'escalate' THEN 'escalated' WHEN 'file_sar' THEN 'sar_filed' ELSE 'open' END AS status,
  coalesce(n, 0) AS action_count, last_us AS last_action_us FROM a LEFT JOIN l USING (alert_id)""", "case_actions")
def alert_state(spark, d):
    actions = views.case_actions(spark, d)
    base = actions.select(F.col("alert_id").alias("id")).distinct().withColumn("status", F.lit("open"))
    return cases.alert_state(base, actions).select("id", "status", "action_count", "last_action_us")


@query("risk_rating_fold", """
WITH RECURSIVE s AS (SELECT account_number, step, row_number() OVER (PARTITION BY account_number ORDER BY ts_us, id) AS n FROM (
  SELECT *, CASE action WHEN 'resolve' THEN -1 WHEN 'escalate' THEN 1 WHEN 'file_sar' THEN 2 END AS step FROM case_actions WHERE action <> 'note')),
f AS (SELECT account_number, 0::BIGINT AS n, CASE risk_rating WHEN 'standard' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 3 END AS r FROM accounts
  UNION ALL SELECT f.account_number, s.n, least(3, greatest(0, f.r + s.step)) FROM f JOIN s ON s.account_number = f.account_number AND s.n = f.n + 1)
SELECT a.account_number, a.risk_rating AS rating_before, (['standard','medium','high','critical'])[arg_max(f.r, f.n) + 1] AS rating_after
FROM f JOIN accounts a USING (account_number) GROUP BY 1, 2""", "accounts", "case_actions")
def risk_rating_fold(spark, d):
    return cases.risk_rating_after(views.accounts(spark, d), views.case_actions(spark, d))


@query("next_risk_rating", """
SELECT id, (['standard','medium','high','critical'])[least(4, greatest(1, r + step))] AS next FROM (
  SELECT c.id, CASE a.risk_rating WHEN 'standard' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS r,
    CASE action WHEN 'resolve' THEN -1 WHEN 'escalate' THEN 1 WHEN 'file_sar' THEN 2 ELSE 0 END AS step
  FROM case_actions c JOIN accounts a USING (account_number))""", "case_actions", "accounts")
def next_risk_rating(spark, d):
    rows = views.case_actions(spark, d).join(views.accounts(spark, d).select("account_number", "risk_rating"),
                                             "account_number")
    return rows.select("id", scalars.next_risk_rating(F.col("risk_rating"), F.col("action")).alias("next"))


@query("sar_state", """
SELECT s.id, CASE WHEN f.u IS NOT NULL THEN 'submitted' ELSE 'draft' END AS status, f.u AS filed_us FROM case_actions s
LEFT JOIN (SELECT id + 1 AS id, max(ts_us) AS u FROM case_actions WHERE action = 'resolve' GROUP BY 1) f ON f.id = s.id
WHERE s.action = 'file_sar'""", "case_actions")
def sar_state(spark, d):
    actions = views.case_actions(spark, d)
    submits = actions.where("action = 'resolve'").select((F.col("id") + 1).alias("sar_id"), "ts_us",
                                                         F.lit("submit").alias("action"))
    return cases.sar_state(cases.sars_from_actions(actions), submits).select("id", "status", "filed_us")


@query("alert_case", """
SELECT a.id, a.risk_level, CAST(t.amount AS DOUBLE) AS amount, t.transaction_type, c.username, c.risk_rating,
  (SELECT count(*) FROM sar_rows s WHERE s.alert_id = a.id) AS sar_count
FROM alert_rows a JOIN transactions t ON t.id = a.transaction_id LEFT JOIN accounts c USING (account_number)""",
       "alert_rows", "transactions", "accounts", "sar_rows")
def alert_case(spark, d):
    rows = cases.alert_case(alerts(spark, d), views.transactions(spark, d), views.accounts(spark, d), sars(spark, d))
    return rows.select("id", "risk_level", F.col("amount").cast("double").alias("amount"), "transaction_type",
                       "username", "risk_rating", "sar_count")


@query("decoded_rules", """
SELECT h.id, h.rule_id, h.score_delta::BIGINT AS score_delta FROM rule_hit_rows h JOIN alert_rows a USING (id)""",
       "rule_hit_rows", "alert_rows")
def decoded_rules(spark, d):
    return cases.decoded_rules(alerts(spark, d)).select("id", "rule_id", "score_delta")


@query("alert_queue_page", """
SELECT id, username, epoch_us(ts) AS ts_us FROM (SELECT * FROM alert_rows WHERE status = 'open' ORDER BY ts DESC, id DESC LIMIT 25 OFFSET 25)
LEFT JOIN accounts c USING (account_number)""".replace("SELECT id, username", "SELECT q.id, username").replace(
    "OFFSET 25)\n", "OFFSET 25) q\n"), "alert_rows", "accounts")
def alert_queue_page(spark, d):
    rows = cases.open_alert_queue(alerts(spark, d), views.accounts(spark, d), 2)
    return rows.select("id", "username", F.unix_micros("ts").alias("ts_us"))


@query("next_open_alert", """
WITH top AS (SELECT id, row_number() OVER (ORDER BY ts DESC, id DESC) AS rn FROM alert_rows WHERE status = 'open')
SELECT a.id, (SELECT t.id FROM top t WHERE t.rn <= 2 AND t.id <> a.id ORDER BY t.rn LIMIT 1) AS next_alert_id FROM alert_rows a""",
       "alert_rows")
def next_open_alert(spark, d):
    return windows.next_open_alert(alerts(spark, d)).select("id", "next_alert_id")


@query("admission_check", """
SELECT id, reason IS NULL AS admitted, reason AS rejection FROM (SELECT q.id, CASE WHEN q.kind NOT IN ('deposit','withdraw','transfer') THEN 'Invalid transaction type.'
  WHEN q.amount <= 0 THEN 'Amount must be greater than zero.' WHEN q.kind IN ('withdraw','transfer') AND coalesce(s.balance, 0) < q.amount THEN 'Insufficient funds.'
  WHEN q.kind = 'transfer' AND (r.id IS NULL OR r.id = s.id) THEN 'Recipient customer account not found.' END AS reason
FROM (SELECT *, CASE WHEN id % 11 = 0 THEN 'barter' ELSE transaction_type END AS kind FROM transactions) q
LEFT JOIN accounts s ON s.account_number = q.sender_account LEFT JOIN accounts r ON r.account_number = q.receiver_account)""",
       "transactions", "accounts")
def admission_check(spark, d):
    kind = F.when(F.col("id") % 11 == 0, "barter").otherwise(F.col("transaction_type"))
    requests = views.transactions(spark, d).withColumn("transaction_type", kind)
    return cases.admission_check(requests, views.accounts(spark, d))


@query("applicant_check", """
WITH p AS (SELECT id AS applicant_id, CASE WHEN id % 10 = 0 THEN 'Admin' WHEN id % 3 = 0 THEN 'new ' || id ELSE username END AS username,
  CASE WHEN id % 7 = 0 THEN '' ELSE 'u' || (id % 500) || '@bank.example' END AS email, CASE WHEN id % 5 = 0 THEN 'oops' WHEN id % 2 = 0 THEN id_number ELSE '99-' || lpad(CAST(id AS VARCHAR), 7, '0') || 'Z00' END AS id_number FROM accounts)
SELECT applicant_id, reason IS NULL AS accepted, reason AS rejection FROM (SELECT *, CASE WHEN email = '' THEN 'All fields are required.'
  WHEN lower(username) = 'admin' THEN 'That username is reserved for bank staff.' WHEN id_number = 'oops' THEN 'ID number must use the format 00-000000A00, for example 08-995728P34.'
  WHEN username IN (SELECT username FROM accounts) THEN 'Username already taken.' WHEN email IN (SELECT 'u' || id || '@bank.example' FROM accounts WHERE id % 2 = 0) THEN 'Email already registered.'
  WHEN id_number IN (SELECT id_number FROM accounts) THEN 'ID number already registered.' END AS reason FROM p)""", "accounts")
def applicant_check(spark, d):
    accounts = views.accounts(spark, d)
    i = F.col("id")
    people = accounts.select(
        i.alias("applicant_id"), F.when(i % 10 == 0, "Admin").when(i % 3 == 0, F.concat(F.lit("new "), i.cast("string")))
        .otherwise(F.col("username")).alias("username"),
        F.when(i % 7 == 0, "").otherwise(F.concat(F.lit("u"), (i % 500).cast("string"), F.lit("@bank.example")))
        .alias("email"),
        F.when(i % 5 == 0, "oops").when(i % 2 == 0, F.col("id_number")).otherwise(
            F.concat(F.lit("99-"), F.lpad(i.cast("string"), 7, "0"), F.lit("Z00"))).alias("id_number"))
    known = accounts.withColumn("email", F.when(i % 2 == 0, F.concat(F.lit("u"), i.cast("string"),
                                                                     F.lit("@bank.example"))))
    return cases.applicant_check(people, known)


@query("login_lockout", """
WITH e AS (SELECT *, count(*) FILTER (success) OVER (PARTITION BY identifier ORDER BY ts_us, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS era FROM auth_events)
SELECT * FROM (SELECT id, identifier, ts_us, count(*) OVER (PARTITION BY identifier, era ORDER BY ts_us RANGE BETWEEN 299999999 PRECEDING AND 1 PRECEDING) + 1 AS failures, ts_us + 900000000 AS locked_until_us
FROM e WHERE NOT success) WHERE failures >= 5""", "auth_events")
def login_lockout(spark, d):
    attempts = views.auth_events(spark, d)
    return cases.login_lockouts(attempts, hot=find_hot_keys(attempts, "identifier"))


@query("activity_feed", """
SELECT id, actor, action FROM (SELECT id, account_number AS actor, action, ts_us FROM case_actions ORDER BY ts_us DESC, id DESC LIMIT 25)""", "case_actions")
def activity_feed(spark, d):
    return cases.activity_feed(log(spark, d), 25).select("id", "actor", "action")


@query("activity_counts", "SELECT account_number AS actor, action, count(*) AS n FROM case_actions GROUP BY 1, 2", "case_actions")
def activity_counts(spark, d):
    return cases.activity_counts(log(spark, d)).select("actor", "action", "n")


def log(spark, d):
    return views.case_actions(spark, d).select("id", F.col("account_number").alias("actor"), "action",
                                               F.col("ts_us").alias("ts"))
