"""Dashboards, filters, pages, report tables, payloads, schema conformance."""

from pyspark.sql import functions as F

from checks.cases import alerts, ctrs, sars
from checks.registry import query
from checks.risk import scored_by_rules
from moneytrail.operators import ledger, reports, rules
from moneytrail.sources import events, views
from moneytrail.sources.schema import DEFAULTS, TABLES, conform_schema
import checks.cases  # noqa: F401

AS_OF = views.EVENT_AS_OF


def scored(spark, d):
    rows = rules.ctr_required(scored_by_rules(spark, d))
    return rules.sar_required(rows, "risk_level")


_COUNTS = """(SELECT count(*) FROM alert_rows WHERE status = 'open') AS open_alerts, (SELECT count(*) FROM sar_rows WHERE status = 'draft') AS pending_sars,
  (SELECT count(*) FROM ctr_rows WHERE status = 'pending') AS pending_ctrs"""


@query("monitoring_stats", f"""
SELECT (SELECT count(*) FROM rule_scores) AS total_transactions, (SELECT count(*) FROM rule_scores WHERE rule_level <> 'normal') AS suspicious_transactions,
  (SELECT count(*) FROM rule_scores WHERE rule_level IN ('super_suspicious','high_risk','critical') AND ts >= TIMESTAMP '2024-01-02') AS high_risk_today, {_COUNTS}""",
       "rule_scores", "alert_rows", "sar_rows", "ctr_rows")
def monitoring_stats(spark, d):
    return reports.monitoring_stats(scored(spark, d), alerts(spark, d), sars(spark, d), ctrs(spark, d), AS_OF)


@query("system_stats", f"SELECT (SELECT count(*) FROM accounts) AS total_users, (SELECT count(*) FROM transactions) AS total_transactions, {_COUNTS}",
       "accounts", "transactions", "alert_rows", "sar_rows", "ctr_rows")
def system_stats(spark, d):
    return reports.system_stats(views.accounts(spark, d), views.transactions(spark, d), alerts(spark, d),
                                sars(spark, d), ctrs(spark, d))


@query("customer_stats", """
SELECT account AS account_number, count(*) AS total_tx, count(*) FILTER (rule_level <> 'normal') AS flagged,
  (SELECT count(*) FROM alert_rows a WHERE a.account_number = account AND status = 'open') AS open_alerts
FROM ledger JOIN (SELECT id, rule_level FROM rule_scores) USING (id) GROUP BY account""", "ledger", "rule_scores", "alert_rows")
def customer_stats(spark, d):
    return reports.customer_stats(ledger.account_ledger(scored(spark, d)), alerts(spark, d))


@query("risk_summary", "SELECT rule_level AS risk_level, count(*) AS count FROM rule_scores GROUP BY 1", "rule_scores")
def risk_summary(spark, d):
    return reports.risk_summary(scored(spark, d))


@query("monthly_volume", """
SELECT strftime(ts, '%Y-%m') AS month, count(*) AS count, CAST(sum(amount) AS DOUBLE) AS volume FROM order_transactions GROUP BY 1 ORDER BY 1 DESC LIMIT 12""",
       "order_transactions")
def monthly_volume(spark, d):
    return reports.monthly_volume(views.order_transactions(spark, d))


@query("high_risk_accounts", "SELECT account_number, count(*) AS count FROM alert_rows GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "alert_rows")
def high_risk_accounts(spark, d):
    return reports.high_risk_accounts(alerts(spark, d))


@query("batch_summary", """
SELECT count(*) AS total, count(*) FILTER (rule_level = 'normal') AS normal, count(*) FILTER (rule_level <> 'normal') AS flagged,
  count(*) FILTER (rule_level = 'critical') AS critical FROM rule_scores""", "rule_scores")
def batch_summary(spark, d):
    return reports.batch_summary(scored(spark, d))


_FILTERS = {"all": "true", "flagged": "rule_level <> 'normal'",
            "suspicious": "rule_level IN ('suspicious','super_suspicious','high_risk','critical')",
            "ctr": "transaction_type IN ('deposit','withdraw') AND amount >= 10000",
            "sar": "r07 OR rule_level IN ('suspicious','super_suspicious','high_risk','critical')",
            "level:high_risk": "rule_level = 'high_risk'"}
for _kind, _where in _FILTERS.items():
    @query("filter_" + _kind.replace("level:", ""), f"SELECT id, rule_level AS risk_level FROM rule_scores WHERE {_where}", "rule_scores")
    def _filter(spark, d, kind=_kind):
        return reports.filter_transactions(scored(spark, d), kind).select("id", "risk_level")


@query("transactions_page", "SELECT id, CAST(amount AS DOUBLE) AS amount FROM transactions ORDER BY id DESC LIMIT 25 OFFSET 50", "transactions")
def transactions_page(spark, d):
    return reports.page(views.transactions(spark, d), 3).select("id", F.col("amount").cast("double").alias("amount"))


@query("latest_alerts", "SELECT id, risk_level FROM alert_rows ORDER BY ts DESC, id DESC LIMIT 20", "alert_rows")
def latest_alerts(spark, d):
    return reports.report_tables(scored(spark, d), alerts(spark, d), sars(spark, d), ctrs(spark, d))["alerts"].select(
        "id", "risk_level")


@query("latest_sars", "SELECT id, status FROM sar_rows ORDER BY created_at DESC, id DESC LIMIT 20", "sar_rows")
def latest_sars(spark, d):
    return reports.latest(sars(spark, d), "created_at", 20).select("id", "status")


@query("latest_ctrs", "SELECT id, CAST(amount AS DOUBLE) AS amount FROM ctr_rows ORDER BY created_at DESC, id DESC LIMIT 20", "ctr_rows")
def latest_ctrs(spark, d):
    return reports.latest(ctrs(spark, d), "created_at", 20).select("id", F.col("amount").cast("double").alias("amount"))


@query("compliance_view", """
SELECT 'flagged' AS what, (SELECT count(*) FROM rule_scores WHERE rule_level <> 'normal') AS n
UNION ALL SELECT 'open', (SELECT count(*) FROM alert_rows WHERE status = 'open')
UNION ALL SELECT 'page', (SELECT sum(id)::BIGINT FROM (SELECT id FROM rule_scores WHERE rule_level <> 'normal' ORDER BY id DESC LIMIT 25))""",
       "rule_scores", "alert_rows")
def compliance_view(spark, d):
    view = reports.compliance_view(scored(spark, d), alerts(spark, d), views.accounts(spark, d), "flagged")
    return (view["total"].select(F.lit("flagged").alias("what"), F.col("total_count").alias("n"))
            .unionByName(view["open_alerts"].select(F.lit("open").alias("what"), F.col("open_alert_count").alias("n")))
            .unionByName(view["transactions"].agg(F.sum("id").alias("n")).select(F.lit("page").alias("what"), "n")))


@query("customer_view", """
SELECT id, rule_level AS risk_level FROM rule_scores WHERE sender_account = 'ACC7' OR receiver_account = 'ACC7' ORDER BY id DESC LIMIT 25""", "rule_scores")
def customer_view(spark, d):
    tx = scored(spark, d)
    view = reports.customer_view("ACC7", tx, ledger.account_ledger(tx), alerts(spark, d))
    return view["transactions"].select("id", "risk_level")


@query("transaction_payload", """
SELECT id, sender_account, receiver_account, CAST(amount AS DOUBLE) AS amount, transaction_type AS type, transaction_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp,
  rule_level AS risk_level, rule_score::DOUBLE AS risk_score, rule_level, rule_score::DOUBLE AS rule_score, 'unavailable' AS ai_risk_level, 0.0::DOUBLE AS ai_confidence,
  transaction_type IN ('deposit','withdraw') AND amount >= 10000 AS ctr_required, r07 OR rule_level IN ('suspicious','super_suspicious','high_risk','critical') AS sar_required,
  channel, '' AS description FROM rule_scores""", "rule_scores")
def transaction_payload(spark, d):
    rows = scored(spark, d).withColumns({
        "rule_level": F.col("risk_level"), "ai_risk_level": F.lit(None).cast("string"),
        "ai_confidence": F.lit(None).cast("double"), "description": F.lit(None).cast("string"),
        "timestamp": F.date_format("ts", "yyyy-MM-dd HH:mm:ss")})
    return events.transaction_payload(rows)


@query("balance_payload", "SELECT id AS user_id, username, account_number, CAST(balance AS DOUBLE) AS balance, kyc_status FROM accounts", "accounts")
def balance_payload(spark, d):
    return events.balance_payload(views.accounts(spark, d))


@query("event_envelope", """
SELECT 'aml-events' AS topic, CAST(id AS VARCHAR) AS key, '{"event":"balance","data":{"user_id":' || id || coalesce(',"username":' || to_json(username), '')
  || coalesce(',"account_number":' || to_json(account_number), '') || ',"balance":' || CAST(b AS VARCHAR)
  || coalesce(',"kyc_status":' || to_json(kyc_status), '') || '},"publisher":"moneytrail"}' AS value
FROM (SELECT *, CAST(coalesce(balance, 0) AS DOUBLE) AS b FROM accounts)""", "accounts")
def event_envelope(spark, d):
    return events.envelope(events.balance_payload(views.accounts(spark, d)), "balance", F.col("user_id"))


@query("conform_schema", """
SELECT id, currency, channel, destination_country, status, risk_level, ctr_required, generated_label FROM (
  SELECT id, 'USD' AS currency, CASE WHEN id % 3 = 0 THEN 'online' ELSE channel END AS channel, destination_country, 'completed' AS status, 'normal' AS risk_level,
    false AS ctr_required, CAST(NULL AS VARCHAR) AS generated_label FROM transactions)""", "transactions")
def conform(spark, d):
    old = views.transactions(spark, d).withColumn("channel", F.when(F.col("id") % 3 != 0, F.col("channel")))
    rows = conform_schema(old.drop("ts_us", "cents"), TABLES["transactions"], DEFAULTS["transactions"])
    return rows.select("id", "currency", "channel", "destination_country", "status", "risk_level", "ctr_required",
                       "generated_label")
