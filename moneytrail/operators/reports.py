"""Statistics, filters, pages and report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moneytrail.constants import PAGE_SIZE, SAR_LEVELS


def _one_row(parts: list[DataFrame]) -> DataFrame:
    """Combine one-row frames of counters by summing their union: no cross join."""
    names = [c for p in parts for c in p.columns]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return union.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names])


def monitoring_stats(tx: DataFrame, alerts: DataFrame, sars: DataFrame, ctrs: DataFrame, as_of: str) -> DataFrame:
    """Six counters of the live dashboard; "today" is the UTC day of ``as_of``."""
    today = F.lit(as_of[:10]).cast("timestamp")
    grave = F.col("risk_level").isin("super_suspicious", "high_risk", "critical") & (F.col("ts") >= today)
    return _one_row([
        tx.agg(F.count(F.lit(1)).alias("total_transactions"),
               F.count_if(F.col("risk_level") != "normal").alias("suspicious_transactions"),
               F.count_if(grave).alias("high_risk_today")),
        alerts.agg(F.count_if(F.col("status") == "open").alias("open_alerts")),
        sars.agg(F.count_if(F.col("status") == "draft").alias("pending_sars")),
        ctrs.agg(F.count_if(F.col("status") == "pending").alias("pending_ctrs"))])


def system_stats(accounts: DataFrame, tx: DataFrame, alerts: DataFrame, sars: DataFrame,
                 ctrs: DataFrame) -> DataFrame:
    return _one_row([
        accounts.agg(F.count(F.lit(1)).alias("total_users")), tx.agg(F.count(F.lit(1)).alias("total_transactions")),
        alerts.agg(F.count_if(F.col("status") == "open").alias("open_alerts")),
        sars.agg(F.count_if(F.col("status") == "draft").alias("pending_sars")),
        ctrs.agg(F.count_if(F.col("status") == "pending").alias("pending_ctrs"))])


def customer_stats(ledger: DataFrame, alerts: DataFrame) -> DataFrame:
    """Per account: transactions in either direction, flagged ones, open alerts."""
    per = ledger.groupBy(F.col("account").alias("account_number")).agg(
        F.count(F.lit(1)).alias("total_tx"), F.count_if(F.col("risk_level") != "normal").alias("flagged"))
    opened = alerts.where("status = 'open'").groupBy("account_number").agg(F.count(F.lit(1)).alias("open_alerts"))
    return per.join(opened, "account_number", "left").select(
        "account_number", "total_tx", "flagged", F.coalesce("open_alerts", F.lit(0)).alias("open_alerts"))


def risk_summary(tx: DataFrame) -> DataFrame:
    return (tx.groupBy("risk_level").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), "risk_level"))


def monthly_volume(tx: DataFrame, months: int = 12) -> DataFrame:
    """Latest months with their number of transactions and volume."""
    return (tx.groupBy(F.date_format("ts", "yyyy-MM").alias("month"))
            .agg(F.count(F.lit(1)).alias("count"), (F.sum("cents") / 100).alias("volume"))
            .orderBy(F.col("month").desc()).limit(months))


def high_risk_accounts(alerts: DataFrame, n: int = 10) -> DataFrame:
    return (alerts.groupBy("account_number").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), "account_number").limit(n))


def batch_summary(scored: DataFrame) -> DataFrame:
    level = F.col("risk_level")
    return scored.agg(F.count(F.lit(1)).alias("total"), F.count_if(level == "normal").alias("normal"),
                      F.count_if(level != "normal").alias("flagged"),
                      F.count_if(level == "critical").alias("critical"))


def filter_transactions(df: DataFrame, kind: str = "all") -> DataFrame:
    """One of the dashboard's fixed filters; anything else shows all."""
    if kind == "flagged":
        return df.where("risk_level != 'normal'")
    if kind == "suspicious":
        return df.where(F.col("risk_level").isin(SAR_LEVELS))
    if kind in ("ctr", "sar"):
        return df.where(f"{kind}_required")
    if kind.startswith("level:"):
        return df.where(F.col("risk_level") == kind[6:])
    return df


def page(df: DataFrame, n: int, size: int = PAGE_SIZE, by: str = "id") -> DataFrame:
    """Page ``n`` (from 1) in descending order."""
    return df.orderBy(F.col(by).desc()).offset((max(1, n) - 1) * size).limit(size)


def latest(df: DataFrame, by: str, n: int, tie: str = "id") -> DataFrame:
    return df.orderBy(F.col(by).desc(), F.col(tie).desc()).limit(n)


def compliance_view(tx: DataFrame, alerts: DataFrame, accounts: DataFrame, kind: str = "all", page_no: int = 1,
                    alert_page: int = 1) -> dict[str, DataFrame]:
    """Tables of the compliance dashboard."""
    from moneytrail.operators.cases import open_alert_queue
    chosen = filter_transactions(tx, kind)
    return {"transactions": page(chosen, page_no), "total": chosen.agg(F.count(F.lit(1)).alias("total_count")),
            "alerts": open_alert_queue(alerts, accounts, alert_page),
            "open_alerts": alerts.where("status = 'open'").agg(F.count(F.lit(1)).alias("open_alert_count"))}


def report_tables(tx: DataFrame, alerts: DataFrame, sars: DataFrame, ctrs: DataFrame) -> dict[str, DataFrame]:
    """Tables of the reports page."""
    return {"high_risk_accounts": high_risk_accounts(alerts), "risk_summary": risk_summary(tx),
            "alerts": latest(alerts, "ts", 20), "sar_reports": latest(sars, "created_at", 20),
            "ctr_reports": latest(ctrs, "created_at", 20), "monthly_volume": monthly_volume(tx)}


def customer_view(account: str, tx: DataFrame, ledger: DataFrame, alerts: DataFrame,
                  page_no: int = 1) -> dict[str, DataFrame]:
    """Tables of one customer's dashboard: filters reach the scan before anything is sorted."""
    own = tx.where((F.col("sender_account") == account) | (F.col("receiver_account") == account))
    mine = alerts.where(F.col("account_number") == account)
    return {"transactions": page(own, page_no), "alerts": latest(mine, "ts", 10),
            "stats": customer_stats(ledger.where(F.col("account") == account), mine)}
