"""Case management as append-only actions and derived state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moneytrail.constants import (ACTION_STATUS, DAY_US, MINUTE_US, RATING_LADDER, RATING_STEP, REQUEST_TYPES,
                                  RESERVED_USERNAMES, SECOND_US)
from moneytrail.functions.scalars import is_valid_national_id, lookup, normalize_national_id
from moneytrail.operators.windows import SENDER
from moneytrail.plans.hot import NO_HOT_KEYS, HotKeys
from moneytrail.plans.scan import Measure, prior, running
from moneytrail.sources.schema import RULE_HIT


def alert_state(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Current status of every alert: the latest status-changing action decides.

    ``actions`` has ``id``, ``ts_us``, ``alert_id``, ``action``.
    """
    moved = actions.where(F.col("action").isin(list(ACTION_STATUS)))
    latest = moved.groupBy("alert_id").agg(
        F.max(F.struct("ts_us", "id", "action")).alias("last"), F.count(F.lit(1)).alias("action_count"))
    rows = alerts.join(latest.withColumnRenamed("alert_id", "id"), "id", "left")
    return rows.select(*[c for c in alerts.columns if c != "status"],
                       lookup(F.col("last.action"), ACTION_STATUS, "open").alias("status"),
                       F.coalesce("action_count", F.lit(0)).alias("action_count"),
                       F.col("last.ts_us").alias("last_action_us"))


def _after(positions: Column, step: Column) -> Column:
    """Move every possible starting rung by ``step``, clamped."""
    return F.transform(positions, lambda p: F.least(F.greatest(p + step, F.lit(0)), F.lit(len(RATING_LADDER) - 1)))


def risk_rating_after(accounts: DataFrame, actions: DataFrame) -> DataFrame:
    """Risk rating of each account after its actions in order, clamped to the ladder after every step.

    Clamping makes the order matter, yet a run of steps is just a map from starting rung to end rung.  So the steps
    of a minute are folded into such a map, minutes into days, and days into one map per account: no group ever holds
    more than a minute of actions, a day of minutes, or one map per day.  ``actions`` has ``id``, ``ts_us``,
    ``account_number``, ``action``.
    """
    start = F.array(*[F.lit(i) for i in range(len(RATING_LADDER))])
    steps = actions.select("account_number", "id", "ts_us", F.floor(F.col("ts_us") / MINUTE_US).alias("at"),
                           lookup(F.col("action"), RATING_STEP, 0).alias("step")).where("step <> 0")
    maps = steps.groupBy("account_number", "at").agg(
        F.sort_array(F.collect_list(F.struct("ts_us", "id", "step"))).alias("s"))
    maps = maps.select("account_number", F.floor(F.col("at") / (DAY_US // MINUTE_US)).alias("day"), "at",
                       F.aggregate("s", start, lambda m, x: _after(m, x["step"])).alias("map"))

    def compose(df: DataFrame, groups: list[str], order: str) -> DataFrame:
        parts = df.groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), "map")))
                                        .alias("parts"))
        return parts.select(*groups, F.aggregate("parts", start, lambda m, d: F.transform(
            m, lambda p: F.element_at(d["map"], p + 1))).alias("map"))

    total = compose(compose(maps, ["account_number", "day"], "at"), ["account_number"], "day")
    ladder = F.array(*[F.lit(x) for x in RATING_LADDER])
    at = F.greatest(F.array_position(ladder, F.lower(F.coalesce("risk_rating", F.lit("standard")))), F.lit(1))
    rows = accounts.join(total, "account_number", "left")
    moved = F.element_at(ladder, F.element_at("map", at.cast("int")) + 1)
    return rows.select("account_number", F.col("risk_rating").alias("rating_before"),
                       F.when(F.col("map").isNull(), F.col("risk_rating")).otherwise(moved).alias("rating_after"))


def sar_state(sars: DataFrame, actions: DataFrame) -> DataFrame:
    """Reports stay draft until a ``submit`` action; ``actions`` has ``sar_id``, ``ts_us``, ``action``."""
    filed = actions.where("action = 'submit'").groupBy(F.col("sar_id").alias("id")).agg(
        F.max("ts_us").alias("filed_us"))
    rows = sars.join(filed, "id", "left")
    return rows.select(*[c for c in sars.columns if c != "status"],
                       F.when(F.col("filed_us").isNotNull(), "submitted").otherwise(F.col("status")).alias("status"),
                       "filed_us")


def sars_from_actions(actions: DataFrame) -> DataFrame:
    """A draft report per ``file_sar`` action."""
    rows = actions.where("action = 'file_sar'")
    return rows.select("id", "alert_id", "account_number", F.lit("draft").alias("status"), "ts_us")


def alert_case(alerts: DataFrame, tx: DataFrame, accounts: DataFrame, sars: DataFrame) -> DataFrame:
    """An alert with its transaction, account, and reports (newest first)."""
    t = tx.select(F.col("id").alias("transaction_id"), "amount", "transaction_type", "receiver_account")
    a = accounts.select("account_number", "username", "risk_rating", "kyc_status")
    s = sars.groupBy(F.col("alert_id").alias("id")).agg(
        F.count(F.lit(1)).alias("sar_count"), F.max(F.struct("ts_us", F.col("id").alias("sar_id"))).alias("newest"))
    rows = alerts.join(t, "transaction_id", "left").join(a, "account_number", "left").join(s, "id", "left")
    return rows.select(*alerts.columns, "amount", "transaction_type", "receiver_account", "username", "risk_rating",
                       "kyc_status", F.coalesce("sar_count", F.lit(0)).alias("sar_count"),
                       F.col("newest.sar_id").alias("newest_sar_id"))


def decoded_rules(alerts: DataFrame) -> DataFrame:
    """One row per rule of an alert, from its stored JSON; alerts without rules keep one row."""
    decoded = F.from_json("rules_triggered", f"array<{RULE_HIT.simpleString()}>")
    return alerts.select("id", F.explode_outer(decoded).alias("rule")).select("id", "rule.*")


def open_alert_queue(alerts: DataFrame, accounts: DataFrame, page: int = 1, size: int = 25) -> DataFrame:
    """Page of open alerts, newest first, with the account holder's name."""
    newest = (alerts.where("status = 'open'").orderBy(F.col("ts").desc(), F.col("id").desc())
              .offset((max(1, page) - 1) * size).limit(size))
    return newest.join(accounts.select("account_number", "username"), "account_number", "left")


def admission_check(requests: DataFrame, accounts: DataFrame) -> DataFrame:
    """Whether a requested transaction may be entered, and the first reason if not.

    ``requests`` has ``id``, sender and receiver account, ``transaction_type`` and ``amount``.
    """
    own = accounts.select(F.col("account_number").alias(SENDER), F.col("id").alias("_sid"),
                          F.col("balance").alias("_bal"))
    role = F.col("role") if "role" in accounts.columns else F.lit("customer")
    other = accounts.select(F.col("account_number").alias("receiver_account"), F.col("id").alias("_rid"),
                            role.alias("_role"))
    rows = requests.join(own, SENDER, "left").join(other, "receiver_account", "left")
    kind, amount = F.col("transaction_type"), F.col("amount")
    outside = F.col("_rid").isNull() | (F.col("_rid") == F.col("_sid")) | (F.col("_role") != "customer")
    reason = (F.when(~F.coalesce(kind.isin(REQUEST_TYPES), F.lit(False)), "Invalid transaction type.")
              .when(amount.isNull(), "Invalid amount.").when(amount <= 0, "Amount must be greater than zero.")
              .when(kind.isin("withdraw", "transfer") & (F.coalesce("_bal", F.lit(0)) < amount),
                    "Insufficient funds.")
              .when((kind == "transfer") & F.coalesce(outside, F.lit(True)),
                    "Recipient customer account not found."))
    return rows.select("id", reason.isNull().alias("admitted"), reason.alias("rejection"))


def applicant_check(applicants: DataFrame, accounts: DataFrame) -> DataFrame:
    """First problem of an application: missing field, reserved name, id format, name, email or id already taken.

    ``applicants`` has ``applicant_id``, ``username``, ``email``, ``id_number``.
    """
    rows = applicants.select("applicant_id", "username", "email",
                             normalize_national_id(F.col("id_number")).alias("id_number"))

    def taken(column: str) -> DataFrame:
        return accounts.select(column).where(F.col(column).isNotNull()).distinct().withColumn(f"_{column}", F.lit(True))

    for column in ("username", "email", "id_number"):
        rows = rows.join(taken(column), column, "left")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    reason = (F.when(blank("username") | blank("email") | blank("id_number"), "All fields are required.")
              .when(F.lower("username").isin(RESERVED_USERNAMES), "That username is reserved for bank staff.")
              .when(~is_valid_national_id(F.col("id_number")),
                    "ID number must use the format 00-000000A00, for example 08-995728P34.")
              .when(F.col("_username"), "Username already taken.").when(F.col("_email"), "Email already registered.")
              .when(F.col("_id_number"), "ID number already registered."))
    return rows.select("applicant_id", reason.isNull().alias("accepted"), reason.alias("rejection"))


def login_lockouts(attempts: DataFrame, window_us: int = 300 * SECOND_US, limit: int = 5,
                   lock_us: int = 900 * SECOND_US, hot: HotKeys = NO_HOT_KEYS) -> DataFrame:
    """Failed sign-ins that lock an identifier: the ``limit``-th failure within the window since the last success.

    ``attempts`` has ``id``, ``identifier``, ``ts_us``, ``success``.  The count restarts after each success, so a
    failure is counted per (identifier, successes so far).
    """
    order = running(attempts, "identifier", [
        Measure("era", F.when(F.col("success"), F.lit(1).cast("long")))], hot=hot)
    fails = order.where(~F.col("success")).withColumn("era", F.coalesce("era", F.lit(0)))
    seen = prior(fails, ["identifier", "era"], [
        Measure("earlier", F.lit(1).cast("long"), "sum", expires=F.col("ts_us") + (window_us - 1))], hot=hot)
    return seen.where(F.col("earlier") + 1 >= limit).select(
        "id", "identifier", "ts_us", (F.col("earlier") + 1).alias("failures"),
        (F.col("ts_us") + lock_us).alias("locked_until_us"))


def activity_feed(log: DataFrame, n: int, actor: str | None = None, action: str | None = None) -> DataFrame:
    """Newest ``n`` log rows, of one actor or action if given."""
    rows = log if actor is None else log.where(F.col("actor") == actor)
    rows = rows if action is None else rows.where(F.col("action") == action)
    return rows.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(n)


def activity_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("actor", "action").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))
