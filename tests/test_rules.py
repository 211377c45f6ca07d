"""Worked examples of the typology rules and the risk blend."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from moneytrail.operators import risk, rules
from moneytrail.sources.tables import with_clock

NOON = datetime(2024, 3, 5, 12, 0)


def make(spark, rows):
    schema = ("id long, ts timestamp, sender_account string, receiver_account string, transaction_type string, "
              "amount decimal(18,2), destination_country string")
    from decimal import Decimal
    data = [(i, ts, s, r, k, Decimal(str(a)), c) for i, (ts, s, r, k, a, c) in enumerate(rows, 1)]
    return with_clock(spark.createDataFrame(data, schema))


def hits(spark, rows):
    last = len(rows)
    out = rules.rule_hits(rules.assess_rules(make(spark, rows))).where(F.col("id") == last)
    return {r["rule_id"] for r in out.collect()}


def test_four_transfers_then_one_more(spark):
    rows = [(NOON + timedelta(minutes=i), "A", f"R{i}", "transfer", 100, "ZW") for i in range(5)]
    assert hits(spark, rows) == {"R04", "R05"}


def test_small_deposits(spark):
    rows = [(NOON + timedelta(minutes=i), "A", "A", "deposit", 200, "ZW") for i in range(3)]
    assert hits(spark, rows) == {"R03"}


def test_band_and_geography(spark):
    assert hits(spark, [(NOON, "A", "B", "transfer", 9500, "IR")]) == {"R02", "R07", "R11"}


def test_night_cash(spark):
    assert hits(spark, [(NOON.replace(hour=1), "A", "A", "withdraw", 12000, "ZW")]) == {"R01", "R10"}


def test_window_edges(spark):
    """A row exactly one hour old counts, an equal time does not."""
    hour = [(NOON, "A", "B", "deposit", 600, "ZW")] * 4
    old = [(NOON - timedelta(hours=1), "A", "B", "deposit", 600, "ZW")] * 4
    assert "R04" not in hits(spark, hour + [hour[0]])
    assert "R04" in hits(spark, old + [hour[0]])
    gone = [(NOON - timedelta(hours=1, microseconds=1), "A", "B", "deposit", 600, "ZW")] * 4
    assert "R04" not in hits(spark, gone + [hour[0]])


def test_rules_off(spark):
    row = rules.assess_rules(make(spark, [(NOON, "A", "B", "transfer", 9500, "IR")]), enabled=False).first()
    assert row["rule_score"] == 0 and row["rule_level"] == "normal"


@pytest.mark.parametrize("score,level,ai,conf,mandatory,want_score,want_level", [
    (65, "high_risk", "normal", 0.95, True, 65, "high_risk"),
    (20, "normal", "super_suspicious", 0.88, False, 80, "critical"),
    (10, "normal", "normal", 0.95, False, 10, "normal"),
    (45, "suspicious", "normal", 0.92, False, 45, "suspicious"),
    (45, "suspicious", "normal", 0.40, False, 45, "suspicious"),
    (45, "suspicious", None, 0.0, False, 45, "suspicious"),
])
def test_blend(spark, score, level, ai, conf, mandatory, want_score, want_level):
    df = spark.createDataFrame([(score, level, ai, conf, mandatory)],
                               "rule_score long, rule_level string, ai_level string, ai_confidence double, "
                               "mandatory boolean")
    row = risk.combine_rule_ai(df).first()
    assert (row["final_score"], row["final_level"]) == (want_score, want_level)


def test_blend_reasons(spark):
    rows = [(45, "suspicious", "High-value transfer", "normal", 0.92, False), (20, "normal", "Routine", "super_suspicious", 0.88, False),
            (65, "high_risk", "[SAR REVIEW] limit", "normal", 0.95, True), (10, "normal", "Small", "normal", 0.9, False),
            (30, "low", "x", "critical", 0.7, True), (30, "low", None, None, None, False), (30, "low", "y", "suspicious", 0.3, False)]
    df = spark.createDataFrame(rows, "rule_score long, rule_level string, rule_reason string, ai_level string, ai_confidence double, mandatory boolean")
    got = [(r["final_reason"], r["ai_reason"]) for r in risk.combine_rule_ai(df).collect()]
    assert "reviewed but did not downgrade" in got[0][0] and "92% confidence, 85% AI weighting" in got[0][0] and "normal" in got[0][1]
    assert "AI-led behavior model increased" in got[1][0] and "super suspicious with 88%" in got[1][1]
    assert got[2][0].endswith("(95% confidence). Rule review: [SAR REVIEW] limit") and "despite AI normal" in got[2][0]
    assert "reduced. Rule review: Small" in got[3][0]
    assert "added elevated context" in got[4][0] or got[4][0] == "x"
    assert got[5] == ("", "AI model unavailable or not confident enough to affect final risk.")
    assert got[6] == ("y", "AI behavior model predicted suspicious with 30% confidence.")


def test_calibration(spark):
    df = spark.createDataFrame([(80, "normal", False), (80, "normal", True), (10, "suspicious", False),
                                (10, "super_suspicious", False)],
                               "risk_score long, generated_label string, mandatory boolean")
    got = [(r["calibrated_score"], r["calibrated_level"]) for r in risk.calibrate_labelled_risk(df).collect()]
    assert got == [(20, "normal"), (80, "high_risk"), (45, "suspicious"), (70, "high_risk")]


def test_composite_levels(spark):
    from moneytrail.functions.scalars import composite_level
    df = spark.createDataFrame([(10.0,), (40.0,), (65.0,), (85.0,)], "s double")
    assert [r[0] for r in df.select(composite_level(F.col("s"))).collect()] == ["low", "medium", "high", "critical"]


def test_pipeline_without_rules_or_models(spark, tiny, tx):
    """The bare pipeline leaves every transaction at the score behaviour and models give: none."""
    from moneytrail.plans.online import score_online
    from moneytrail.sources import views
    none = spark.createDataFrame([], "p_name string, w_name string, score double")
    rows = score_online(tx, views.accounts(spark, tiny), views.watchlist(spark, tiny), pairs=none,
                        rules_enabled=False)
    assert rows.where("risk_score != 0 OR risk_level != 'normal' OR rule_score != 0").count() == 0
    assert rows.count() == tx.count()
    assert rows.where("mandatory AND size(screening_hits) = 0").count() == 0
