"""Repairs, strict mode, bad rows."""

import pytest

from moneytrail.operators import validation

SCHEMA = ("id long, amount string, transaction_type string, sender_account string, receiver_account string, "
          "timestamp string, channel string")
AS_OF = "2024-01-02 06:00:00"


def check(spark, *rows, strict=False):
    return validation.validate_transactions(spark.createDataFrame(list(rows), SCHEMA), AS_OF, strict)


def test_good_row(spark):
    row = check(spark, (1, "100.5", "Transfer ", "A", "B", "2024-01-01T10:00:00Z", None)).first()
    assert row["is_valid"] and row["transaction_type"] == "transfer" and row["channel"] == "online"


def test_missing_amount(spark):
    row = check(spark, (1, None, "transfer", "A", "B", "2024-01-01T10:00:00", "atm")).first()
    assert row["amount"] == 0.01 and row["errors"] == ["Missing required field: amount",
                                                      "Amount 0.0 below minimum 0.01"]


def test_extremes(spark):
    rows = check(spark, (1, "10000000000", "transfer", "A", "B", "2024-01-01T10:00:00", "atm"),
                 (2, "NaN", "transfer", "A", "B", "2024-01-01T10:00:00", "atm"),
                 (3, "-100", "transfer", "A", "B", "invalid-date", "atm"),
                 (4, None, None, None, None, None, None),
                 (5, "5", "transfer", "Ünïcode", "B", "2024-01-01T10:00:00", "atm")).orderBy("id").collect()
    assert rows[0]["amount"] == 10_000_000 and "exceeds maximum" in rows[0]["errors"][0]
    assert rows[1]["amount"] == 0.0 and rows[1]["errors"] == ["Invalid amount value: NaN"]
    assert rows[2]["amount"] == 0.01 and rows[2]["timestamp"].isoformat() == "2024-01-02T06:00:00"
    assert rows[3]["sender_account"] == "UNKNOWN" and not rows[3]["is_valid"]
    assert rows[4]["is_valid"]


def test_strict_mode_fails(spark):
    good = check(spark, (1, "5", "transfer", "A", "B", "2024-01-01T10:00:00", "atm"), strict=True)
    assert good.count() == 1
    with pytest.raises(Exception, match="Validation failed"):
        check(spark, (1, "-5", "transfer", "A", "B", "2024-01-01T10:00:00", "atm"), strict=True).collect()
