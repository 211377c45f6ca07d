"""Table schemas and additive schema evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _D, _B, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
MONEY = T.DecimalType(18, 2)


def _schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


RULE_HIT = _schema(rule_id=_S, score_delta=_L, reason=_S, severity=_S, typology=_S,
                   evidence=T.MapType(_S, _S))
SCREENING_HIT = _schema(source=_S, list_type=_S, matched_name=_S, match_type=_S, match_score=_D, reason=_S,
                        severity=_S, score_delta=_L)
PATTERN = _schema(type=_S, description=_S, risk_level=_S, metrics=T.MapType(_S, _D))

TABLES = {
    "transactions": _schema(
        id=_L, ts=_TS, sender_account=_S, receiver_account=_S, amount=MONEY, transaction_type=_S, currency=_S,
        channel=_S, destination_country=_S, status=_S, risk_score=_D, risk_level=_S, rule_score=_D, rule_level=_S,
        rule_reason=_S, ai_risk_level=_S, ai_confidence=_D, ai_reason=_S, description=_S, ctr_required=_B,
        sar_required=_B, reviewed_by=_S, reviewed_at=_TS, generated_label=_S),
    "accounts": _schema(
        id=_L, account_number=_S, username=_S, email=_S, id_number=_S, role=_S, balance=MONEY, kyc_status=_S,
        pep_flag=_B, risk_rating=_S, wealth_segment=_S, created_at=_TS),
    "alerts": _schema(
        id=_L, transaction_id=_L, account_number=_S, risk_score=_D, risk_level=_S, reason=_S, rules_triggered=_S,
        status=_S, assigned_to=_S, case_notes=_S, resolved_at=_TS, resolved_by=_S, ts=_TS),
    "sar_reports": _schema(id=_L, alert_id=_L, account_number=_S, filed_by=_S, narrative=_S, status=_S,
                           filed_at=_TS, reference_number=_S, created_at=_TS),
    "ctr_reports": _schema(id=_L, transaction_id=_L, account_number=_S, amount=MONEY, generated_by=_S, status=_S,
                           filed_at=_TS, created_at=_TS),
    "watchlist": _schema(id=_L, name=_S, id_number=_S, account_number=_S, list_type=_S, reason=_S, added_by=_S,
                         added_at=_TS),
    "activity_log": _schema(id=_L, actor=_S, action=_S, detail=_S, ip_address=_S, ts=_TS),
}

DEFAULTS = {
    "transactions": {"currency": "USD", "channel": "online", "destination_country": "ZW", "status": "completed",
                     "risk_score": 0.0, "risk_level": "normal", "rule_score": 0.0, "rule_level": "normal",
                     "ai_confidence": 0.0, "ctr_required": False, "sar_required": False},
    "accounts": {"role": "customer", "balance": 0, "kyc_status": "pending", "pep_flag": False,
                 "risk_rating": "standard", "wealth_segment": "average"},
    "alerts": {"status": "open"},
    "sar_reports": {"status": "draft"},
    "ctr_reports": {"status": "pending", "generated_by": "system"},
    "watchlist": {"list_type": "internal"},
    "activity_log": {},
}


def conform_schema(df: DataFrame, schema: T.StructType, defaults: dict | None = None,
                   keep_extra: bool = False) -> DataFrame:
    """Columns of ``schema`` in order and type: missing or NULL values take their default, if there is one."""
    defaults = defaults or {}
    have = {c.lower(): c for c in df.columns}
    out = []
    for field in schema.fields:
        column = F.col(have[field.name.lower()]).cast(field.dataType) if field.name.lower() in have else \
            F.lit(None).cast(field.dataType)
        if field.name in defaults:
            column = F.coalesce(column, F.lit(defaults[field.name]).cast(field.dataType))
        out.append(column.alias(field.name))
    if keep_extra:
        names = {f.name.lower() for f in schema.fields}
        out += [F.col(c) for c in df.columns if c.lower() not in names]
    return df.select(*out)
