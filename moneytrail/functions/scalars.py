"""Column functions: levels, names and ids, time parts, texts, small arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from moneytrail.constants import (ANOMALY_TO_STANDARD, CHANNELS, COUNTRY_LISTS, RATING_LADDER, RATING_STEP,
                                  RISK_RANK, TOKEN_WEIGHT)


def _steps(col: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    out = None
    for bound, level in steps:
        out = F.when(col >= bound, level) if out is None else out.when(col >= bound, level)
    return out.otherwise(otherwise)


def lookup(col: Column, mapping: dict, otherwise) -> Column:
    """``mapping[col]``, or ``otherwise``."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.coalesce(col, F.lit(""))), F.lit(otherwise))


def risk_level_from_score(col: Column) -> Column:
    return _steps(col, [(80, "critical"), (60, "high_risk"), (40, "suspicious"), (25, "low")], "normal")


def composite_level(col: Column) -> Column:
    return _steps(col, [(75, "critical"), (50, "high"), (25, "medium")], "low")


def anomaly_level(col: Column) -> Column:
    return _steps(col, [(80, "critical"), (60, "high"), (40, "medium"), (25, "low")], "normal")


def standard_level(anomaly: Column) -> Column:
    return lookup(anomaly, ANOMALY_TO_STANDARD, "normal")


def training_label(level: Column, score: Column) -> Column:
    level = F.lower(F.coalesce(level, F.lit("normal")))
    score = F.coalesce(score, F.lit(0))
    return (F.when(level.isin("normal", "low") & (score < 25), "normal")
            .when(level.isin("high_risk", "critical", "super_suspicious") | (score >= 60), "super_suspicious")
            .when(level.isin("suspicious", "medium") | (score >= 25), "suspicious").otherwise("normal"))


def risk_rank(level: Column) -> Column:
    return lookup(level, RISK_RANK, 0)


def next_risk_rating(current: Column, action: Column) -> Column:
    """One move on the rating ladder, clamped at both ends; an unknown rating counts as the lowest."""
    ladder = F.array(*[F.lit(x) for x in RATING_LADDER])
    index = F.greatest(F.array_position(ladder, F.lower(F.coalesce(current, F.lit("standard")))), F.lit(1))
    step = lookup(action, RATING_STEP, 0)
    moved = F.least(F.greatest(index + step, F.lit(1)), F.lit(len(RATING_LADDER)))
    return F.when(step == 0, current).otherwise(F.element_at(ladder, moved.cast("int")))


def country_risk(col: Column) -> Column:
    country = F.upper(F.coalesce(col, F.lit("")))
    return (F.when(country.isin(COUNTRY_LISTS["features_high"]), 1.0)
            .when(country.isin(COUNTRY_LISTS["features_medium"]), 0.5).otherwise(0.0))


def normalize_name(col: Column) -> Column:
    cleaned = F.regexp_replace(F.upper(F.coalesce(col, F.lit(""))), r"[^A-Z0-9\s]", " ")
    return F.trim(F.regexp_replace(cleaned, r"\s+", " "))


def normalize_id(col: Column) -> Column:
    return F.upper(F.trim(F.coalesce(col, F.lit(""))))


def normalize_national_id(col: Column) -> Column:
    compact = F.upper(F.regexp_replace(F.coalesce(col, F.lit("")), "[^0-9A-Za-z]", ""))
    return F.when(compact.rlike(r"^\d{8,9}[A-Z]\d{2}$"),
                  F.concat(F.substring(compact, 1, 2), F.lit("-"), F.substring(compact, 3, 100))).otherwise(normalize_id(col))


def is_valid_national_id(col: Column) -> Column:
    return F.coalesce(col.rlike(r"^\d{2}-\d{6,7}[A-Z]\d{2}$"), F.lit(False))


def name_tokens(normalized: Column) -> Column:
    return F.filter(F.array_distinct(F.split(normalized, " ")), lambda t: t != "")


def token_overlap(a: Column, b: Column) -> Column:
    """Shared share of the tokens of two normalised names, weighted as a name score; equal names score 1."""
    ta, tb = name_tokens(a), name_tokens(b)
    larger = F.greatest(F.size(ta), F.size(tb))
    return (F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0)
            .otherwise(F.size(F.array_intersect(ta, tb)) / larger * TOKEN_WEIGHT))


def safe_ratio(numerator: Column, denominator: Column, default: float) -> Column:
    return F.when(denominator > 0, numerator / F.when(denominator > 0, denominator)).otherwise(F.lit(default))


def is_night(hour: Column) -> Column:
    return (hour < 5) | (hour >= 23)


def parse_timestamp(col: Column, default: Column | None = None) -> Column:
    """ISO timestamp, ``Z`` or offset allowed, without one UTC; unparseable gives ``default``."""
    parsed = F.try_to_timestamp(F.trim(col))
    return parsed if default is None else F.coalesce(parsed, default)


def one_hot(col: Column, values: list[str], prefix: str) -> dict[str, Column]:
    return {f"{prefix}{v}": F.coalesce(col == v, F.lit(False)).cast("double") for v in values}


def channel_ordinal(col: Column, codes: dict[str, int]) -> Column:
    return lookup(F.lower(col), codes, 0)


def all_channel_codes() -> dict[str, int]:
    return {c: i for i, c in enumerate(CHANNELS)}


def money_text(col: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(col, 2))


def percent_text(col: Column, digits: int = 0) -> Column:
    return F.format_string(f"%.{digits}f%%", col.cast("double") * 100)


def report_reference(kind: str, created_at: Column, number: Column) -> Column:
    """``SAR-2024-0102-0007``: the date and the low four digits of the report's number."""
    return F.concat(F.lit(f"{kind}-"), F.date_format(created_at, "yyyy-MMdd"), F.lit("-"),
                    F.lpad((number % 10_000).cast("string"), 4, "0"))


def min_distance(value: Column, values: Column) -> Column:
    return F.array_min(F.transform(values, lambda v: F.abs(v - value)))


def index_percentile(sorted_values: Column, p: int) -> Column:
    """The element at ``floor(n * p / 100)`` of an ascending array, without interpolation."""
    return F.element_at(sorted_values, (F.floor(F.size(sorted_values) * p / 100) + 1).cast("int"))


def encode_evidence(col: Column) -> Column:
    return F.to_json(col)


def decode_evidence(col: Column, schema) -> Column:
    return F.from_json(col, schema)
