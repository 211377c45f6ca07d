"""Row validation and cleaning, batch split, statistics, duplicate removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moneytrail.constants import CHANNELS, RISK_LEVELS, TX_TYPES


def _number_text(col: Column) -> Column:
    """A double in plain notation, with at least one decimal."""
    return F.when(F.abs(col) < 1e7, col.cast("string")).otherwise(col.cast("decimal(38,1)").cast("string"))


def validate_transactions(df: DataFrame, as_of: str, strict: bool = False) -> DataFrame:
    """Add ``is_valid`` and ``errors`` and replace the checked columns by cleaned ones.

    All inputs are text.  Lenient mode repairs what it can and keeps the row; strict mode keeps the offending value
    and fails the query on the first invalid row.  ``as_of`` stands in for an unusable timestamp.
    """
    text = {c: F.col(c) for c in df.columns}
    none = F.lit(None).cast("string")
    get = lambda name: text.get(name, none)
    errors: list[Column] = []
    clean: dict[str, Column] = {}

    for field in ("amount", "transaction_type", "sender_account"):
        errors.append(F.when(get(field).isNull(), f"Missing required field: {field}"))

    given = F.coalesce(get("amount").cast("string"), F.lit("0.0"))
    parsed = F.expr("try_cast(coalesce(cast(`amount` AS STRING), '0.0') AS DOUBLE)") if "amount" in text \
        else F.lit(0.0)
    parsed = F.when(F.isnan(parsed), None).otherwise(parsed)
    low, high = parsed < 0.01, parsed > 10_000_000
    errors += [F.when(parsed.isNull(), F.concat(F.lit("Invalid amount value: "), given)),
               F.when(low, F.concat(F.lit("Amount "), _number_text(parsed), F.lit(" below minimum 0.01"))),
               F.when(high, F.concat(F.lit("Amount "), _number_text(parsed), F.lit(" exceeds maximum 10000000")))]
    bounded = parsed if strict else F.least(F.greatest(parsed, F.lit(0.01)), F.lit(1e7))
    clean["amount"] = F.when(parsed.isNull(), 0.0).otherwise(bounded)

    stamp = get("timestamp")
    moment = F.try_to_timestamp(F.trim(stamp.cast("string")))
    earliest, latest = F.lit("2000-01-01 00:00:00").cast("timestamp"), F.lit("2030" + as_of[4:].replace("-02-29", "-02-28", 1)).cast("timestamp")
    show = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00"))
    errors += [F.when(stamp.isNull(), "Missing timestamp"),
               F.when(stamp.isNotNull() & moment.isNull(),
                      F.concat(F.lit("Invalid timestamp format: "), stamp.cast("string"))),
               F.when(moment < earliest, F.concat(F.lit("Timestamp "), show(moment), F.lit(" before minimum "),
                                                  show(earliest))),
               F.when(moment > latest, F.concat(F.lit("Timestamp "), show(moment), F.lit(" after maximum "),
                                                show(latest)))]
    clean["timestamp"] = F.coalesce(moment, F.lit(as_of).cast("timestamp"))

    def member(name: str, default: str, repair: str, allowed: list[str], label: str) -> None:
        value = F.lower(F.trim(F.coalesce(get(name), F.lit(default))))
        bad = ~value.isin(allowed)
        errors.append(F.when(bad, F.concat(F.lit(f"Invalid {label}: "), value)))
        clean[name] = F.when(~bad, value).otherwise(F.coalesce(get(name), F.lit(default)) if strict
                                                    else F.lit(repair))

    member("transaction_type", "transfer", "transfer", TX_TYPES, "transaction type")
    member("channel", "online", "online", CHANNELS, "channel")

    sender = F.coalesce(get("sender_account"), F.lit("UNKNOWN"))
    errors.append(F.when(sender == "", "Invalid sender account: "))
    clean["sender_account"] = F.when(sender == "", "UNKNOWN").otherwise(sender)
    if "receiver_account" in text:
        clean["receiver_account"] = text["receiver_account"].cast("string")

    if "risk_level" in text:
        level = F.lower(F.trim(text["risk_level"]))
        errors.append(F.when(~level.isin(RISK_LEVELS), F.concat(F.lit("Invalid risk level: "), level)))
        clean["risk_level"] = F.when(level.isin(RISK_LEVELS), level).when(
            level.isNotNull(), text["risk_level"] if strict else F.lit("normal"))
    if "risk_score" in text:
        raw = text["risk_score"]
        score = F.expr("try_cast(`risk_score` AS DOUBLE)")
        outside = (score < 0) | (score > 100) | F.isnan(score)
        errors += [F.when(outside, F.concat(F.lit("Risk score "), _number_text(score),
                                            F.lit(" out of range [0, 100]"))),
                   F.when(raw.isNotNull() & score.isNull(), F.concat(F.lit("Invalid risk score: "),
                                                                     raw.cast("string")))]
        kept = score if strict else F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0))
        clean["risk_score"] = F.when(raw.isNotNull(), F.coalesce(kept, F.lit(0.0)))

    out = df.select("*", F.array_compact(F.array(*errors)).alias("errors"),
                    *[c.alias(f"_clean_{n}") for n, c in clean.items()])
    out = out.select(*[F.col(f"_clean_{c}").alias(c) if c in clean else F.col(c) for c in df.columns],
                     *[F.col(f"_clean_{n}").alias(n) for n in clean if n not in df.columns],
                     "errors", (F.size("errors") == 0).alias("is_valid"))
    if strict:
        message = F.concat(F.lit("Validation failed: "), F.concat_ws(", ", "errors"))
        out = out.where(F.when(F.col("is_valid"), True).otherwise(F.raise_error(message).cast("boolean")))
    return out


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Valid rows, invalid rows, and the flattened errors of the invalid ones."""
    return (validated.where("is_valid"), validated.where(~F.col("is_valid")),
            validated.where(~F.col("is_valid")).select("id", F.explode("errors").alias("error")))


def validation_stats(validated: DataFrame) -> DataFrame:
    passed = F.count_if("is_valid")
    total = F.count(F.lit(1))
    return validated.agg(total.alias("total_validated"), passed.alias("passed"), (total - passed).alias("failed"),
                         F.when(total > 0, passed / total).otherwise(0.0).alias("pass_rate"))


def error_histogram(validated: DataFrame) -> DataFrame:
    return validated.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def dedupe_transactions(df: DataFrame, key: str = "id", order: str = "ts_us", tie: str | None = None) -> DataFrame:
    """First row per id; each task drops all but its own first copy before the shuffle."""
    by = [F.col(order).asc_nulls_last()] + ([F.col(tie)] if tie else [])
    w = Window.partitionBy(key).orderBy(*by)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def training_rows(validated: DataFrame) -> DataFrame:
    """Training drops invalid rows; scoring keeps them with their repaired values."""
    return validated.where("is_valid")
