"""The level maps and the name score as SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from moneytrail.functions.names import name_similarity

SQL_FUNCTIONS = {
    "aml_risk_level": ("score DOUBLE", "STRING",
                       "CASE WHEN score >= 80 THEN 'critical' WHEN score >= 60 THEN 'high_risk' WHEN score >= 40 "
                       "THEN 'suspicious' WHEN score >= 25 THEN 'low' ELSE 'normal' END"),
    "aml_composite_level": ("score DOUBLE", "STRING",
                            "CASE WHEN score >= 75 THEN 'critical' WHEN score >= 50 THEN 'high' WHEN score >= 25 "
                            "THEN 'medium' ELSE 'low' END"),
    "aml_anomaly_level": ("score DOUBLE", "STRING",
                          "CASE WHEN score >= 80 THEN 'critical' WHEN score >= 60 THEN 'high' WHEN score >= 40 "
                          "THEN 'medium' WHEN score >= 25 THEN 'low' ELSE 'normal' END"),
    "aml_training_label": ("level STRING, score DOUBLE", "STRING",
                           "CASE WHEN lower(coalesce(level, 'normal')) IN ('normal', 'low') AND score < 25 "
                           "THEN 'normal' WHEN lower(level) IN ('high_risk', 'critical', 'super_suspicious') "
                           "OR score >= 60 THEN 'super_suspicious' WHEN lower(level) IN ('suspicious', 'medium') "
                           "OR score >= 25 THEN 'suspicious' ELSE 'normal' END"),
    "aml_risk_rank": ("level STRING", "INT",
                      "CASE level WHEN 'low' THEN 1 WHEN 'suspicious' THEN 2 WHEN 'super_suspicious' THEN 3 "
                      "WHEN 'high_risk' THEN 3 WHEN 'critical' THEN 4 ELSE 0 END"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Make the functions callable from SQL in this session; returns their names.

    The level maps are SQL expressions, so they stay inside generated code; only the name score runs in Python.
    """
    for name, (args, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
    spark.udf.register("aml_name_similarity", name_similarity())
    return [*SQL_FUNCTIONS, "aml_name_similarity"]
