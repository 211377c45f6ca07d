"""Spark-native analytics for anti-money-laundering monitoring.

Every operator is a function from DataFrames to a DataFrame.  Nothing reads the wall clock: operators that
depend on "now" take an explicit ``as_of``.
"""

__version__ = "0.1.0"
