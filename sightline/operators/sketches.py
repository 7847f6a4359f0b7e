"""Distinct counts over any range of days, from one sketch a day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Registers of a sketch, as a power of two: a relative standard error of some 0.8 %.
LOG_REGISTERS = 14


def daily_sketches(df: DataFrame, ts: str, by: list[str], value: str) -> DataFrame:
    """(by, day, sketch, n): a sketch of the different values of each day, and its rows. Nulls are no values."""
    return df.groupBy(*by, F.to_date(ts).alias("day")).agg(F.hll_sketch_agg(value, LOG_REGISTERS).alias("sketch"), F.count("*").alias("n"))


def distinct_between(days: DataFrame, by: list[str], first: str, last: str) -> DataFrame:
    """(by, n, distinct): rows, and the estimated number of different values, of the days from first to last, from their sketches alone."""
    within = days.where(F.col("day").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))
    return within.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))
