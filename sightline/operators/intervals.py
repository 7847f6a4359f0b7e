"""Joins of intervals that overlap, by buckets of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucket_width(df: DataFrame, start: str, end: str) -> int:
    """The mean length of the intervals (at least one), so that they reach into two buckets in the mean, whatever the longest."""
    return max(1, int(df.agg(F.avg(F.col(end) - F.col(start))).first()[0] or 1))


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], start: str = "start", end: str = "end", width: int | None = None) -> DataFrame:
    """Pairs of rows of equal ``on`` whose closed intervals (long numbers) overlap; right's start and end are called other_start and other_end.

    Intervals are cut at the buckets they reach into and meet by equal bucket; a
    pair counts in the first bucket that both reach into, and so once. Rows with a null
    key, start or end, or that end before they start, are in no pair.
    """
    sound = lambda df: df.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
    left, right = sound(left), sound(right)
    width = width or max(bucket_width(left, start, end), bucket_width(right, start, end))
    at = lambda c: F.floor(F.col(c) / width).cast("long")
    a = left.withColumn("__bucket", F.explode(F.sequence(at(start), at(end))))
    b = right.withColumnsRenamed({start: "other_start", end: "other_end"})
    b = b.withColumn("__bucket", F.explode(F.sequence(at("other_start"), at("other_end"))))
    met = a.join(b.hint("merge"), [*on, "__bucket"])
    first = F.floor(F.greatest(F.col(start), F.col("other_start")) / width)
    return met.where((F.col(start) <= F.col("other_end")) & (F.col("other_start") <= F.col(end)) & (F.col("__bucket") == first)).drop("__bucket")
