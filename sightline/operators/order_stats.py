"""Exact order statistics of a column, by group, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import materialize


def order_statistics(df: DataFrame, value: str, shares: dict[str, float], by: list[str] = ()) -> DataFrame:
    """(by, n, one column for each name of shares): the value at place floor(n * share), from 0, in each group's order; nulls are left out. Without groups there is always one row.

    Values are counted, and their counts dealt out in sorted ranges. The sums of
    the ranges tell which range holds a place, and only the values of such ranges are summed up one by one. A
    group has at most one sum for each range.
    """
    group = [F.col(c) for c in by]
    counted = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    dealt = materialize(counted.repartitionByRange(*[F.asc_nulls_first(c) for c in by], F.asc("__v")).withColumn("__r", F.spark_partition_id()), "ranges")
    key = list(by) or [F.lit(0)]
    sums = dealt.groupBy(*by, "__r").agg(F.sum("__c").alias("__c"))
    whole = W.partitionBy(*key)
    sums = sums.withColumns({"__n": F.sum("__c").over(whole), "__before": F.coalesce(F.sum("__c").over(whole.orderBy("__r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    places = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(share).alias("share")) for name, share in shares.items()]))
    wanted = sums.withColumn("__q", places).withColumn("__at", F.floor(F.col("__n") * F.col("__q.share")))
    wanted = wanted.where((F.col("__at") >= F.col("__before")) & (F.col("__at") < F.col("__before") + F.col("__c"))).select(*[F.col(c).alias(f"__g_{c}") for c in by], F.col("__r").alias("__in"), "__n", F.col("__q.name").alias("__name"), (F.col("__at") - F.col("__before")).alias("__at"))
    same = F.col("__r") == F.col("__in")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    running = W.partitionBy(*by, "__r", "__name").orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    near = dealt.join(wanted.hint("merge"), same).withColumn("__upto", F.sum("__c").over(running)).where(F.col("__upto") > F.col("__at"))
    return near.groupBy(*by).agg(F.coalesce(F.first("__n"), F.lit(0)).alias("n"), *[F.min(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in shares])
