"""Graphs of links: who links back, and who is linked by how many."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Parts that the links to one target are dealt out over.
SALTS = 32


def unreturned(links: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(source, target) of links that are not returned, each once; links to oneself return themselves.

    One shuffle: both directions of a pair meet under (lesser, greater), each as a bit.
    """
    s, t = F.col(source), F.col(target)
    pairs = links.where(s.isNotNull() & t.isNotNull()).groupBy(F.least(s, t).alias("low"), F.greatest(s, t).alias("high")).agg(F.bit_or(F.when(s < t, 1).when(s > t, 2).otherwise(3)).alias("ways"))
    up = F.col("ways") == 1
    return pairs.where("ways < 3").select(F.when(up, F.col("low")).otherwise(F.col("high")).alias(source), F.when(up, F.col("high")).otherwise(F.col("low")).alias(target))


def fan_in(links: DataFrame, keep: int = 3, source: str = "source", target: str = "target") -> DataFrame:
    """(target, n_sources, first_sources): how many different sources link to each target, and the first ``keep`` of them.

    The sources of a target are dealt out over SALTS tasks, each of which passes on its count and its first few, so a
    hub that all link to is not one task.
    """
    own = links.where(F.col(target).isNotNull() & F.col(source).isNotNull()).select(source, target).distinct().withColumn("salt", F.pmod(F.xxhash64(source), F.lit(SALTS)))
    part = W.partitionBy(target, "salt").orderBy(source)
    few = own.withColumn("place", F.row_number().over(part))
    merged = few.groupBy(target, "salt").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("place") <= keep, F.col(source)))).alias("few"))
    first = F.slice(F.array_sort(F.flatten(F.collect_list("few"))), 1, keep)  # SALTS lists of a few each
    return merged.groupBy(target).agg(F.sum("n").alias("n_sources"), F.array_join(first, " ").alias("first_sources"))


def with_status(links: DataFrame, pages: DataFrame, target: str = "target", url: str = "url") -> DataFrame:
    """links with ``known``: whether their target is one of the pages."""
    there = pages.select(F.col(url).alias(target)).where(F.col(target).isNotNull()).distinct().withColumn("__there", F.lit(True))
    return links.join(there.hint("merge"), target, "left").withColumn("known", F.coalesce("__there", F.lit(False))).drop("__there")
