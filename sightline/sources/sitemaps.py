"""Sitemaps: locations, and the expansion of index files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOCATION = r"<loc>\s*([^<\s]+)\s*</loc>"


def locations(df: DataFrame, body: str) -> DataFrame:
    """df with a row for each location of its bodies, and whether the body is an index of sitemaps."""
    return df.select(*[c for c in df.columns if c != body], F.col(body).contains("<sitemapindex").alias("is_index"), F.explode(F.regexp_extract_all(body, F.lit(LOCATION), F.lit(1))).alias("loc"))


def expand(start: DataFrame, fetch: Callable[[DataFrame], DataFrame], levels: int = 3) -> DataFrame:
    """(loc) of all pages under the sitemaps in start (url, body); fetch reads (url) into (url, body). Each sitemap is read once, ``levels`` deep."""
    seen = start.select("url")
    found = locations(start.select("url", "body"), "body")
    pages = found.where("not is_index").select("loc")
    for _ in range(levels):
        more = found.where("is_index").select(F.col("loc").alias("url")).distinct().join(seen, "url", "left_anti")
        seen = seen.unionAll(more)
        found = locations(fetch(more), "body")
        pages = pages.unionAll(found.where("not is_index").select("loc"))
    return pages.distinct()
