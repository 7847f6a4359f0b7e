"""Keywords: candidates, intent, demand, and clusters of those that share results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.graph import components
from ..functions.text import ascii_bounds, normal_keyword
from .set_join import alike_by_count, linked

#: Wordings of intents, first match counts.
TRANSACTIONAL = r"(?i)\b(buy|download|install|sign ?up|trial|demo|coupon|discount)\b"
COMPARISON = r"(?i)\b(vs|versus|alternative|alternatives|compared to)\b"
COMMERCIAL = r"(?i)\b(best|top|vs|versus|alternative|alternatives|pricing|cost|cheap|free|review|compare)\b"
QUESTION = r"(?i)^\s*(how|what|why|when|which|who|where|can|does|do|is|are|should)\b"
TOOL = r"(?i)\b(generat|calculat|convert|check|test|validat|estimat|build|creat|compar|pick|analyz|audit|format|encode|decode)\w*\b"


def intent(keyword: Column) -> Column:
    has = lambda pattern: keyword.rlike(ascii_bounds(pattern))
    return F.when(has(TRANSACTIONAL), "transactional").when(has(COMPARISON), "comparison").when(has(COMMERCIAL), "commercial").otherwise("informational")


def tool_shaped(keyword: Column) -> Column:
    return keyword.rlike(ascii_bounds(TOOL))


def n_words(keyword: Column) -> Column:
    return F.size(F.filter(F.split(keyword, r"\s+"), lambda w: w != ""))


def holds_all(keyword: Column, tokens: list[str]) -> Column:
    return F.forall(F.array(*[F.lit(t) for t in tokens]), lambda t: keyword.contains(t))


def candidates(suggestions: DataFrame) -> DataFrame:
    """One row a keyword of (suggestion, depth, rank, via, engine): least depth, best rank, times seen, origins, agreement and a demand proxy.

    An engine that answered nothing at all leaves the denominator; with none
    answering the share is null.
    """
    rows = suggestions.withColumn("keyword", normal_keyword("suggestion"))
    answering = rows.where(F.col("suggestion").isNotNull()).agg(F.countDistinct("engine").alias("live"))
    out = rows.where(F.col("keyword").isNotNull()).groupBy("keyword").agg(
        F.min("depth").alias("min_depth"), F.min("rank").alias("best_rank"), F.count("*").alias("times_seen"), F.countDistinct("engine").alias("agreement"),
        F.array_join(F.array_sort(F.collect_set("engine")), ",").alias("engines"), F.array_join(F.array_sort(F.collect_set("via")), ",").alias("via"),
    ).crossJoin(F.broadcast(answering))
    proxy = F.greatest(F.lit(0), 100 - 22 * F.col("min_depth") - 4 * (F.col("best_rank") - 1) + 3 * F.least(F.col("times_seen") - 1, F.lit(6)))
    share = F.round(F.try_divide(100 * F.col("agreement"), F.col("live")), 0)
    words = n_words(F.col("keyword"))
    return out.withColumns({"demand_proxy": proxy, "agreement_pct": share, "intent": intent(F.col("keyword")), "tool_shaped": tool_shaped(F.col("keyword")), "mid_tail": words.between(2, 5), "words": words.cast("long")}).drop("live")


def affordable(rows: DataFrame, most_kd: float, least_volume: int) -> DataFrame:
    """An unknown difficulty is not a high one; an unknown volume is none."""
    return rows.where((F.coalesce("volume", F.lit(0)) >= least_volume) & (F.col("kd").isNull() | (F.col("kd") <= most_kd)))


def _shown(results: DataFrame) -> DataFrame:
    """Distinct (id, item): keywords and hashes of their URLs."""
    return results.select(F.col("keyword").alias("id"), F.xxhash64(F.regexp_replace(F.substring_index("url", "#", 1), "/+$", "")).alias("item")).where("item IS NOT NULL AND id IS NOT NULL").distinct()


def shared_results(results: DataFrame, overlap: int = 3) -> DataFrame:
    """(a, b, shared): pairs of keywords a < b with at least ``overlap`` common URLs.

    Keywords with fewer URLs than that are in no pair. Keywords of few URLs come together at those
    they have to share; a URL that nearly all show brings nobody together.
    """
    return alike_by_count(_shown(results), overlap)


def clusters(results: DataFrame, overlap: int = 3) -> DataFrame:
    """(keyword, cluster, degree): connected components by shared results; a keyword without any is a cluster of its own.

    The pairs themselves, whose number grows as the square of the keywords, are not made.
    """
    edges, degree = linked(_shown(results), overlap)
    found = components(edges).withColumnRenamed("node", "keyword")
    keywords = results.select("keyword").distinct()
    return keywords.join(found, "keyword", "left").join(degree.withColumnRenamed("id", "keyword"), "keyword", "left").select("keyword", F.coalesce("label", "keyword").alias("cluster"), F.coalesce("degree", F.lit(0)).alias("degree"))


def result_components(results: DataFrame, overlap: int = 3) -> DataFrame:
    """(node, label) of the keywords that share results with others."""
    return components(linked(_shown(results), overlap)[0])


def cluster_stats(members: DataFrame) -> DataFrame:
    """One row a cluster: size, head (highest degree, then shortest, then first), and its bridges (degree 1 in a cluster of over two)."""
    text = F.col("keyword").cast("string")
    head = F.min_by(text, F.struct(-F.col("degree"), F.length(text), text))
    out = members.groupBy("cluster").agg(F.count("*").alias("size"), head.alias("head"), F.count_if(F.col("degree") == 1).alias("ones"))
    return out.select("cluster", "size", "head", F.when(F.col("size") > 2, F.col("ones")).otherwise(0).alias("bridges"))


def shared_by_all(members: DataFrame, results: DataFrame) -> DataFrame:
    """(cluster, url): URLs that every keyword of a cluster shows."""
    own = results.select("keyword", F.regexp_replace(F.substring_index("url", "#", 1), "/+$", "").alias("url")).distinct()
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"))
    return own.join(members, "keyword").groupBy("cluster", "url").agg(F.count("*").alias("n")).join(sizes, "cluster").where("n = size").select("cluster", "url")


def order_of(by: str = "proxy") -> list:
    """The columns to order candidates by: demand, words, name or agreement; ties by keyword."""
    orders = {"proxy": ["-demand_proxy"], "words": ["words", "-demand_proxy"], "alpha": [], "agreement": ["-agreement", "-demand_proxy"]}
    return [*[F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in orders[by]], F.asc("keyword")]


def ordered(rows: DataFrame, by: str = "proxy") -> DataFrame:
    return rows.orderBy(*order_of(by))
