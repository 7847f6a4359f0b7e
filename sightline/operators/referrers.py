"""Where visits come from: classes of referrers, backlinks that people follow, presence in crawl indexes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.urls import site

#: Fragments of hosts of search engines, the visitor's own machine, and assistants.
SEARCH = ("google.", "bing.com", "duckduckgo.com", "yandex.", "baidu.com", "ecosia.org", "search.brave.com", "startpage.com", "qwant.com", "search.marginalia.nu", "searx", "lite.duckduckgo.com", "html.duckduckgo.com", "seznam.cz", "naver.com", "search.yahoo.com", "yahoo.co", "so.com", "sogou.com", "360.cn", "mail.ru", "ask.com", "aol.com", "petalsearch.com", "onesearch.com", "lycos.com")
LOCAL = ("localhost", "127.0.0.1", "0.0.0.0", "::1", "host.docker.internal", "tauri.localhost", "host.containers.internal")
ASSISTANTS = ("chatgpt.com", "chat.openai.com", "perplexity.ai", "claude.ai", "gemini.google.com", "copilot.microsoft.com", "you.com", "phind.com", "poe.com", "mistral.ai")
#: Fixed value: addresses of private networks.
PRIVATE = r"^(192\.168\.|10\.|172\.16\.|172\.17\.|172\.18\.|169\.254\.)"


def is_local(host: Column) -> Column:
    bare = F.substring_index(host, ":", 1)
    return bare.isin(*LOCAL) | bare.endswith(".localhost") | bare.endswith(".local") | bare.rlike(PRIVATE)


def _any(host: Column, fragments: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [host.contains(x) for x in fragments])


def classified(visits: DataFrame, own: str) -> DataFrame:
    """visits with ``host`` of the referrer and its ``class``; the first rule that holds counts, a referrer without host has none."""
    host = site(F.coalesce("referer", F.lit("")))
    kind = (
        F.when(F.trim(F.coalesce("referer", F.lit(""))) == "", "direct")
        .when(F.col("host") == "", F.lit(None))
        .when((F.col("host") == own) | F.col("host").endswith(f".{own}"), "internal")
        .when(is_local(F.col("host")), "local")
        .when(_any(F.col("host"), SEARCH), "search")
        .when(_any(F.col("host"), ASSISTANTS), "ai")
        .otherwise("backlink")
    )
    return visits.withColumn("host", host).withColumn("class", kind)


def referrals(visits: DataFrame) -> DataFrame:
    """(class, host, visits): visits of each class, those from search engines and assistants by host; ``all`` counts every visit."""
    of_host = F.when(F.col("class").isin("search", "ai"), F.col("host")).otherwise("")
    each = F.explode(F.filter(F.array(F.struct(F.lit("all").alias("c"), F.lit("").alias("h")), F.struct(F.col("class").alias("c"), of_host.alias("h"))), lambda x: x["c"].isNotNull())).alias("x")
    return visits.select(each).groupBy(F.col("x.c").alias("class"), F.col("x.h").alias("host")).agg(F.count("*").alias("visits"))


def backlinks(visits: DataFrame, when: str) -> DataFrame:
    """One row a referring host: visits, distinct sources, the first source and three landing pages by visits, first and last time."""
    links = visits.where(F.col("class") == "backlink").withColumn("source", F.left("referer", F.lit(180))).withColumn("landing", F.substring_index("uri", "?", 1))
    total = links.groupBy("host").agg(F.count("*").alias("visits"), F.countDistinct("source").alias("sources"), F.min(when).alias("first_seen"), F.max(when).alias("last_seen"))

    def ranked(item: str, k: int) -> DataFrame:
        counts = links.groupBy("host", item).agg(F.count("*").alias("n"))
        return counts.withColumn("rn", F.row_number().over(W.partitionBy("host").orderBy(F.desc("n"), item))).where(F.col("rn") <= k)

    top = ranked("source", 1).select("host", F.col("source").alias("top_source"))
    pages = ranked("landing", 3).groupBy("host").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.concat_ws("=", "landing", F.col("n").cast("string")).alias("t")))), lambda x: x["t"]), " ").alias("top_landings"))
    return total.join(top, "host").join(pages, "host").select("host", "visits", "sources", "top_source", "top_landings", "first_seen", "last_seen")


def footprint(captures: DataFrame) -> DataFrame:
    """Presence of hosts in crawl indexes: present if any index says so, absent if any does, else unknown."""
    state = F.when(F.bool_or(F.col("state") == "present"), "present").when(F.bool_or(F.col("state") == "absent"), "absent").otherwise("unknown")
    return captures.groupBy("host").agg(state.alias("verdict"), F.countDistinct(F.substring_index("url", "#", 1)).alias("urls"), F.count_if(F.col("status") == "200").alias("ok_captures"))
