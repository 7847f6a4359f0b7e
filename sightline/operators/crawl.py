"""Crawl budget: who reads a site, what they read, and who only claims to be them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .registry_bots import ASSET, BOTS, CATEGORIES, OPERATORS


def first_hit(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """The value of the first fragment, in list order, that the text contains; null for none."""
    return F.coalesce(*[F.when(text.contains(fragment), F.lit(value)) for fragment, value in pairs])


def bot_key(ua: Column) -> Column:
    """Key of the first registry entry in the agent; 'other-bot' for unknown crawlers; null for people."""
    low = F.lower(F.coalesce(ua, F.lit("")))
    other = reduce(lambda a, b: a | b, [low.contains(x) for x in ("bot", "crawler", "spider", "http")])
    return F.coalesce(first_hit(low, [(b[0], b[0]) for b in BOTS]), F.when(other, F.lit("other-bot")))


def bot_field(key: Column, place: int) -> Column:
    """Label (1) or category (2) of a key."""
    known = F.create_map(*[F.lit(x) for b in BOTS for x in (b[0], b[place])])
    return F.when(key == "other-bot", F.lit("other-bot" if place == 1 else "unknown")).otherwise(F.try_element_at(known, key))


def operator_of(key: Column) -> Column:
    """Company of a registry key, from one literal map; null for keys of none."""
    owned = [(b[0], next((name for part, name in OPERATORS if part in b[0]), None)) for b in BOTS]
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in dict(owned).items() if pair[1] for x in pair]), key)


def is_asset(path: Column) -> Column:
    return path.rlike(ASSET)


def silo(uri: Column, depth: int = 1) -> Column:
    """The first ``depth`` steps of a path, '/*' for deeper ones; assets go to their first step."""
    path = F.regexp_extract(F.coalesce(uri, F.lit("")), r"^[^?#]*", 0)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    taken = F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, depth), "/"), F.when(F.size(parts) > depth, "/*").otherwise(""))
    return F.when(F.size(parts) == 0, F.lit("/")).when(is_asset(path), F.concat(F.lit("/"), F.get(parts, F.lit(0)), F.lit("/ (assets)"))).otherwise(taken)


def recent(df: DataFrame, ts: str, now: str, days: int) -> DataFrame:
    """Rows of the last days before a stated time; rows without a time stay."""
    return df.where(F.col(ts).isNull() | (F.col(ts) >= F.to_timestamp(F.lit(now)) - F.make_interval(days=F.lit(days))))


def status_filter(column: str, wanted: str) -> Column:
    """'4xx,404' as a condition on a status column."""
    out = F.lit(False)
    for item in wanted.lower().split(","):
        item = item.strip()
        if item.endswith("xx"):
            out = out | F.col(column).between(int(item[0]) * 100, int(item[0]) * 100 + 99)
        elif item:
            out = out | (F.col(column) == int(item))
    return out


def bot_hits(records: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Records of crawlers with key, label and category; people are left out, other keys too if some are asked for."""
    out = records.withColumn("key", bot_key(F.col("ua"))).where(F.col("key").isNotNull())
    out = out.withColumn("bot", bot_field(F.col("key"), 1)).withColumn("category", bot_field(F.col("key"), 2))
    return out.where(F.col("key").isin(keys) | F.lower("bot").isin(keys)) if keys else out


def budget(hits: DataFrame) -> DataFrame:
    """One row a crawler: hits, bytes, exact distinct paths and addresses, rates, first and last seen."""
    path = F.substring_index("uri", "?", 1)
    day = F.date_format("ts", "yyyy-MM-dd")
    out = hits.groupBy("key").agg(
        F.count("*").alias("hits"), F.sum("size").alias("bytes"), F.countDistinct(path).alias("unique_urls"), F.countDistinct(F.nullif("ip", F.lit(""))).alias("distinct_ips"), F.countDistinct(day).alias("days"),
        F.count_if(is_asset(path)).alias("assets"), F.count_if(F.col("status") >= 400).alias("errors"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
    )
    return out.select(
        "key", "hits", F.round(F.col("hits") / F.greatest("days", F.lit(1)), 1).alias("hits_per_day"), F.greatest("days", F.lit(1)).alias("days_seen"), "unique_urls", "distinct_ips", F.round(F.col("bytes") / 1048576, 1).alias("mb"),
        F.round(F.col("assets") / F.col("hits"), 3).alias("asset_share"), F.round(F.col("errors") / F.col("hits"), 4).alias("error_rate"), "first_seen", "last_seen",
    )


def counters(hits: DataFrame, depth: int = 1) -> DataFrame:
    """(key, kind, item, n): each crawler's hits by status, silo, day, agent (120 characters) and, for errors, '<status> <path>'; one pass."""
    path = F.substring_index("uri", "?", 1)
    status = F.col("status").cast("string")
    items = {"status": status, "silo": silo(F.col("uri"), depth), "day": F.date_format("ts", "yyyy-MM-dd"), "agent": F.left("ua", F.lit(120)), "error": F.when(F.col("status") >= 400, F.concat_ws(" ", status, path))}
    each = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), item.alias("item")) for kind, item in items.items()])).alias("x")
    return hits.select("key", each).select("key", "x.*").where("item is not null").groupBy("key", "kind", "item").agg(F.count("*").alias("n"))


def by_category(hits: DataFrame) -> DataFrame:
    """Hits and share of crawler traffic by category, with the fixed order of categories."""
    order = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in (*CATEGORIES, "unknown")]), F.col("category")), F.lit(99))
    counts = hits.groupBy("category").agg(F.count("*").alias("hits"))
    total = counts.agg(F.sum("hits").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("category", "hits", F.round(F.col("hits") / F.col("total"), 3).alias("share"), order.cast("long").alias("ordinal"))


def top_k(df: DataFrame, group: list[str], item: Column, k: int, name: str = "item") -> DataFrame:
    """The k most frequent items of each group; ties by item."""
    counts = df.groupBy(*group, item.alias(name)).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(F.desc("n"), F.asc(name))).cast("long")).where(F.col("rank") <= k)


def spoofed(hits: DataFrame, least: int = 2) -> DataFrame:
    """Addresses that claim crawlers of several companies: operators, crawlers, hits; one row an address."""
    claims = hits.withColumns({"operator": operator_of(F.col("key")), "bot": bot_field(F.col("key"), 1)}).where(F.col("operator").isNotNull() & (F.col("ip") != ""))
    # counted by (address, operator, crawler) first, so that a busy address is a few rows
    each = claims.groupBy("ip", "operator", "bot").agg(F.count("*").alias("n"))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = each.groupBy("ip").agg(F.countDistinct("operator").alias("operator_count"), listed("operator").alias("operators"), listed("bot").alias("crawlers"), F.sum("n").alias("hits"))
    return out.where(F.col("operator_count") >= least)


def spoof_report(flagged: DataFrame, k: int = 25) -> DataFrame:
    """The k worst of spoofed() in order, by operators, hits and address, each with the number of all flagged addresses and of their hits."""
    total = flagged.agg(F.count("*").alias("flagged"), F.sum("hits").alias("spoofed_hits"))
    order = [F.desc("operator_count"), F.desc("hits"), F.asc("ip")]
    worst = flagged.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("long"))  # k rows
    return worst.crossJoin(F.broadcast(total))  # one row


def totals(records: DataFrame) -> DataFrame:
    """Lines, unread share, people, crawlers and the crawlers' share. No line read means no verdict: shares are null."""
    key = bot_key(F.col("ua"))
    out = records.agg(F.count("*").alias("lines"), F.count_if(~F.col("read")).alias("unread"), F.count_if(F.col("read") & key.isNull()).alias("human"), F.count_if(F.col("read") & key.isNotNull()).alias("bots"))
    return out.withColumn("unread_share", F.round(F.try_divide("unread", "lines"), 4)).withColumn("bot_share", F.round(F.try_divide("bots", F.col("bots") + F.col("human")), 3))


def verify(resolved: DataFrame, control: Column | bool = True) -> DataFrame:
    """Whether addresses are whose they claim to be: ip, ptr (list), fwd (list), suffixes (list) -> verdict, verified.

    Null lists could not be asked for; empty ones are an answer. Where the
    control failed, or the operator publishes no names, nothing is told.
    """
    right = F.exists("ptr", lambda p: F.exists(F.col("suffixes"), lambda s: p.endswith(s)))
    verdict = (
        F.when(~F.lit(control) if isinstance(control, bool) else ~control, "control_failed")
        .when(F.size("suffixes") == 0, "unverifiable")
        .when(F.col("ptr").isNull(), "unknown")
        .when(F.size("ptr") == 0, "no_ptr")
        .when(~right, "wrong_name")
        .when(F.col("fwd").isNull(), "unknown")
        .when(F.array_contains("fwd", F.col("ip")), "verified")
        .when(F.size("fwd") == 0, "unproven")
        .otherwise("forward_mismatch")
    )
    known = F.when(verdict == "verified", True).when(verdict.isin("no_ptr", "wrong_name", "forward_mismatch"), False)
    return resolved.select("ip", verdict.alias("verdict"), known.alias("verified"))


def sitemap_gap(crawled: DataFrame, listed: DataFrame) -> DataFrame:
    """(path, state): listed but never crawled, crawled but not listed (assets left out), or both; null paths are left out."""
    c, s = crawled.select("path").distinct(), listed.select("path").distinct()
    never = s.join(c, "path", "left_anti").select("path", F.lit("never_crawled").alias("state"))
    extra = c.join(s, "path", "left_anti").where(~is_asset(F.col("path"))).select("path", F.lit("not_in_sitemap").alias("state"))
    both = s.join(c, "path").select("path", F.lit("crawled").alias("state"))
    return never.unionAll(extra).unionAll(both)
