"""Crawler policies: robots groups, who may read what, and llms.txt checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .markup import fired


def robots_rules(bodies: DataFrame, key: str, body: str = "body") -> DataFrame:
    """(key, grp, agent, field, pattern, place): one row an agent and rule of its group; agents without rules have null ones.

    Consecutive User-agent lines share the rules that follow; rules before any
    of them are dropped. A file is small, so its lines meet in one group of its key.
    """
    lines = bodies.select(key, F.posexplode(F.split(body, r"\r\n|\r|\n")).alias("place", "raw")).withColumn("line", F.trim(F.regexp_replace("raw", r"#.*$", ""))).where(F.col("line").contains(":"))
    fields = lines.select(key, "place", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("field"), F.trim(F.regexp_replace("line", r"^[^:]*:", "")).alias("value")).where(F.col("field").isin("user-agent", "allow", "disallow"))
    order = W.partitionBy(key).orderBy("place")
    starts = (F.col("field") == "user-agent") & F.coalesce(F.lag("field").over(order) != "user-agent", F.lit(True))
    grouped = fields.withColumn("starts", starts.cast("int")).withColumn("grp", F.sum("starts").over(order.rowsBetween(W.unboundedPreceding, 0))).where("grp > 0")
    agents = grouped.where("field = 'user-agent'").select(key, "grp", F.lower("value").alias("agent")).distinct()
    rules = grouped.where("field <> 'user-agent'").select(key, "grp", "field", F.col("value").alias("pattern"), "place")
    return agents.join(rules, [key, "grp"], "left")


def resolve(rules: DataFrame, asks: DataFrame, key: str) -> DataFrame:
    """(key, bot, path, allowed, agent) for asks (key, bot, path).

    The longest agent that the bot's name contains wins, '*' is the weakest and the
    first of equals counts; within its group the longest matching pattern, a tie
    going to allow. Empty patterns never match; without a match all is allowed.
    """
    agents = rules.select(key, "grp", "agent").distinct()
    low = F.lower("bot")
    fits = asks.join(agents, key, "left").withColumn("weight", F.when(F.col("agent") == "*", 0).when(low.contains(F.col("agent")) & (F.col("agent") != ""), F.length("agent")))
    best = fits.groupBy(key, "bot", "path").agg(F.max_by(F.struct("grp", "agent"), F.when(F.col("weight").isNotNull(), F.struct("weight", -F.col("grp")))).alias("b"))
    chosen = best.select(key, "bot", "path", "b.grp", "b.agent")
    escaped = F.regexp_replace("pattern", r"([.^$+?{}()|\[\]\\])", r"\\$1")
    pattern = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(escaped, r"\*", ".*"), r"\\\$$", r"\$"))
    own = rules.where(F.coalesce("pattern", F.lit("")) != "").select(key, "grp", "field", "pattern", pattern.alias("rx")).distinct()
    hits = chosen.join(own, [key, "grp"], "left").withColumn("rank", F.when(F.regexp_like("path", F.col("rx")), F.struct(F.length("pattern"), F.when(F.col("field") == "allow", 1).otherwise(0))))
    return hits.groupBy(key, "bot", "path").agg(F.max_by("field", "rank").alias("field"), F.max("agent").alias("agent")).select(key, "bot", "path", F.coalesce(F.col("field") == "allow", F.lit(True)).alias("allowed"), "agent")


def class_summary(resolved: DataFrame, key: str) -> DataFrame:
    """Allowed and all crawlers by category."""
    return resolved.groupBy(key, "category").agg(F.count_if("allowed").alias("allowed"), F.count("*").alias("total"))


def policy_findings(bodies: DataFrame, summary: DataFrame, key: str) -> DataFrame:
    """(key, severity, rule) of robots files that were read (status 200); a failed read has no verdict at all."""
    n = lambda cat, what: F.coalesce(F.sum(F.when(F.col("category") == cat, F.col(what))), F.lit(0)).alias(f"{cat}_{what}")
    wide = summary.groupBy(key).agg(*[n(c, w) for c in ("ai_search", "ai_user", "ai_training") for w in ("allowed", "total")])
    j = bodies.where("status = 200").join(wide, key, "left").na.fill(0)
    c, body = F.col, F.col("body")
    blocked = (c("ai_search_total") > 0) & (c("ai_search_allowed") == 0)
    return fired(
        j, [key],
        [
            ("critical", "robots_is_html", F.ltrim(body).startswith("<")), ("critical", "ai_search_fully_blocked", blocked), ("high", "ai_search_partially_blocked", ~blocked & (c("ai_search_allowed") < c("ai_search_total"))), ("critical", "farmed_not_read", blocked & (c("ai_training_allowed") > 0)),
            ("high", "ai_user_blocked", c("ai_user_allowed") < c("ai_user_total")), ("medium", "no_sitemap_directive", ~body.rlike(r"(?im)^[ \t]*sitemap:[ \t]*\S+")), ("high", "robots_too_large", F.octet_length(body) > 500 * 1024), ("medium", "unsupported_directive", body.rlike(r"(?im)^[ \t]*(noindex|nofollow)[ \t]*:")),
        ],
    )


def llms_findings(files: DataFrame, key: str) -> DataFrame:
    """(key, severity, rule) of llms.txt files (status, ctype, body)."""
    body, ok = F.coalesce("body", F.lit("")), F.coalesce(F.col("status") == 200, F.lit(False))
    html = F.coalesce(F.col("ctype").contains("html"), F.lit(False)) | F.ltrim(body).startswith("<")
    return fired(
        files, [key],
        [
            ("high", "llms_txt_is_html", ok & html), ("medium", "llms_txt_no_h1", ok & ~html & ~body.rlike(r"^\s*#\s+\S")), ("low", "llms_txt_no_summary", ok & ~html & ~body.rlike(r"(?m)^[ \t]*>[ \t]+\S")), ("medium", "llms_txt_no_links", ok & ~html & ~body.rlike(r"\[[^\]]*\]\([^)]+\)")), ("low", "no_llms_txt", ~ok),
        ],
    )
