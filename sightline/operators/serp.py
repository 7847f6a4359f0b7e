"""Result pages: whether they answer the query, how weak they are, and what may be decided from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import relevance_tokens
from ..functions.urls import hostname, registrable, slug_words

#: Domains that are no guide-shaped rivals, and hosts of code.
WEAK = ("reddit.com", "news.ycombinator.com", "stackoverflow.com", "stackexchange.com", "quora.com", "youtube.com", "youtu.be", "gist.github.com", "pastebin.com", "medium.com", "dev.to", "hashnode.dev", "linkedin.com", "facebook.com", "x.com", "twitter.com", "discourse.org", "serverfault.com", "superuser.com", "answers.microsoft.com", "community.spiceworks.com", "tiktok.com")
CODE_HOSTS = ("github.com", "gitlab.com", "readthedocs.io", "npmjs.com", "pypi.org", "crates.io")
LISTICLE = r"(?i)^\s*(?:top\s+)?\d{1,2}\s+(?:best|top|free|great|awesome|essential)\b|\b(?:best|top)\s+\d{1,2}\b"
YEAR = r"\b(20[0-2]\d)\b"
COVERAGE, HIT_RATE = 0.6, 0.3


def shape_ok(results: DataFrame) -> DataFrame:
    """(query, ok): a page without any web address is no result page."""
    return results.groupBy("query").agg(F.coalesce(F.bool_or(F.col("url").startswith("http")), F.lit(False)).alias("ok"))


def relevance(results: DataFrame, top: int | None = 10) -> DataFrame:
    """(query, tokens, coverage, hit_rate, pass, caveat) over each query's ``top`` first results (None: all). Tokens count as parts of words.

    coverage: share of the query's tokens found anywhere; hit_rate: share of results
    with at least half of them, two at least. A query without tokens is not judged.
    """
    first = results if top is None else results.withColumn("rn", F.row_number().over(W.partitionBy("query").orderBy("position"))).where(F.col("rn") <= top)
    blob = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), slug_words("url"), F.coalesce("snippet", F.lit(""))))
    r = first.select("query", relevance_tokens("query").alias("t"), blob.alias("b")).withColumn("got", F.transform("t", lambda t: F.col("b").contains(t).cast("int")))
    need = F.when(F.size("t") >= 2, F.greatest(F.lit(2), F.floor((F.size("t") + 1) / 2))).otherwise(1)
    r = r.withColumn("hit", F.aggregate("got", F.lit(0), lambda a, x: a + x) >= need)
    # by token: is it in any result
    n = F.greatest(F.size("t"), F.lit(1))
    tokens = r.select("query", F.posexplode_outer("got").alias("i", "g")).groupBy("query", "i").agg(F.max("g").alias("g")).groupBy("query").agg(F.sum("g").alias("seen"))
    rates = r.groupBy("query").agg(F.first("t").alias("t"), F.round(F.count_if("hit") / F.count("*"), 3).alias("hit_rate")).join(tokens, "query")
    judged = F.size("t") > 0
    rates = rates.withColumn("coverage", F.when(judged, F.round(F.coalesce("seen", F.lit(0)) / n, 3))).withColumn("hit_rate", F.when(judged, F.col("hit_rate")))
    good = (F.col("coverage") >= COVERAGE) & (F.col("hit_rate") >= HIT_RATE)
    caveat = F.when(judged & ~good & (F.size("t") == 1) & (F.col("coverage") < COVERAGE), "qualifier_ignored").when(judged & ~good & (F.col("coverage") >= 1.0), "low_concentration")
    return rates.select("query", F.size("t").alias("tokens"), "coverage", "hit_rate", (~judged | good | caveat.isNotNull()).alias("pass"), caveat.alias("caveat"))


def tagged(results: DataFrame) -> DataFrame:
    """results with domain, weakness, code_host and the year in the title; listings of code hosts count as neither weak nor strong."""
    domain = registrable(hostname(F.coalesce("url", F.lit(""))))
    title = F.coalesce("title", F.lit(""))
    out = results.withColumn("domain", domain).withColumn("listicle", title.rlike(LISTICLE)).withColumn("code_host", F.col("domain").isin(*CODE_HOSTS))
    return out.withColumn("weak", ~F.col("code_host") & (F.col("domain").isin(*WEAK) | F.col("listicle"))).withColumn("title_year", F.nullif(F.regexp_extract(title, YEAR, 1), F.lit("")).cast("int"))


def scored(results: DataFrame, target: str | None = None) -> DataFrame:
    """One row a query: weak results, candidates for authority and domains on page one, and the target's first place."""
    t = tagged(results)
    ten = F.col("position") <= 10
    mine = registrable(F.lit(target)) if target else F.lit(None).cast("string")
    return t.groupBy("query").agg(
        F.count("*").alias("results"), F.count_if(ten & F.col("weak")).alias("weakness"), F.count_if(ten & ~F.col("weak") & ~F.col("code_host")).alias("authority_candidates"), F.countDistinct(F.when(ten, F.col("domain"))).alias("domains"), F.min(F.when(F.col("domain") == mine, F.col("position"))).alias("target_position"),
    )


def authority_gate(authorities: Column, volume: Column, ceiling: Column, weakness: Column) -> Column:
    """0-2 established authorities approve (a volume ceiling does not matter), 3 are a soft edge, 4 or more reject; weakness never rescues."""
    return F.when(authorities.isNull(), F.lit(None)).when(authorities <= 2, F.when(weakness >= 2, "approve-strong").otherwise("approve")).when(authorities == 3, F.when(ceiling.isNotNull() & (volume > ceiling), "reject").otherwise("soft-edge")).otherwise("reject")


def first_match(results: DataFrame, domain: str) -> DataFrame:
    """(query, position, url): the first result of a domain or its subdomains; null where there is none."""
    host = F.regexp_replace(hostname("url"), r"^www\.", "")
    own = (host == domain) | host.endswith(f".{domain}")
    return results.groupBy("query").agg(F.min(F.when(own, F.col("position"))).alias("position"), F.min_by("url", F.when(own, F.col("position"))).alias("url"))


def fallback(attempts: DataFrame) -> DataFrame:
    """(query, provider): the first provider, in order, whose page had the shape and the relevance."""
    ok = F.col("shape") & F.col("relevant")
    return attempts.groupBy("query").agg(F.min_by("provider", F.when(ok, F.col("ord"))).alias("provider"))


def exits(trials: DataFrame) -> DataFrame:
    """(requested, honoured, verdict, wrong): an exit country counts only if every trial came from it; a wrong country is a lie, errors are not."""
    right = F.col("observed") == F.upper("requested")
    wrong = F.array_join(F.array_sort(F.collect_set(F.when(~right & (F.col("observed") != "ERR"), F.col("observed")))), ",")
    out = trials.groupBy("requested").agg(F.bool_and(right).alias("honoured"), wrong.alias("wrong"))
    return out.withColumn("verdict", F.when(F.col("honoured"), "honoured").when(F.col("wrong") != "", "lies").otherwise("unreliable"))


def probe_state(ok: Column, control: Column) -> Column:
    return F.when(ok.isNull(), "unconfigured").when(~control, "control_failed").when(ok, "usable").otherwise("failing")
