"""Markup contracts: rules between two snapshots of a page, and the life of their findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import normal_url
from .markup import fired


def _indexable(p: str) -> Column:
    blob = F.lower(F.concat_ws(" ", f"{p}.meta_robots", f"{p}.header_robots"))
    return ~(blob.contains("noindex") | blob.contains("none"))


def rules() -> list[tuple[str, str, Column]]:
    """(severity, rule, condition) over structs ``o`` (old) and ``n`` (new); a page that is not 200 both times trips only the first kind."""
    o, n = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"n.{c}"))
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    differ = lambda c: ~o(c).eqNullSafe(n(c))
    ok_o, ok_n = F.coalesce(o("status") == 200, F.lit(False)), F.coalesce(n("status") == 200, F.lit(False))
    self_n = normal_url(n("canonical")) == normal_url(n("url"))
    self_o = normal_url(o("canonical")) == normal_url(o("url"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    shrank = (zero(o("words")) >= 150) & (zero(n("words")) < zero(o("words")) * 0.7)
    redirect = F.coalesce(n("status").between(300, 399), F.lit(False))
    lost, gained = F.array_except(o("schema_types"), n("schema_types")), F.array_except(n("schema_types"), o("schema_types"))
    both = [
        ("critical", "noindex_added", _indexable("o") & ~_indexable("n")), ("info", "noindex_removed", ~_indexable("o") & _indexable("n")),
        ("critical", "canonical_removed", some(o("canonical")) & ~some(n("canonical"))),
        ("critical", "canonical_changed", differ("canonical") & some(n("canonical")) & ~self_n), ("warning", "canonical_changed", differ("canonical") & some(n("canonical")) & self_n),
        ("critical", "canonical_now_points_elsewhere", some(n("canonical")) & ~self_n & some(o("canonical")) & self_o),
        ("critical", "title_removed", some(o("title")) & ~some(n("title"))), ("warning", "title_changed", differ("title") & ~(some(o("title")) & ~some(n("title")))),
        ("warning", "description_removed", some(o("description")) & ~some(n("description"))), ("info", "description_changed", differ("description") & ~(some(o("description")) & ~some(n("description")))),
        ("critical", "h1_removed", (zero(o("h1_count")) > 0) & (zero(n("h1_count")) == 0)), ("warning", "h1_changed", ~((zero(o("h1_count")) > 0) & (zero(n("h1_count")) == 0)) & (F.size("o.h1") > 0) & (F.size("n.h1") > 0) & differ("h1")),
        ("critical", "schema_removed", F.size(lost) > 0), ("info", "schema_added", F.size(gained) > 0),
        ("critical", "hreflang_removed", (zero(o("hreflang_count")) > 0) & (zero(n("hreflang_count")) == 0)),
        ("warning", "hreflang_count_changed", (zero(o("hreflang_count")) > 0) & (zero(n("hreflang_count")) > 0) & (F.abs(n("hreflang_count") - o("hreflang_count")) >= F.greatest(F.lit(2), F.round(o("hreflang_count") * 0.25)))),
        ("warning", "content_shrank", shrank), ("info", "content_changed", ~shrank & (zero(o("words")) > 0) & (zero(n("words")) > 0) & differ("body_hash")),
        ("warning", "og_tag_removed", F.size(F.array_except("o.og", "n.og")) > 0), ("warning", "internal_links_dropped", (zero(o("internal_links")) >= 10) & (zero(n("internal_links")) < zero(o("internal_links")) * 0.5)),
    ]
    return [
        ("critical", "page_now_redirects", ok_o & redirect), ("critical", "page_now_unavailable", ok_o & ~ok_n & ~redirect), ("info", "page_recovered", ~ok_o & ok_n),
        *[(s, r, ok_o & ok_n & F.coalesce(c, F.lit(False))) for s, r, c in both],
    ]


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """(url, severity, rule) of pages in both snapshots; a page that one of them lacks is not judged."""
    o = old.select("url", F.struct(*old.columns).alias("o"))
    n = new.select("url", F.struct(*new.columns).alias("n"))
    return fired(o.join(n, "url"), ["url"], rules())


def outage(old: DataFrame, new: DataFrame, limit: float = 0.34) -> DataFrame:
    """One row: pages that were well, those failing now, and whether a verdict is refused because too many fail at once."""
    joined = old.where("status = 200").select("url").join(new.select("url", F.col("status").alias("now")), "url")
    return outage_of(joined, limit)


def outage_of(now: DataFrame, limit: float = 0.34) -> DataFrame:
    """The same from pages that were well, with their status ``now``."""
    out = now.agg(F.count("*").alias("were_ok"), F.count_if(~F.col("now").eqNullSafe(F.lit(200))).alias("failing"))
    return out.withColumn("refused", F.coalesce(F.try_divide("failing", "were_ok") > limit, F.lit(False)))


def lifecycle(prior: DataFrame, current: DataFrame, at: str) -> DataFrame:
    """The findings after a check: (path, rule, severity, state, first_seen, last_seen, seen_count, resolved_at, event).

    A current finding opens, stays open (seen once more) or opens again with a
    new first date; an open one that no longer shows is resolved; others stay.
    """
    p = prior.select("path", "rule", *[F.col(c).alias(f"p_{c}") for c in ("severity", "state", "first_seen", "last_seen", "seen_count", "resolved_at")])
    c = current.select("path", "rule", F.col("severity").alias("c_severity")).dropDuplicates(["path", "rule"])
    j = c.withColumn("now", F.lit(True)).join(p.withColumn("was", F.lit(True)), ["path", "rule"], "full_outer")
    now, is_open = F.col("now").isNotNull(), F.coalesce(F.col("p_state") == "open", F.lit(False))
    event = F.when(now & is_open, "still_open").when(now, "opened").when(is_open, "resolved").otherwise("unchanged")
    pick = lambda opened, still, resolved, other: F.when(event == "opened", opened).when(event == "still_open", still).when(event == "resolved", resolved).otherwise(other)
    p_, day, none = (lambda x: F.col(f"p_{x}")), F.lit(at), F.lit(None).cast("string")
    return j.select(
        "path", "rule", F.coalesce("c_severity", "p_severity").alias("severity"), pick(F.lit("open"), F.lit("open"), F.lit("resolved"), p_("state")).alias("state"), pick(day, p_("first_seen"), p_("first_seen"), p_("first_seen")).alias("first_seen"),
        pick(day, day, p_("last_seen"), p_("last_seen")).alias("last_seen"), pick(F.lit(1), p_("seen_count") + 1, p_("seen_count"), p_("seen_count")).cast("long").alias("seen_count"), pick(none, none, day, p_("resolved_at")).alias("resolved_at"), event.alias("event"),
    )


def resolve(findings: DataFrame, path: str, rule: str, at: str) -> DataFrame:
    """Closes one open finding by hand."""
    mine = (F.col("path") == path) & (F.col("rule") == rule) & (F.col("state") == "open")
    return findings.withColumn("resolved_at", F.when(mine, F.lit(at)).otherwise(F.col("resolved_at"))).withColumn("state", F.when(mine, "resolved").otherwise(F.col("state")))


def severity_counts(findings: DataFrame, failing: tuple[str, ...] = ("critical",)) -> DataFrame:
    """One row: findings by severity, and fail, warn or pass."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(s)
    out = findings.agg(*[n(s) for s in ("critical", "high", "warning", "medium", "low", "info")], F.count("*").alias("total"))
    return out.withColumn("verdict", F.when(sum((F.col(s) for s in failing), F.lit(0)) > 0, "fail").when(F.col("total") > 0, "warn").otherwise("pass"))


def open_history(findings: DataFrame) -> DataFrame:
    """Open findings by severity, and the last day any was seen."""
    return findings.where("state = 'open'").groupBy("severity").agg(F.count("*").alias("open"), F.max("last_seen").alias("last_seen"))
