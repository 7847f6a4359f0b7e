"""Search metrics: periods compared, rivals for a query, positions, snapshots of first pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.urls import page_path
from .intervals import overlap_join


def exact_mean(value: str) -> Column:
    """The mean by a sum of decimals, which no order of the rows and no split over tasks changes."""
    return F.sum(F.col(value).cast("decimal(28,10)")).cast("double") / F.count(value)


def rounded(value: Column, digits: int) -> Column:
    """Half away from zero, of the scaled double and not of its shortest decimal form."""
    scale = 10.0**digits
    return F.signum(value) * F.floor(F.abs(value) * scale + 0.5) / scale


def split_dimensions(rows: DataFrame) -> DataFrame:
    """(page, query, day, and the measures) of rows whose keys come in any order: the last URL is the page, a date the day, the first other the query.

    Columns page, url and query serve where the keys have none.
    """
    has = lambda name: F.col(name) if name in rows.columns else F.lit(None).cast("string")
    keys = F.coalesce("keys", F.array().cast("array<string>"))
    is_url = lambda k: k.startswith("http://") | k.startswith("https://")
    is_day = lambda k: k.rlike(r"^\d{4}-\d{2}-\d{2}$")
    page = F.try_element_at(F.filter(keys, is_url), F.lit(-1))
    day = F.try_element_at(F.filter(keys, lambda k: ~is_url(k) & is_day(k)), F.lit(-1))
    other = F.try_element_at(F.filter(keys, lambda k: ~is_url(k) & ~is_day(k)), F.lit(1))
    return rows.select(F.coalesce(page, has("page"), has("url")).alias("page"), F.coalesce(other, has("query")).alias("query"), day.alias("day"), "clicks", "impressions", "position")


def fold(rows: DataFrame, by: list[str]) -> DataFrame:
    """Clicks, impressions and the impression-weighted position (two digits; null without impressions; a null position weighs in as 0)."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    weighted = F.round(F.try_divide(F.sum(zero("position") * zero("impressions")), F.sum(zero("impressions"))), 2)
    return rows.groupBy(*by).agg(F.sum(zero("clicks")).cast("long").alias("clicks"), F.sum(zero("impressions")).cast("long").alias("impressions"), weighted.alias("position"))


def fold_pages(rows: DataFrame, by_query: bool = False) -> DataFrame:
    """fold by normal page path (and query); rows without a page are left out."""
    kept = split_dimensions(rows).where(F.coalesce("page", F.lit("")) != "").withColumn("page", page_path("page"))
    return fold(kept, ["page", "query"] if by_query else ["page"])


def split_periods(rows: DataFrame, day: str, on: str) -> tuple[DataFrame, DataFrame]:
    """Rows before a date, and from it on; rows without a day are left out; an empty side is refused."""
    before, after = rows.where(F.col(day) < on), rows.where(F.col(day) >= on)
    if before.isEmpty() or after.isEmpty():
        raise ValueError(f"no rows on one side of {on}: nothing can be compared")
    return before, after


def compare(previous: DataFrame, current: DataFrame, key: str = "page", published: DataFrame | None = None, previous_start: str | None = None, settle_days: int = 21, least: int = 10, drop: float = 0.3, slip: float = 1.0) -> DataFrame:
    """Full outer comparison of two folded periods: values of both, changes and a verdict.

    new: only now; skipped: too few impressions before; settling: published too
    shortly before the first period; lost; decay: impressions fell and the position
    slipped; demand_drop: they fell and it held; rising; stable. A change is null
    where the earlier value is 0 or unknown.
    """
    p = previous.select(F.col(key), *[F.col(c).alias(f"{c}_before") for c in ("impressions", "clicks", "position")])
    c = current.select(F.col(key), *[F.col(x).alias(f"{x}_after") for x in ("impressions", "clicks", "position")])
    both = p.join(c, key, "full_outer")
    both = both.join(published, key, "left") if published is not None else both.withColumn("published", F.lit(None).cast("string"))
    change = lambda x: F.round(F.try_divide(F.col(f"{x}_after") - F.col(f"{x}_before"), F.nullif(F.col(f"{x}_before"), F.lit(0))), 4)
    both = both.withColumns({"d_impressions": change("impressions"), "d_clicks": change("clicks"), "d_position": F.round(F.col("position_after") - F.col("position_before"), 2)})
    settling = F.datediff(F.to_date(F.lit(previous_start)), F.to_date(F.left("published", F.lit(10)))) < settle_days if previous_start and settle_days else F.lit(False)
    verdict = (
        F.when(F.col("impressions_before").isNull(), "new")
        .when(F.col("impressions_before") < least, "skipped")
        .when(F.coalesce(settling, F.lit(False)), "settling")
        .when(F.coalesce("impressions_after", F.lit(0)) == 0, "lost")
        .when((F.col("d_impressions") <= -drop) & (F.col("d_position") >= slip), "decay")
        .when(F.col("d_impressions") <= -drop, "demand_drop")
        .when(F.col("d_impressions") >= drop, "rising")
        .otherwise("stable")
    )
    return both.withColumn("verdict", verdict)


def verdict_counts(compared: DataFrame) -> DataFrame:
    """One row: counts by verdict, and whether decay looks site-wide (its share is 0.6 or more of at least 8, and some demand fell too)."""
    n = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    out = compared.agg(*[n(v) for v in ("decay", "demand_drop", "rising", "lost", "new", "settling")])
    share = F.try_divide("decay", F.col("decay") + F.col("demand_drop") + F.col("rising"))
    return out.withColumn("site_wide", F.coalesce((share >= 0.6) & (F.col("decay") >= 8) & (F.col("demand_drop") > 0), F.lit(False)))


def cannibals(folded: DataFrame, least: int = 10, worst: float = 20.0) -> DataFrame:
    """Queries that several pages compete for: (query, page, pages, total_impressions, spread).

    The page with most impressions must stand at ``worst`` or better, and so must
    at least one other; a null position counts as none.
    """
    shown = folded.where(F.col("query").isNotNull() & (F.col("query") != "") & (F.col("impressions") >= least))
    order = W.partitionBy("query").orderBy(F.desc("impressions"), "page")
    ranked = shown.withColumn("rn", F.row_number().over(order))
    stands = (F.coalesce("position", F.lit(999.0)) <= worst) & (F.coalesce("position", F.lit(999.0)) > 0)
    top = ranked.where("rn = 1").where(stands).select("query", F.col("page").alias("top_page"), F.col("position").alias("top_position"), F.col("impressions").alias("top_impressions"))
    rivals = ranked.where("rn > 1").where(stands)
    rest = rivals.groupBy("query").agg(F.count("*").alias("n"), F.sum("impressions").alias("more"), F.min_by("position", "rn").alias("next_position"))
    out = top.join(rest, "query")
    return out.select("query", F.col("top_page").alias("page"), (F.col("n") + 1).alias("pages"), (F.col("top_impressions") + F.col("more")).alias("total_impressions"), F.round(F.round(F.abs(F.col("next_position") - F.col("top_position")), 2), 1).alias("spread"))


def overlapping(events: DataFrame, start: str, end: str) -> DataFrame:
    """Calendar rows (date, ended) that touch a window; a null end is the start."""
    last = F.coalesce("ended", "date")
    return events.where(~((last < start) | (F.col("date") > end)))


def in_intervals(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """days joined with the calendar rows (date, ended, name) they fall in, by buckets of time; a null end is the start."""
    number = lambda c: F.unix_date(F.to_date(c)).cast("long")
    points = days.withColumns({"start": number("day"), "end": number("day")})
    spans = calendar.withColumns({"start": number("date"), "end": number(F.coalesce("ended", "date"))})
    return overlap_join(points, spans, []).drop("start", "end", "other_start", "other_end")


def band(position: Column) -> Column:
    return F.when(position.isNull(), "unknown").when(position <= 3, "top3").when(position <= 10, "page1").when(position <= 20, "striking-distance").when(position <= 50, "page3-5").otherwise("deep")


def band_rank(name: Column) -> Column:
    order = ("striking-distance", "page3-5", "page1", "top3", "deep", "unknown")
    return F.coalesce(*[F.when(name == b, F.lit(i)) for i, b in enumerate(order)], F.lit(9))


def low_ctr(position: Column, impressions: Column, ctr: Column) -> Column:
    """Well placed and often shown, yet hardly clicked."""
    return F.coalesce((position <= 10) & (position != 0) & (impressions >= 100) & (F.coalesce(ctr, F.lit(0.0)) < 0.02), F.lit(False))


def shown_on(snapshot: DataFrame) -> DataFrame:
    """(keyword, domain, position): of a domain that stands twice for a keyword, the last one counts."""
    return snapshot.groupBy("keyword", "domain").agg(F.max_by("position", "ord").alias("position"))


def page_one_moves(before: DataFrame, after: DataFrame) -> DataFrame:
    """(keyword, domain, state, move) of keywords read both times: entrant, exit or held; positive moves are losses."""
    b, a = shown_on(before), shown_on(after)
    keywords = b.select("keyword").distinct().join(a.select("keyword").distinct(), "keyword")
    present_b, present_a = F.col("in_b").isNotNull(), F.col("in_a").isNotNull()
    both = b.withColumn("in_b", F.lit(True)).withColumnRenamed("position", "was").join(a.withColumn("in_a", F.lit(True)).withColumnRenamed("position", "now"), ["keyword", "domain"], "full_outer").join(keywords, "keyword", "left_semi")
    state = F.when(present_b & present_a, "held").when(present_a, "entrant").otherwise("exit")
    return both.select("keyword", "domain", state.alias("state"), (F.col("now") - F.col("was")).alias("move"))


def churn(moves: DataFrame) -> DataFrame:
    """(keyword, churn): one less the share of domains held among all."""
    return moves.groupBy("keyword").agg(F.round(1 - F.count_if(F.col("state") == "held") / F.count("*"), 3).alias("churn"))


def drift_verdict(churns: DataFrame, high: float = 0.4) -> DataFrame:
    out = churns.agg(F.count("*").alias("keywords"), F.round(F.avg("churn"), 3).alias("mean_churn"), F.max("churn").alias("most"))
    return out.withColumn("verdict", F.when(F.col("keywords") == 0, F.lit(None)).when(F.col("mean_churn") >= high, "SITE-WIDE").when(F.col("most") >= high, "LOCALISED").otherwise("STABLE"))


def recurring(moves: DataFrame, state: str, top: int = 10) -> DataFrame:
    """Domains that entered (or left) several keywords, the most frequent first (a top-k report)."""
    counts = moves.where(F.col("state") == state).groupBy("domain").agg(F.count("*").alias("keywords")).where("keywords > 1")
    return counts.orderBy(F.desc("keywords"), "domain").limit(top)


def one_sided(before: DataFrame, after: DataFrame) -> DataFrame:
    """(keyword, side): keywords that only one snapshot has."""
    b, a = before.select("keyword").distinct(), after.select("keyword").distinct()
    return b.join(a, "keyword", "left_anti").withColumn("side", F.lit("before")).unionAll(a.join(b, "keyword", "left_anti").withColumn("side", F.lit("after")))
