"""State of a programme: queues, rank logs, authority, trends, pacing and what to do next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Zones of a site's rating: rating from, auto approval below, pending below, volume floor, ceiling, soft edge.
ZONES = ((35, 35, 45, 500, None, None), (20, 25, 35, 300, 3000, 6000), (10, 15, 25, 200, 1500, 3000), (0, 10, 20, 100, 800, 1500))


def zone(rating: Column) -> Column:
    """struct of thresholds; an unknown rating counts as 0."""
    names = ("auto_below", "pending_below", "floor", "ceiling", "soft_edge")
    r = F.coalesce(rating, F.lit(0))
    pick = lambda z: F.struct(*[F.lit(v).cast("int").alias(n) for n, v in zip(names, z[1:], strict=True)])
    out = pick(ZONES[-1])
    for z in reversed(ZONES[:-1]):
        out = F.when(r >= z[0], pick(z)).otherwise(out)
    return out


def latest(df: DataFrame, keys: list[str], when: str, order: str) -> DataFrame:
    """The newest row of each key; of equals the first in ``order``. Two aggregates in one pass, no window over a hot key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(when), -F.col(order))).alias("r")).select(*keys, "r.*")


def rank_history(ranks: DataFrame, keep: int = 30) -> DataFrame:
    """One row a keyword: latest, best, first known, change (positive is better), checks, and the last ``keep`` readings.

    ``ranks`` has keyword, at, ord and position (null: not found).
    """
    order = F.struct("at", "ord")
    known = F.when(F.col("position").isNotNull(), order)
    newest = W.partitionBy("keyword").orderBy(F.desc("at"), F.desc("ord"))
    tail = ranks.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= keep).groupBy("keyword").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "ord", "position"))), lambda x: F.coalesce(x["position"].cast("string"), F.lit("-"))), " ").alias("history"))
    out = ranks.groupBy("keyword").agg(F.max_by("position", order).alias("latest"), F.min("position").alias("best"), F.min_by("position", known).alias("first_known"), F.count("*").alias("checks"), F.max("at").alias("last_checked"))
    return out.withColumn("delta", F.col("first_known") - F.col("latest")).join(tail, "keyword")


def nulls_last(df: DataFrame, column: str, *more: str) -> DataFrame:
    return df.orderBy(F.asc_nulls_last(column), *more)


#: Positioned rows first, by position, then by age.
def queue_keys() -> list[Column]:
    return [F.asc_nulls_last("queue_position"), F.asc("created_at"), F.asc("id")]


def queue_order(df: DataFrame) -> DataFrame:
    return df.orderBy(*queue_keys())


def to_front(df: DataFrame, ids: list[str]) -> DataFrame:
    """The named rows get places 1, 2, ...; all others lose theirs."""
    places = F.create_map(*[F.lit(x) for i, k in enumerate(ids) for x in (k, i + 1)]) if ids else F.create_map().cast("map<string,int>")
    return df.withColumn("queue_position", F.try_element_at(places, F.col("id")))


def looked_up(df: DataFrame, idents: DataFrame) -> DataFrame:
    """(ident, id): the row that each identifier means: id, else the start of one (4 characters or more), else slug or title, else keyword or domain; of equals the first by ``ord``.

    A row is put under all that it may be called by, with the step of the ladder, so that identifiers meet rows by equality.
    """
    starts = F.transform(F.sequence(F.lit(4), F.greatest(F.length("id"), F.lit(4))), lambda n: F.left(F.col("id"), n))
    low = lambda *names: F.array(*[F.lower(n) for n in names])
    called = F.array(F.struct(F.lit(0).alias("step"), F.array("id").alias("names")), F.struct(F.lit(1).alias("step"), F.when(F.length("id") >= 4, starts).otherwise(F.array().cast("array<string>")).alias("names")), F.struct(F.lit(2).alias("step"), F.array("slug", F.lower("title")).alias("names")), F.struct(F.lit(3).alias("step"), low("keyword", "domain").alias("names")))
    names = df.select("id", "ord", F.inline(called)).select("id", "ord", "step", F.explode("names").alias("name")).where("name IS NOT NULL")
    asked = idents.select("ident", F.inline(F.array(*[F.struct(F.lit(k).alias("step"), (F.col("ident") if k < 2 else F.lower(F.trim("ident"))).alias("name")) for k in range(4)])))
    hit = asked.join(names, ["step", "name"]).groupBy("ident").agg(F.min_by("id", F.struct("step", "ord")).alias("id"))
    return idents.join(hit, "ident", "left")


def slug_matches(pages: DataFrame, stems: DataFrame) -> DataFrame:
    """(stem, keyword): of the first page, by ``ord``, whose slug is the stem, or ends with it after a slash, or is its end; null without one.

    Ends are written out, so that both sides meet by equality.
    """
    asked = stems.select("stem").distinct()
    ends = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.substring(c, i, F.length(c)))
    of_stem = asked.select("stem", F.explode(ends(F.col("stem"))).alias("slug")).join(pages, "slug").select("stem", "ord", "keyword")
    parts = F.split("slug", "/")
    after = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    of_slug = pages.where(F.size(parts) > 1).select("ord", "keyword", F.explode(after).alias("stem")).join(asked, "stem").select("stem", "ord", "keyword")
    first = of_stem.unionByName(of_slug).groupBy("stem").agg(F.min_by("keyword", "ord").alias("keyword"))
    return asked.join(first, "stem", "left")


def coerced_status(requested: Column, kind: Column, source: Column, mode: str, auto_tools: bool) -> Column:
    """An approval that waits for the owner becomes pending: gated tools, agents in semi mode, trends always."""
    waits = (F.lit(not auto_tools) & (kind == "tool") & (source != "manual")) | (F.lit(mode == "semi") & source.isin("research", "trend-scan", "geo-scan", "backstop")) | (source == "trend-scan")
    return F.when((requested == "approved") & F.coalesce(waits, F.lit(False)), "pending").otherwise(requested)


def age_flags(df: DataFrame, today: str, settle: int = 21, stale: int = 14) -> DataFrame:
    """days since a date column ``day``, whether settled, and whether stale; unknown dates are neither."""
    age = F.greatest(F.datediff(F.to_date(F.lit(today)), F.to_date("day")), F.lit(0))
    return df.withColumn("age", age).withColumn("settled", F.coalesce(age >= settle, F.lit(False))).withColumn("stale", F.coalesce(age > stale, F.lit(False)))


def visibility(reads: DataFrame) -> DataFrame:
    """Per engine: queries, answers, citations and their rate among answers (null without any)."""
    out = reads.groupBy("engine").agg(F.count("*").alias("queries"), F.count_if("answered").alias("with_answer"), F.count_if("cited").alias("cited"))
    return out.withColumn("citation_rate", F.round(F.try_divide("cited", "with_answer"), 3))


def gap_domains(reads: DataFrame) -> DataFrame:
    """Who is cited where we are not."""
    return reads.where(F.col("answered") & ~F.col("cited")).select(F.explode("citations").alias("domain")).groupBy("domain").agg(F.count("*").alias("n"))


def pacing(pages: DataFrame, today: str) -> DataFrame:
    """Days since the last publication, and how many there were in the last seven."""
    day = F.to_date("day")
    return pages.agg(F.datediff(F.to_date(F.lit(today)), F.max(day)).cast("long").alias("days_since"), F.count_if((day > F.date_sub(F.to_date(F.lit(today)), 7)) & (day <= F.to_date(F.lit(today)))).alias("last_week"))


def half_trend(series: DataFrame, percent: float = 10.0) -> DataFrame:
    """Average of the later half against the earlier one, by key; null without an earlier average.

    The half of an odd series goes to the later part.
    """
    w = W.partitionBy("key")
    r = series.withColumn("rn", F.row_number().over(w.orderBy("at"))).withColumn("n", F.count("*").over(w)).withColumn("early", F.col("rn") <= F.floor(F.col("n") / 2))
    out = r.groupBy("key").agg(F.count("*").alias("points"), F.avg(F.when(F.col("early"), F.col("value"))).alias("a"), F.avg(F.when(~F.col("early"), F.col("value"))).alias("b"))
    change = F.round(F.try_divide(F.col("b") - F.col("a"), F.nullif("a", F.lit(0.0))) * 100, 1)
    out = out.withColumn("change_pct", change)
    news = F.when(F.col("b") > F.coalesce("a", F.lit(0.0)) * 1.2, "rising").when(F.col("b") < F.coalesce("a", F.lit(0.0)) * 0.8, "falling").otherwise("flat")
    return out.select("key", "points", "change_pct", F.when(F.col("change_pct") > percent, "rising").when(F.col("change_pct") < -percent, "falling").when(F.col("change_pct").isNotNull(), "flat").alias("direction"), news.alias("news_direction"))


def composite(days: Column, pages: Column, impressions: Column, clicks: Column) -> Column:
    """An estimate of authority from what is known, at most 25; unknown terms add nothing."""
    terms = [F.least(F.lit(10.0), days / 365.25 * 2), F.least(F.lit(8.0), F.sqrt(pages) / 2), F.least(F.lit(9.0), F.sqrt(impressions / 1000) * 2), F.least(F.lit(6.0), F.sqrt(clicks / 100) * 2)]
    total = F.lit(0.0)
    for t in terms:
        total = total + F.coalesce(t, F.lit(0.0))
    return F.least(F.lit(25.0), F.round(total, 0))


def year_trend(history: DataFrame, band: float = 0.05) -> DataFrame:
    """(key, delta, direction): the newest value against the thirteenth from the end; fewer points are no trend, which is not a flat one."""
    known = history.where(F.col("value").isNotNull())
    w = W.partitionBy("key").orderBy(F.desc("at"))
    tail = known.withColumn("rn", F.row_number().over(w)).where("rn in (1, 13)")
    out = history.select("key").distinct().join(tail.groupBy("key").agg(F.max(F.when(F.col("rn") == 1, F.col("value"))).alias("now"), F.max(F.when(F.col("rn") == 13, F.col("value"))).alias("then")), "key", "left")
    delta = F.round(F.col("now") - F.col("then"), 2)
    return out.select("key", delta.alias("delta"), F.when(delta > band, "rising").when(delta < -band, "falling").when(delta.isNotNull(), "flat").alias("direction"))


def popularity(ranks: DataFrame) -> DataFrame:
    """Oldest against newest known rank; a lower rank is better."""
    out = ranks.where(F.col("rank").isNotNull()).groupBy("key").agg(F.min_by("rank", "at").alias("then"), F.max_by("rank", "at").alias("now"), F.count("*").alias("days"))
    d = F.col("then") - F.col("now")
    return out.select("key", "now", "then", "days", d.alias("change"), F.when(d > 0, "improving").when(d < 0, "declining").otherwise("flat").alias("direction"))


def reconcile(requested: DataFrame, returned: DataFrame) -> DataFrame:
    """(domain, answered_for, rank, no_data): each asked domain with its own answer, else that of its nearest parent, never the bare top level."""
    labels = F.split(F.lower("domain"), r"\.")
    options = F.transform(F.sequence(F.lit(0), F.greatest(F.size(labels) - 2, F.lit(0))), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(labels, i + 1, 99), ".").alias("name")))
    asked = requested.select("domain", F.inline(options))
    known = returned.groupBy(F.lower("domain").alias("name")).agg(F.max_by("rank", "ord").alias("rank"))
    hit = asked.join(known, "name").groupBy("domain").agg(F.min_by(F.struct(F.col("name").alias("answered_for"), "rank"), "depth").alias("h"))
    return requested.join(hit, "domain", "left").select("domain", "h.answered_for", "h.rank", F.col("h").isNull().alias("no_data"))


def ladder(df: DataFrame, sources: list[str]) -> DataFrame:
    """The first source, in order, that has a rating."""
    name = F.coalesce(*[F.when(F.col(s).isNotNull(), F.lit(s)) for s in sources])
    return df.withColumn("source", name).withColumn("rating", F.coalesce(*[F.col(s) for s in sources]))


def merge_sources(first: DataFrame, second: DataFrame, ties: list[str] | None = None) -> DataFrame:
    """Works of two sources, one row a bare DOI, else a title of 80 characters; the first source's row stays. Rows of one place go by the columns ``ties``."""
    both = first.withColumn("ord", F.lit(0)).unionByName(second.withColumn("ord", F.lit(1)))
    doi = F.nullif(F.regexp_replace(F.lower(F.trim("doi")), r"^(?:https?://(?:dx\.)?doi\.org/|doi:)", ""), F.lit(""))
    keyed = both.withColumn("key", F.coalesce(doi, F.left(F.lower("title"), F.lit(80))))
    rest = [c for c in first.columns]
    return keyed.groupBy("key").agg(F.min_by(F.struct(*rest), F.struct("ord", "place", *(ties or []))).alias("r")).select("key", "r.*")


def coverage(concepts: DataFrame, words: DataFrame, stop: tuple[str, ...]) -> DataFrame:
    """(concept, tokens, matched): title words of over three letters that a draft uses; concepts without any are left out."""
    tokens = F.filter(F.regexp_extract_all(F.lower("concept"), F.lit(r"[a-z0-9']+"), F.lit(0)), lambda t: (F.length(t) > 3) & ~F.array_contains(F.array(*map(F.lit, stop)), t))
    each = concepts.select("concept", F.explode(tokens).alias("word"))
    return each.join(words.select("word", F.lit(1).alias("has")).distinct(), "word", "left").groupBy("concept").agg(F.count("*").alias("tokens"), F.count("has").alias("matched"))


def archive_windows(captures: DataFrame, since: str, limit: int) -> DataFrame:
    """Versions since a day, first and last; a list cut at its limit is reliable only if it starts before the day."""
    day = since.replace("-", "")
    out = captures.groupBy("url").agg(F.count("*").alias("versions"), F.count_if(F.col("ts") >= day).alias("since"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return out.withColumn("truncated", F.col("versions") >= limit).withColumn("reliable", ~F.col("truncated") | (F.col("first") <= day))


def last_reading_sum(readings: DataFrame) -> DataFrame:
    """Per hour: the sum of each entity's last reading in it. Summing every poll would count an entity many times."""
    last = readings.groupBy(F.date_trunc("hour", "ts").alias("hour"), "entity").agg(F.max_by("value", F.struct("ts", "ord")).alias("value"))
    return last.groupBy("hour").agg(F.count("*").alias("entities"), F.round(F.sum("value"), 4).alias("total"))


def pending_batches(pages: DataFrame, size: int = 500) -> DataFrame:
    """(url, batch): web pages without a stamp, each once, in batches of ``size`` in the order of their addresses."""
    from .similarity import number_rows

    todo = pages.where(F.col("stamp").isNull() & F.col("url").startswith("http")).select("url").distinct()
    return number_rows(todo, "url").select("url", F.floor(F.col("__i") / size).alias("batch"))


def proposals(new: DataFrame, queue: DataFrame) -> DataFrame:
    """New rows whose keyword no row of the queue has that is not rejected."""
    taken = queue.where("status <> 'rejected'").select(F.lower("keyword").alias("k")).distinct()
    return new.join(taken, F.lower(new["keyword"]) == F.col("k"), "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New values win where they are known; other rows stay."""
    columns = [c for c in old.columns if c != key]
    n = new.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    return old.join(n, key, "full_outer").select(key, *[F.coalesce(f"__{c}", c).alias(c) for c in columns])


def next_actions(queue: DataFrame, pages: DataFrame, mode: str, rated: bool, set_up: bool = True) -> DataFrame:
    """(priority, action) of the rules that hold over the state tables, by priority then name; ``set_up`` tells whether the programme's conventions are written down."""
    n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    kind, status = F.col("type"), F.col("status")
    q = queue.agg(
        n((kind == "guide") & (status == "approved")).alias("guides"), n((kind == "guide") & (status == "pending")).alias("guides_pending"), n((kind == "tool") & status.isin("approved", "pending")).alias("tools"), n((kind == "tool") & (status == "approved")).alias("tools_ready"), n((status == "in_progress") & (F.col("idle_days") > 1)).alias("stuck"),
    )
    p = pages.agg(F.count("*").alias("pages"), n(F.col("url").isNotNull() & F.col("pinged").isNull()).alias("unpinged"), n(F.col("url").isNotNull() & F.col("requested").isNull()).alias("unrequested"))
    c = F.col
    rules = [
        (1, "run the setup", F.lit(not set_up)), (1, "reset stuck builds", c("stuck") > 0), (2, "research guides", c("guides") < 7), (2, "research tools", c("tools") < 1), (3, "review pending guides", F.lit(mode == "semi") & (c("guides_pending") > 0)), (3, "build the next guide", c("guides") > 0), (4, "build the next tool", c("tools_ready") > 0),
        (4, "ping search engines", c("unpinged") > 0), (5, "first publication", c("pages") == 0), (5, "request indexing", c("unrequested") > 0), (5, "refresh authority", F.lit(not rated)),
    ]
    found = F.filter(F.array(*[F.when(cond, F.struct(F.lit(k).alias("priority"), F.lit(a).alias("action"))) for k, a, cond in rules]), lambda x: x.isNotNull())
    return q.crossJoin(p).select(F.inline(found)).orderBy("priority", "action")  # one row each


def length_contract(df: DataFrame) -> DataFrame:
    """Whether tagline, short and long text keep their lengths."""
    return df.select("id", (F.length("tagline") <= 60).alias("tagline_ok"), (F.length("short") <= 160).alias("short_ok"), F.length("long").between(300, 600).alias("long_ok"))


def setting(text: Column) -> Column:
    """A typed setting as JSON text: true, false, null and numbers as they are, others as strings."""
    plain = F.trim(text)
    return F.when(F.lower(plain).isin("true", "false", "null"), F.lower(plain)).when(plain.rlike(r"^-?\d+(\.\d+)?$"), plain).when(plain.rlike(r"^[\[{]"), plain).otherwise(F.concat(F.lit('"'), plain, F.lit('"')))


def retired_types(types: DataFrame) -> DataFrame:
    """(type, retired): structured-data types whose results were retired; information, never a fault."""
    known = F.create_map(*[F.lit(x) for kv in RETIRED.items() for x in kv])
    bare = F.substring_index(F.substring_index("type", "/", -1), "#", -1)
    return types.select(bare.alias("type"), F.try_element_at(known, bare).alias("retired")).where(F.col("retired").isNotNull() | (F.col("type") == "Dataset"))


#: When results of a type were retired.
RETIRED = {"FAQPage": "2026-05-07", "HowTo": "2023-09", "ClaimReview": "2025-06-12", "VehicleListing": "2025-06-12", "EstimatedSalary": "2025-06-12", "OccupationalAggregateRating": "2025-06-12", "SpecialAnnouncement": "2025-07-31", "LearningVideo": "2025-06-12", "PracticeProblem": "2026-01"}


def facet_score(rows: DataFrame) -> DataFrame:
    """Per facet: candidates within band and ceiling, and their upper median volume; without volumes, those with two authorities or fewer."""
    paid = (F.col("volume") >= F.col("floor")) & (F.col("ceiling").isNull() | (F.col("volume") <= F.col("ceiling"))) & (F.col("kd") <= F.col("most_kd"))
    ok = F.coalesce(F.when(F.col("volume").isNull(), F.col("authorities") <= 2).otherwise(paid), F.lit(False))
    w = W.partitionBy("facet")
    kept = rows.where(ok).withColumn("rn", F.row_number().over(w.orderBy("volume"))).withColumn("n", F.count("*").over(w))
    return kept.groupBy("facet").agg(F.count("*").alias("candidates"), F.max(F.when(F.col("rn") == F.floor(F.col("n") / 2) + 1, F.col("volume"))).alias("median_volume"))
