"""Queries of search metrics, first-page drift and keywords."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import keywords as K
from ..operators import search_metrics as M
from .registry import Derived, query, table

METRICS = Derived(
    "clicks",
    "CASE WHEN click_id % 2 = 0 THEN 'prev' ELSE 'cur' END AS period",
    """CASE click_id % 5 WHEN 0 THEN ARR('https://a.b/p' || CAST(client_id % 300 AS STRING) || '/', 'rank tracker') WHEN 1 THEN ARR('rank tracker', 'https://a.b/p' || CAST(client_id % 300 AS STRING)) WHEN 2 THEN ARR('2025-01-01', 'https://a.b/p' || CAST(client_id % 300 AS STRING)) WHEN 3 THEN ARR('x') ELSE ARR('no page') END AS keys""",
    "CASE WHEN click_id % 5 = 3 THEN 'https://a.b/q' || CAST(client_id % 300 AS STRING) END AS page",
    "CASE WHEN click_id % 5 = 2 THEN 'q' END AS query",
    "CAST(click_id % 10 AS DOUBLE) AS clicks",
    "CAST(client_id % 40 AS DOUBLE) AS impressions",
    "CASE WHEN click_id % 7 > 0 THEN CAST(click_id % 50 AS DOUBLE) END AS position",
    where="client_id IS NOT NULL",
)
_DIMS = """d AS (SELECT period, coalesce(list_filter(keys, lambda k: regexp_matches(k, '^https?://'))[-1], page) AS page, coalesce(list_filter(keys, lambda k: NOT regexp_matches(k, '^https?://') AND NOT regexp_full_match(k, '\\d{4}-\\d{2}-\\d{2}'))[1], query) AS query, list_filter(keys, lambda k: regexp_full_match(k, '\\d{4}-\\d{2}-\\d{2}'))[-1] AS day, clicks, impressions, position FROM t)"""
_PATH = "CASE WHEN rtrim(regexp_extract(page, '^https?://[^/?#]*([^?#]*)', 1), '/') = '' THEN '/' ELSE rtrim(regexp_extract(page, '^https?://[^/?#]*([^?#]*)', 1), '/') END"
_FOLD = "CAST(sum(coalesce(clicks, 0)) AS BIGINT) AS clicks, CAST(sum(coalesce(impressions, 0)) AS BIGINT) AS impressions, round(sum(coalesce(position, 0) * coalesce(impressions, 0)) / nullif(sum(coalesce(impressions, 0)), 0), 2) AS position"
_FOLDED = f"{METRICS.sql('t')}, {_DIMS}, f AS (SELECT period, {_PATH} AS page, {_FOLD} FROM d WHERE coalesce(page, '') <> '' GROUP BY 1, 2)"


def _compare_sql(p: str, c: str, key: str, settling: str, least: int) -> str:
    return f"""j AS (SELECT coalesce(p.{key}, c.{key}) AS {key}, p.impressions AS impressions_before, p.clicks AS clicks_before, p.position AS position_before, c.impressions AS impressions_after, c.clicks AS clicks_after, c.position AS position_after, p.{key} IS NULL AS fresh FROM {p} p FULL JOIN {c} c ON p.{key} = c.{key}),
x AS (SELECT *, round((impressions_after - impressions_before) / nullif(impressions_before, 0), 4) AS d_impressions, round((clicks_after - clicks_before) / nullif(clicks_before, 0), 4) AS d_clicks, round(position_after - position_before, 2) AS d_position FROM j),
v AS (SELECT * EXCLUDE (fresh), CASE WHEN fresh THEN 'new' WHEN impressions_before < {least} THEN 'skipped' WHEN {settling} THEN 'settling' WHEN coalesce(impressions_after, 0) = 0 THEN 'lost' WHEN d_impressions <= -0.3 AND d_position >= 1 THEN 'decay' WHEN d_impressions <= -0.3 THEN 'demand_drop' WHEN d_impressions >= 0.3 THEN 'rising' ELSE 'stable' END AS verdict FROM x)"""


@query("F8_split_dimensions", f"WITH {METRICS.sql('t')}, {_DIMS} SELECT page, query, day, clicks, impressions, position FROM d")
def f8(spark, sf_dir):
    return M.split_dimensions(METRICS.df(spark, sf_dir).drop("period"))


@query("A8_weighted_position", f"WITH {_FOLDED} SELECT * FROM f")
def a8(spark, sf_dir):
    rows = METRICS.df(spark, sf_dir)
    return M.fold_pages(rows.where("period = 'prev'")).withColumn("period", F.lit("prev")).unionByName(M.fold_pages(rows.where("period = 'cur'")).withColumn("period", F.lit("cur")))


@query("J1_J2_R14_compare_rules", f"WITH {_FOLDED}, pp AS (SELECT * FROM f WHERE period = 'prev'), cc AS (SELECT * FROM f WHERE period = 'cur'), {_compare_sql('pp', 'cc', 'page', chr(39) + '/young' + chr(39) + ' = page', 10)} SELECT *, CASE WHEN page = '/young' THEN '2024-12-20' END AS published FROM v")
def r14_rules(spark, sf_dir):
    rows = METRICS.df(spark, sf_dir)
    published = spark.createDataFrame([("/young", "2024-12-20")], "page string, published string")
    return M.compare(M.fold_pages(rows.where("period = 'prev'")), M.fold_pages(rows.where("period = 'cur'")), published=published, previous_start="2025-01-01")


_PERIODS = """e AS (SELECT user_id, value, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'prev' ELSE 'cur' END AS period FROM events), g AS (SELECT period, user_id AS page, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS clicks, count(*) AS impressions, round(avg(value), 2) AS position FROM e GROUP BY 1, 2), pp AS (SELECT * FROM g WHERE period = 'prev'), cc AS (SELECT * FROM g WHERE period = 'cur')"""


def periods(spark, sf_dir):
    """events stands in: user as page, rows as impressions, values as positions."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.col("ts"), (F.col("value") > 50).cast("double").alias("clicks"), F.lit(1.0).alias("impressions"), F.col("value").alias("position"))
    before, after = M.split_periods(e, "ts", "2024-01-16")
    return M.fold(before, ["page"]), M.fold(after, ["page"])


@query("R14_F32_compare_events", f"WITH {_PERIODS}, {_compare_sql('pp', 'cc', 'page', 'false', 10)} SELECT *, CAST(NULL AS VARCHAR) AS published FROM v")
def r14(spark, sf_dir):
    return M.compare(*periods(spark, sf_dir))


@query("A10_verdict_counts", f"WITH {_PERIODS}, {_compare_sql('pp', 'cc', 'page', 'false', 10)}, c AS (SELECT count(*) FILTER (verdict = 'decay') AS decay, count(*) FILTER (verdict = 'demand_drop') AS demand_drop, count(*) FILTER (verdict = 'rising') AS rising, count(*) FILTER (verdict = 'lost') AS lost, count(*) FILTER (verdict = 'new') AS new, count(*) FILTER (verdict = 'settling') AS settling FROM v) SELECT *, decay / (decay + demand_drop + rising) >= 0.6 AND decay >= 8 AND demand_drop > 0 AS site_wide FROM c")
def a10(spark, sf_dir):
    return M.verdict_counts(M.compare(*periods(spark, sf_dir)))


@query("O5_O9_most_lost", f"WITH {_PERIODS}, {_compare_sql('pp', 'cc', 'page', 'false', 10)} SELECT page, impressions_before - impressions_after AS lost FROM v WHERE verdict IN ('decay', 'demand_drop') ORDER BY lost DESC, page LIMIT 5")
def o5(spark, sf_dir):
    """O5, O9: a top-k report."""
    v = M.compare(*periods(spark, sf_dir)).where(F.col("verdict").isin("decay", "demand_drop"))
    return v.select("page", (F.col("impressions_before") - F.col("impressions_after")).alias("lost")).orderBy(F.desc("lost"), "page").limit(5)


@query("A9_W5_cannibals", """WITH r AS (SELECT l_partkey AS query, l_suppkey AS page, count(*) AS impressions, round(avg(l_quantity), 2) AS position FROM lineitem GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY impressions DESC, page) AS rn FROM r WHERE impressions >= 2),
t AS (SELECT * FROM k WHERE rn = 1 AND position <= 30 AND position > 0), v AS (SELECT query, count(*) AS n, sum(impressions) AS more, min_by(position, rn) AS nxt FROM k WHERE rn > 1 AND position <= 30 AND position > 0 GROUP BY 1)
SELECT CAST(query AS VARCHAR) AS query, page, n + 1 AS pages, CAST(t.impressions + more AS BIGINT) AS total_impressions, round(round(abs(nxt - position), 2), 1) AS spread FROM t JOIN v USING (query)""")
def a9(spark, sf_dir):
    """lineitem stands in: part as query, supplier as page, quantity as position."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("query"), F.col("l_suppkey").alias("page"), F.lit(0.0).alias("clicks"), F.lit(1.0).alias("impressions"), F.col("l_quantity").alias("position"))
    return M.cannibals(M.fold(l, ["query", "page"]), least=2, worst=30.0)


CALENDAR = Derived("sales", "substr(CAST(sold_at AS STRING), 1, 10) AS date", "CASE WHEN sale_id % 2 = 0 THEN substr(CAST(arrived_at AS STRING), 1, 10) END AS ended", "'update ' || CAST(sale_id AS STRING) AS name", where="priority = 5 AND sold_at IS NOT NULL")


@query("J3_calendar_overlap", f"WITH {CALENDAR.sql('c')} SELECT * FROM c WHERE NOT (coalesce(ended, date) < '2024-01-02' OR date > '2024-01-11')")
def j3(spark, sf_dir):
    return M.overlapping(CALENDAR.df(spark, sf_dir), "2024-01-02", "2024-01-11")


@query("J3_events_in_updates", f"WITH {CALENDAR.sql('c')}, d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1) SELECT day, n, name FROM d JOIN c ON day >= date AND day <= coalesce(ended, date)")
def j3_events(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return M.in_intervals(days, CALENDAR.df(spark, sf_dir)).select("day", "n", "name")


@query("F11_F12_O3_bands", "WITH t AS (SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'signup') = 0 THEN NULL ELSE round(avg(value) / 3, 1) END AS position, count(*) AS impressions, count(*) FILTER (event_type = 'click') / count(*) AS ctr FROM events GROUP BY 1), b AS (SELECT *, CASE WHEN position IS NULL THEN 'unknown' WHEN position <= 3 THEN 'top3' WHEN position <= 10 THEN 'page1' WHEN position <= 20 THEN 'striking-distance' WHEN position <= 50 THEN 'page3-5' ELSE 'deep' END AS band FROM t) SELECT user_id, position, band, CAST(list_position(['striking-distance', 'page3-5', 'page1', 'top3', 'deep', 'unknown'], band) - 1 AS INTEGER) AS ordinal, coalesce(position <= 10 AND position <> 0 AND impressions >= 100 AND ctr < 0.02, false) AS low_ctr FROM b")
def f11(spark, sf_dir):
    t = table(spark, sf_dir, "events").groupBy("user_id").agg(F.when(F.count_if(F.col("event_type") == "signup") != 0, M.rounded(M.exact_mean("value") / 3, 1)).alias("position"), F.count("*").alias("impressions"), (F.count_if(F.col("event_type") == "click") / F.count("*")).alias("ctr"))
    b = t.withColumn("band", M.band(F.col("position")))
    return b.select("user_id", "position", "band", M.band_rank(F.col("band")).alias("ordinal"), M.low_ctr(F.col("position"), F.col("impressions"), F.col("ctr")).alias("low_ctr"))


#: lineitem and orders stand in for two snapshots: customer as keyword, brand as domain, line number as position.
_SNAP = """s AS (SELECT o_orderdate < TIMESTAMP '1995-06-01' AS early, c_name AS keyword, p_brand AS domain, l_linenumber AS position, l_orderkey * 10 + l_linenumber AS ord FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
b AS (SELECT keyword, domain, max_by(position, ord) AS position FROM s WHERE early GROUP BY 1, 2), a AS (SELECT keyword, domain, max_by(position, ord) AS position FROM s WHERE NOT early GROUP BY 1, 2),
m AS (SELECT keyword, domain, CASE WHEN b.position IS NOT NULL AND a.position IS NOT NULL THEN 'held' WHEN a.position IS NOT NULL THEN 'entrant' ELSE 'exit' END AS state, a.position - b.position AS move FROM b FULL JOIN a USING (keyword, domain) WHERE keyword IN (SELECT keyword FROM a) AND keyword IN (SELECT keyword FROM b))"""


def snapshots(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    s = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    s = s.select((F.col("o_orderdate") < F.lit("1995-06-01").cast("timestamp_ntz")).alias("early"), F.col("c_name").alias("keyword"), F.col("p_brand").alias("domain"), F.col("l_linenumber").alias("position"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return s.where("early"), s.where("not early")


@query("J4_J5_J6_moves", f"WITH {_SNAP} SELECT * FROM m")
def j4(spark, sf_dir):
    return M.page_one_moves(*snapshots(spark, sf_dir))


@query("A11_O7_churn", f"WITH {_SNAP} SELECT keyword, round(1 - count(*) FILTER (state = 'held') / count(*), 3) AS churn FROM m GROUP BY 1")
def a11(spark, sf_dir):
    return M.churn(M.page_one_moves(*snapshots(spark, sf_dir)))


@query("A12_recurring_entrants", f"WITH {_SNAP} SELECT domain, count(*) AS keywords FROM m WHERE state = 'entrant' GROUP BY 1 HAVING count(*) > 1 ORDER BY keywords DESC, domain LIMIT 10")
def a12(spark, sf_dir):
    return M.recurring(M.page_one_moves(*snapshots(spark, sf_dir)), "entrant")


@query("R15_drift_verdict", f"WITH {_SNAP}, c AS (SELECT keyword, round(1 - count(*) FILTER (state = 'held') / count(*), 3) AS churn FROM m GROUP BY 1), d AS (SELECT count(*) AS keywords, round(avg(churn), 3) AS mean_churn, max(churn) AS most FROM c) SELECT *, CASE WHEN keywords = 0 THEN NULL WHEN mean_churn >= 0.4 THEN 'SITE-WIDE' WHEN most >= 0.4 THEN 'LOCALISED' ELSE 'STABLE' END AS verdict FROM d")
def r15(spark, sf_dir):
    return M.drift_verdict(M.churn(M.page_one_moves(*snapshots(spark, sf_dir))))


SNAPS = Derived("events", "CASE WHEN event_id % 2 = 0 THEN 'old' ELSE 'new' END AS snapshot", "CAST(user_id AS STRING) AS keyword", "event_type || '.com' AS domain", "CASE WHEN value > 5 THEN CAST(floor(value / 8) AS INT) + 1 END AS position", "value > 5 AS ok")


@query("J4_one_sided_and_unread", f"WITH {SNAPS.sql('s')}, r AS (SELECT * FROM s WHERE ok), o AS (SELECT DISTINCT keyword FROM r WHERE snapshot = 'old'), n AS (SELECT DISTINCT keyword FROM r WHERE snapshot = 'new') SELECT keyword, 'before' AS side FROM o WHERE keyword NOT IN (SELECT keyword FROM n) UNION ALL SELECT keyword, 'after' FROM n WHERE keyword NOT IN (SELECT keyword FROM o) UNION ALL SELECT keyword, 'unread' FROM s WHERE NOT ok")
def j4_sides(spark, sf_dir):
    """A refused reading is listed as unread, never as an empty page."""
    s = SNAPS.df(spark, sf_dir)
    read = s.where("ok")
    return M.one_sided(read.where("snapshot = 'old'"), read.where("snapshot = 'new'")).unionAll(s.where("not ok").select("keyword", F.lit("unread")))


SUGGESTIONS = Derived(
    "events",
    """CASE event_id % 7 WHEN 0 THEN '  Best Rank tracker ' || CAST(user_id % 9 AS STRING) WHEN 1 THEN 'rank tracker pricing ' || CAST(user_id % 9 AS STRING) WHEN 2 THEN 'how to track ' || event_type WHEN 3 THEN 'buy rank tracker' WHEN 4 THEN 'check rank vs ' || event_type WHEN 5 THEN 'x' ELSE 'keyword calculator ' || CAST(user_id AS STRING) END AS suggestion""",
    "user_id % 4 AS depth",
    "event_id % 10 + 1 AS rank",
    "CASE WHEN user_id % 3 = 0 THEN 'seed' ELSE 'a' || CAST(user_id % 3 AS STRING) END AS via",
    "event_type AS engine",
)
_INTENT = f"CASE WHEN regexp_matches(keyword, '{K.TRANSACTIONAL}') THEN 'transactional' WHEN regexp_matches(keyword, '{K.COMPARISON}') THEN 'comparison' WHEN regexp_matches(keyword, '{K.COMMERCIAL}') THEN 'commercial' ELSE 'informational' END"
_WORDS = "len(list_filter(string_split_regex(keyword, '\\s+'), lambda w: w <> ''))"
_CANDIDATES = f"""{SUGGESTIONS.sql('s')}, n AS (SELECT *, CASE WHEN length(trim(regexp_replace(lower(suggestion), '\\s+', ' ', 'g'))) >= 3 THEN trim(regexp_replace(lower(suggestion), '\\s+', ' ', 'g')) END AS keyword FROM s), l AS (SELECT count(DISTINCT engine) AS live FROM s WHERE suggestion IS NOT NULL),
c AS (SELECT keyword, min(depth) AS min_depth, min(rank) AS best_rank, count(*) AS times_seen, count(DISTINCT engine) AS agreement, string_agg(DISTINCT engine, ',' ORDER BY engine) AS engines, string_agg(DISTINCT via, ',' ORDER BY via) AS via FROM n WHERE keyword IS NOT NULL GROUP BY 1),
k AS (SELECT *, greatest(0, 100 - 22 * min_depth - 4 * (best_rank - 1) + 3 * least(times_seen - 1, 6)) AS demand_proxy, CAST(round(100 * agreement / live, 0) AS DOUBLE) AS agreement_pct, {_INTENT} AS intent, regexp_matches(keyword, '{K.TOOL}') AS tool_shaped, {_WORDS} BETWEEN 2 AND 5 AS mid_tail, {_WORDS} AS words FROM c, l)"""


@query("A19_A20_A21_F13_F14_W7_candidates", f"WITH {_CANDIDATES} SELECT * EXCLUDE (live) FROM k")
def a19(spark, sf_dir):
    return K.candidates(SUGGESTIONS.df(spark, sf_dir))


@query("O4_F15_sorted_candidates", f"WITH {_CANDIDATES} SELECT keyword, row_number() OVER (ORDER BY agreement DESC, demand_proxy DESC, keyword) AS place FROM k WHERE contains(keyword, 'rank') AND contains(keyword, 'track')")
def o4(spark, sf_dir):
    kept = K.candidates(SUGGESTIONS.df(spark, sf_dir)).where(K.holds_all(F.col("keyword"), ["rank", "track"]))
    return kept.select("keyword", F.row_number().over(W.orderBy(*K.order_of("agreement"))).cast("long").alias("place"))  # a literal handful


@query("F13_intent_conversations", f"WITH c AS (SELECT conv_id, turn, lower(text) AS keyword FROM conversations) SELECT conv_id, turn, {_INTENT} AS intent, regexp_matches(keyword, '{K.TOOL}') AS tool_shaped FROM c")
def f13(spark, sf_dir):
    t = F.lower("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", K.intent(t).alias("intent"), K.tool_shaped(t).alias("tool_shaped"))


VOLUMES = Derived("items", "'k' || CAST(item_id AS STRING) AS keyword", "CASE WHEN item_id % 6 > 0 THEN item_id * 3 % 300 END AS volume", "CASE WHEN item_id % 5 > 0 THEN CAST(item_id % 90 AS DOUBLE) END AS kd")


@query("F16_affordable", f"WITH {VOLUMES.sql('v')} SELECT * FROM v WHERE coalesce(volume, 0) >= 10 AND (kd IS NULL OR kd <= 30)")
def f16(spark, sf_dir):
    return K.affordable(VOLUMES.df(spark, sf_dir), 30.0, 10)


RESULTS = Derived("sale_lines", "'keyword ' || CAST(sale_id AS STRING) AS keyword", "'https://s.com/' || CAST(item_id AS STRING) || '-' || CAST(vendor_id AS STRING) || CASE line_no % 3 WHEN 0 THEN '/#f' WHEN 1 THEN '/' ELSE '' END AS url", where="item_id IS NOT NULL AND vendor_id IS NOT NULL AND sale_id IS NOT NULL")
_EDGES = "u AS (SELECT DISTINCT keyword, regexp_replace(split_part(url, '#', 1), '/+$', '') AS url FROM r), e AS (SELECT a.keyword AS a, b.keyword AS b, count(*) AS shared FROM u a JOIN u b USING (url) WHERE a.keyword < b.keyword GROUP BY 1, 2 HAVING count(*) >= 3)"
_REACH = "bth AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), reach AS (SELECT DISTINCT keyword AS node, keyword AS other FROM u UNION SELECT reach.node, bth.b FROM reach JOIN bth ON bth.a = reach.other), lab AS (SELECT node AS keyword, min(other) AS cluster FROM reach GROUP BY 1), deg AS (SELECT a AS keyword, count(*) AS degree FROM bth GROUP BY 1), mem AS (SELECT keyword, cluster, coalesce(degree, 0) AS degree FROM lab LEFT JOIN deg USING (keyword))"


def _clustered(spark, sf_dir):
    r = RESULTS.df(spark, sf_dir)
    return r, K.clusters(r)


@query("J10_shared_results", f"WITH {RESULTS.sql('r')}, {_EDGES} SELECT * FROM e")
def j10(spark, sf_dir):
    return K.shared_results(RESULTS.df(spark, sf_dir))


@query("J10_shared_parts", "WITH u AS (SELECT DISTINCT l_orderkey AS keyword, l_partkey AS url FROM lineitem) SELECT a.keyword AS a, b.keyword AS b, count(*) AS shared FROM u a JOIN u b USING (url) WHERE a.keyword < b.keyword GROUP BY 1, 2 HAVING count(*) >= 2")
def j10_parts(spark, sf_dir):
    return K.shared_results(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("keyword"), F.col("l_partkey").cast("string").alias("url")), 2)


@query("A44_clusters", f"WITH RECURSIVE {RESULTS.sql('r')}, {_EDGES}, {_REACH} SELECT * FROM mem")
def a44(spark, sf_dir):
    return _clustered(spark, sf_dir)[1]


@query("A44_cluster_stats", f"WITH RECURSIVE {RESULTS.sql('r')}, {_EDGES}, {_REACH}, k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY degree DESC, length(keyword), keyword) AS rn FROM mem) SELECT cluster, count(*) AS size, max(keyword) FILTER (rn = 1) AS head, CASE WHEN count(*) > 2 THEN count(*) FILTER (degree = 1) ELSE 0 END AS bridges FROM k GROUP BY 1")
def a44_stats(spark, sf_dir):
    return K.cluster_stats(_clustered(spark, sf_dir)[1])


@query("A44_shared_by_all", f"WITH RECURSIVE {RESULTS.sql('r')}, {_EDGES}, {_REACH}, z AS (SELECT cluster, count(*) AS size FROM mem GROUP BY 1) SELECT cluster, url FROM u JOIN mem USING (keyword) JOIN z USING (cluster) GROUP BY cluster, url, size HAVING count(*) = size")
def a44_all(spark, sf_dir):
    r, m = _clustered(spark, sf_dir)
    return K.shared_by_all(m, r)


@query("A44_part_clusters", """WITH RECURSIVE u AS (SELECT DISTINCT l_orderkey AS keyword, l_partkey AS url FROM lineitem), e AS (SELECT a.keyword AS a, b.keyword AS b FROM u a JOIN u b USING (url) WHERE a.keyword < b.keyword GROUP BY 1, 2 HAVING count(*) >= 2), bth AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT DISTINCT a AS node, a AS other FROM bth UNION SELECT reach.node, bth.b FROM reach JOIN bth ON bth.a = reach.other) SELECT node, min(other) AS label FROM reach GROUP BY 1""")
def a44_parts(spark, sf_dir):
    """Components over the orders that share two parts or more."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("keyword"), F.col("l_partkey").cast("string").alias("url"))
    return K.result_components(rows, 2)
