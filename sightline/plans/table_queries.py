"""Queries over whole tables of pages, clicks, orders and events: robots, links, intervals, order statistics, trees, sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..operators import agents as A
from ..operators import intervals as I
from ..operators import link_graph as L
from ..operators import robots_tries as R
from ..operators import sketches as K
from ..operators import trees as N
from ..operators.order_stats import order_statistics
from ..operators.registry_bots import BOTS
from ..sources.shared import materialize, spread
from .registry import query, table

_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_SITES = f"s AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages), p AS (SELECT *, regexp_extract(path, '^/([^/]+)/', 1) AS dir, right(regexp_extract(path, '/([0-9]+)', 1), 1) AS digit FROM s)"


def _sites(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", U.hostname("url").alias("host"), U.part("url", 3).alias("path"))
    return pages.withColumns({"dir": F.regexp_extract("path", "^/([^/]+)/", 1), "digit": F.right(F.regexp_extract("path", "/([0-9]+)", 1), F.lit(1))})


def _bodies(sites):
    """A robots file for each host, made of its pages' folders and last digits (so a host has a few hundred rules at most)."""
    line = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("Disallow: /"), "dir", F.lit("/*"), "digit", F.lit("$"))).otherwise(F.concat(F.lit("Allow: /"), "dir", F.lit("/"), "digit"))
    lines = sites.select("host", F.explode(F.array(line, F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("Disallow: /"), "dir", F.lit("/"))))).alias("line")).where("line IS NOT NULL").distinct()
    tail = "\n\nUser-agent: GPTBot\nUser-agent: CCBot # both\nDisallow: /\nAllow: /*.html$\nDisallow:\n"
    own = lines.groupBy("host").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("rules"))
    return own.select("host", F.concat(F.lit("# rules\nUser-agent: *\n"), "rules", F.lit(tail)).alias("body"))


_BOTS = ", ".join(f"('{b[1]}', '{b[2]}')" for b in BOTS)
_RESOLVED = rf"""{_SITES}, bots(bot, category) AS (VALUES {_BOTS}),
r AS (SELECT DISTINCT host, '*' AS agent, CASE WHEN page_id % 2 = 0 THEN 'disallow' ELSE 'allow' END AS field, CASE WHEN page_id % 2 = 0 THEN '/' || dir || '/*' || digit || '$' ELSE '/' || dir || '/' || digit END AS pattern FROM p
  UNION SELECT host, '*', 'disallow', '/' || dir || '/' FROM p WHERE page_id % 5 = 0
  UNION SELECT DISTINCT host, 'own', 'disallow', '/' FROM p UNION SELECT DISTINCT host, 'own', 'allow', '/*.html$' FROM p),
a AS (SELECT page_id, host, path, bot, category, CASE WHEN contains(lower(bot), 'gptbot') OR contains(lower(bot), 'ccbot') THEN 'own' ELSE '*' END AS agent FROM p, bots),
d AS (SELECT a.page_id, a.host, a.bot, a.category, coalesce(arg_max(r.field, struct_pack(n := length(r.pattern), w := (r.field = 'allow')::INT)) = 'allow', true) AS allowed
  FROM a LEFT JOIN r ON r.host = a.host AND r.agent = a.agent AND regexp_matches(a.path, '^' || replace(replace(r.pattern, '.', '\.'), '*', '.*')) GROUP BY ALL)"""


def _resolved(spark, sf_dir):
    sites = materialize(_sites(spark, sf_dir), "sites")
    rules = materialize(A.robots_rules(_bodies(sites), "host"), "rules")
    bots = spark.createDataFrame([(b[1], b[2]) for b in BOTS], "bot string, category string")
    groups = R.chosen_groups(rules, bots.select("bot"), "host").join(F.broadcast(bots), "bot")  # some twenty crawlers
    told = R.resolve_paths(rules.select("host", "grp", "field", "pattern").distinct(), sites.select("page_id", "host", "path"), "host", "path")
    return told.join(groups.hint("merge"), ["host", "grp"])


@query("R6_R7_W10_robots", f"WITH {_RESOLVED} SELECT page_id, bot, allowed FROM d")
def robots(spark, sf_dir):
    """Every page against every crawler, by its host's rules."""
    return _resolved(spark, sf_dir).select("page_id", "bot", "allowed")


@query("A37_J20_crawler_classes", f"WITH {_RESOLVED} SELECT host, category, count(*) FILTER (allowed) AS allowed, count(*) AS total FROM d GROUP BY 1, 2")
def crawler_classes(spark, sf_dir):
    return A.class_summary(_resolved(spark, sf_dir), "host")


_ITEMS = """j AS (SELECT click_id, TRY_CAST(props AS JSON) AS j FROM clicks), i AS (SELECT click_id, CAST(j->'$.items[*].sku' AS BIGINT[]) AS skus FROM j),
e AS (SELECT unnest(skus[1:len(skus) - 1]) AS source, unnest(skus[2:]) AS target FROM i WHERE len(skus) > 1)"""


def _next_items(spark, sf_dir):
    """(source, target): items that stand one after the other in a click."""
    skus = F.transform(F.try_variant_get(F.try_parse_json("props"), "$.items", "array<struct<sku:bigint>>"), lambda x: x["sku"])
    lists = table(spark, sf_dir, "clicks").select(skus.alias("s")).where("size(s) > 1")
    return lists.select(F.explode(F.arrays_zip(F.slice("s", F.lit(1), F.size("s") - 1).alias("source"), F.slice("s", F.lit(2), F.size("s") - 1).alias("target"))).alias("x")).select("x.source", "x.target")


@query("J11_D9_missing_return", f"WITH {_ITEMS} SELECT DISTINCT source, target FROM e WHERE source <> target AND NOT EXISTS (SELECT 1 FROM e b WHERE b.source = e.target AND b.target = e.source)")
def missing_return(spark, sf_dir):
    """Items that lead to another which never leads back."""
    return L.unreturned(_next_items(spark, sf_dir))


@query("J12_item_fan_in", f"WITH {_ITEMS}, d AS (SELECT DISTINCT source, target FROM e WHERE source IS NOT NULL AND target IS NOT NULL) SELECT target, count(*) AS n_sources, array_to_string(list_sort(list(source))[1:3], ' ') AS first_sources FROM d GROUP BY 1")
def item_fan_in(spark, sf_dir):
    return L.fan_in(_next_items(spark, sf_dir))


_LINKS = f"""l AS (SELECT DISTINCT url AS source, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', 0) AS site, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref="([^"]*)"', 1)) AS href FROM pages)"""


def _links(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "pages"))
    return pages.select(F.col("url").alias("source"), F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0).alias("site"), F.explode(X.found("html", r'(?i)<a\b[^>]*?\bhref="([^"]*)"', 1)).alias("href")).distinct()


@query("J12_alternate_status", f"WITH {_LINKS} SELECT source, site || href AS target, EXISTS (SELECT 1 FROM pages p WHERE p.url = site || href) AS known FROM l")
def link_status(spark, sf_dir):
    """Links of all pages, and whether their target is a page that is known."""
    links = _links(spark, sf_dir).select("source", F.concat("site", "href").alias("target"))
    return L.with_status(links, table(spark, sf_dir, "pages")).select("source", "target", "known")


@query("R4_link_hubs", f"WITH {_LINKS}, d AS (SELECT DISTINCT source, href AS target FROM l) SELECT target, count(*) AS n_sources, array_to_string(list_sort(list(source))[1:3], ' ') AS first_sources FROM d GROUP BY 1")
def link_hubs(spark, sf_dir):
    """How many pages link to each path, whatever their host, and the first three."""
    return L.fan_in(_links(spark, sf_dir).select("source", F.col("href").alias("target")))


@query("J3_orders_under_way", """WITH o AS (SELECT o_orderkey, o_custkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS day FROM orders),
w AS (SELECT o_orderkey AS other, o_custkey, l_linenumber, day AS a, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS b FROM o JOIN lineitem ON l_orderkey = o_orderkey)
SELECT o.o_orderkey AS order_key, w.other AS other_key, w.l_linenumber AS line, w.a AS other_start, w.b AS other_end FROM o JOIN w ON o.o_custkey = w.o_custkey AND o.day BETWEEN w.a AND w.b AND o.o_orderkey <> w.other""")
def orders_under_way(spark, sf_dir):
    """Orders placed while a line of another order of the same customer was yet to be shipped."""
    day = lambda c: F.unix_date(F.col(c).cast("date")).cast("long")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("customer"), day("o_orderdate").alias("start"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), day("l_shipdate").alias("end"))
    ways = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"]).select("customer", F.col("l_orderkey").alias("other_key"), "line", "start", "end")
    points = orders.select(F.col("o_orderkey").alias("order_key"), "customer", "start", F.col("start").alias("end"))
    return I.overlap_join(points, ways, ["customer"]).where("order_key <> other_key").select("order_key", "other_key", "line", "other_start", "other_end")


_SHARES = {"p10": 0.1, "median": 0.5, "p90": 0.9}


def _picked(value: str) -> str:
    return ", ".join(f"list_sort(list({value}))[floor(count(*) * {q})::INT + 1] AS {name}" for name, q in _SHARES.items())


@query("W8_prices_by_flag", f"SELECT l_returnflag, count(*) AS n, {_picked('l_extendedprice')} FROM lineitem GROUP BY 1")
def prices(spark, sf_dir):
    return order_statistics(table(spark, sf_dir, "lineitem"), "l_extendedprice", _SHARES, ["l_returnflag"])


@query("W8_text_sizes", f"SELECT count(n_chars) AS n, {_picked('n_chars')} FROM documents WHERE n_chars IS NOT NULL")
def text_sizes(spark, sf_dir):
    return order_statistics(table(spark, sf_dir, "documents"), "n_chars", _SHARES)


@query("A43_D18_type_tree", """WITH RECURSIVE t AS (SELECT click_id, TRY_CAST(props AS JSON) AS node FROM clicks WHERE props IS NOT NULL),
walk AS (SELECT node, '$' AS path FROM t WHERE node IS NOT NULL
  UNION ALL SELECT unnest(CASE json_type(node) WHEN 'OBJECT' THEN list_transform(json_keys(node), lambda k: json_extract(node, '$."' || k || '"')) ELSE json_extract(node, '$[*]') END),
    unnest(CASE json_type(node) WHEN 'OBJECT' THEN list_transform(json_keys(node), lambda k: path || '.' || k) ELSE list_transform(range(json_array_length(node)::BIGINT), lambda i: path || '[]') END) FROM walk WHERE json_type(node) IN ('OBJECT', 'ARRAY')),
k AS (SELECT path, CASE json_type(node) WHEN 'VARCHAR' THEN 'STRING' WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'NULL' THEN 'VOID' ELSE json_type(node) END AS type FROM walk UNION ALL SELECT '$', 'malformed' FROM t WHERE node IS NULL)
SELECT path, type, count(*) AS n FROM k GROUP BY 1, 2""")
def type_tree(spark, sf_dir):
    """Types of all nodes of the clicks' properties, by place; texts that are not JSON are counted."""
    return N.node_types(table(spark, sf_dir, "clicks"), "click_id", "props").groupBy("path", "type").agg(F.count("*").alias("n"))


@query("A1_A4_month_sketches", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS different, true AS close FROM events WHERE ts::DATE BETWEEN DATE '2024-01-03' AND DATE '2024-01-28' GROUP BY 1")
def month_sketches(spark, sf_dir):
    """Distinct events of most of a month from one sketch a day: within 3 % of the exact count."""
    events = table(spark, sf_dir, "events")
    days = materialize(K.daily_sketches(events, "ts", ["event_type"], "event_id"), "sketches")
    told = K.distinct_between(days, ["event_type"], "2024-01-03", "2024-01-28")
    exact = events.where(F.to_date("ts").between(F.lit("2024-01-03").cast("date"), F.lit("2024-01-28").cast("date"))).groupBy("event_type").agg(F.countDistinct("event_id").alias("different"))
    return told.join(exact, "event_type").select("event_type", "n", "different", (F.abs(F.col("distinct") - F.col("different")) <= 0.03 * F.col("different")).alias("close"))
