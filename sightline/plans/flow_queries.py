"""Queries of readers, sinks and streams. Streams read all there is and stop."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import tables as T
from ..sources.shared import shared_root
from ..streaming import streams as ST
from .registry import Derived, query, table


def _folder(spark, label: str) -> str:
    return f"{shared_root(spark)}/flow/{label}-{uuid.uuid4().hex}"


BODIES = Derived(
    "events",
    "event_id AS src",
    """CASE event_id % 5 WHEN 0 THEN '{"rows": [{"keys": ["https://a.b/' || CAST(user_id AS STRING) || '"], "clicks": 1, "impressions": ' || CAST(event_id AS STRING) || ', "position": 2.5}]}' WHEN 1 THEN '[{"keys": ["q"], "page": "https://a.b/y' || CAST(user_id AS STRING) || '", "clicks": 2, "impressions": 20, "position": 3}]' WHEN 2 THEN '{"results": [{"query": "z", "clicks": 0, "impressions": 5, "position": null}]}' WHEN 3 THEN 'broken ' || event_type ELSE '{"other": 1}' END AS body""",
)


_METRICS = "from_json(coalesce(json_extract(j, '$.rows'), json_extract(j, '$.data'), json_extract(j, '$.results'), CASE WHEN json_type(j) = 'ARRAY' THEN j END), '[\"JSON\"]')"


@query("S7_metric_bodies", f"""WITH {BODIES.sql('t')}, p AS (SELECT src, TRY_CAST(body AS JSON) AS j FROM t), r AS (SELECT src, unnest({_METRICS}) AS r FROM p)
SELECT src, list_filter(CAST(json_extract(r, '$.keys') AS VARCHAR[]), lambda k: starts_with(k, 'http'))[1] AS url, r->>'page' AS page, CAST(r->>'impressions' AS DOUBLE) AS impressions FROM r""")
def s7(spark, sf_dir):
    r = T.metric_rows(BODIES.df(spark, sf_dir), "body")
    return r.select("src", F.get(F.filter("keys", lambda k: k.startswith("http")), F.lit(0)).alias("url"), "page", "impressions")


ANSWERS = Derived(
    "events",
    "CASE event_id % 5 WHEN 0 THEN 'google' WHEN 1 THEN 'guarded' WHEN 2 THEN 'amazon' WHEN 3 THEN 'ddg' ELSE 'silent' END AS engine",
    """CASE event_id % 5 WHEN 0 THEN '["q", ["' || event_type || ' b", "c' || CAST(user_id AS STRING) || '"]]' WHEN 1 THEN ')]}''' || chr(10) || '["q", [["d' || CAST(user_id AS STRING) || '", 0], ["e", 1]]]' WHEN 2 THEN '{"suggestions": [{"value": "' || event_type || '"}, {"value": "g"}]}' WHEN 3 THEN '[{"phrase": "h"}, {"phrase": "' || event_type || '"}]' ELSE '[]' END AS body""",
)


_TEXTS = "CASE WHEN json_extract_string(j, '$[1][0][0]') IS NOT NULL THEN json_extract_string(j, '$[1][*][0]') WHEN json_type(j, '$[1]') = 'ARRAY' THEN json_extract_string(j, '$[1][*]') WHEN json_type(j) = 'OBJECT' THEN json_extract_string(j, '$.suggestions[*].value') ELSE json_extract_string(j, '$[*].phrase') END"


@query("S10_suggestion_shapes", rf"""WITH {ANSWERS.sql('t')}, p AS (SELECT engine, CAST(regexp_replace(body, '^\)\]\}}''\s*', '') AS JSON) AS j FROM t) SELECT engine, coalesce(array_to_string({_TEXTS}, '|'), '') AS texts FROM p""")
def s10(spark, sf_dir):
    return ANSWERS.df(spark, sf_dir).select("engine", F.array_join(T.suggestions(F.col("body")), "|").alias("texts"))


@query("S8_ST1_appended_logs", "SELECT CAST(user_id AS VARCHAR) AS keyword, count(*) AS rows FROM events GROUP BY 1")
def s8(spark, sf_dir):
    """Rows of events appended in two runs, one of them with a bad line, and read back."""
    path = _folder(spark, "ranks")
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("keyword"), F.floor("value").cast("int").alias("position"), F.lit("u").alias("url"), F.lit("p").alias("provider"), F.col("ts").cast("string").alias("checked_at"))
    T.append_rows(e.where("position >= 50"), path)
    T.append_rows(e.where("position < 50"), path)
    spark.createDataFrame([("{bad",), ("",)], "value string").coalesce(1).write.mode("append").text(path)
    return T.read_appended(spark, path).groupBy("keyword").agg(F.count("*").alias("rows"))


@query("S12_document_folder", "SELECT trim(text, chr(10) || ' ') AS text FROM benchmark")
def s12(spark, sf_dir):
    """A folder with a file for each item, read back as documents."""
    path = _folder(spark, "site")
    table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("value")).write.partitionBy("item_id").text(path)
    found = T.documents(spark, path, ("txt",))
    return found.select(F.trim("text", F.lit("\n ")).alias("text"))


FEED = Derived(
    "pages",
    "CAST(page_id AS STRING) AS feed",
    """'<rss><item><title>Page ' || split_part(url, '/', 5) || '</title><link>' || url || '</link><source url=''u''>Paper</source></item>' || CASE WHEN page_id % 2 = 0 THEN '<item><title><![CDATA[Two & more]]></title><link>http://x/' || CAST(page_id AS STRING) || '</link></item>' ELSE '' END || '</rss>' AS body""",
)


_INNER = lambda name: f"regexp_replace(regexp_extract(i, '(?s)<{name}[^>]*>(.*?)</{name}>', 1), '^<!\\[CDATA\\[|\\]\\]>$', '', 'g')"


@query("S18_feed_items", f"WITH {FEED.sql('t')}, e AS (SELECT feed, unnest(regexp_extract_all(body, '(?s)<item[^>]*>(.*?)</item>', 1)) AS i FROM t) SELECT feed, {_INNER('title')} AS title, {_INNER('link')} AS link, {_INNER('source')} AS source FROM e")
def s18(spark, sf_dir):
    return T.feed_items(FEED.df(spark, sf_dir), "body")


@query("S16_S20_saved_tables", "SELECT n_name, n_regionkey FROM nation")
def s16(spark, sf_dir):
    path = _folder(spark, "store")
    df = table(spark, sf_dir, "nation").select("n_name", "n_regionkey")
    T.save_tsv(df, f"{path}/tsv")
    return spark.read.parquet(T.save(df, path))


_TWICE = '"{@"query@": @"q%@", @"results@": [{@"title@": @"t@", @"url@": @"u%@"}, {@"title@": @"v@", @"url@": @"w@"}]}"'
TWICE = Derived("events", "'" + _TWICE.replace("@", "' || chr(92) || '").replace("%", "' || CAST(event_id AS STRING) || '") + "' AS body")


@query("S9_double_encoded", f"WITH {TWICE.sql('t')}, j AS (SELECT CAST(CAST(body AS JSON)->>'$' AS JSON) AS j FROM t) SELECT j->>'query' AS query, CAST(json_array_length(j->'results') AS BIGINT) AS results FROM j")
def s9(spark, sf_dir):
    """The normal form of result pages, out of a capture that holds JSON within a JSON string."""
    page = T.double_encoded(F.col("body"), "query string, results array<struct<title:string,url:string,snippet:string>>")
    return TWICE.df(spark, sf_dir).withColumn("p", page).select("p.query", F.size("p.results").cast("long").alias("results"))


_LIST = '[{"title": "One", "url": "https://a.b/@", "snippet": "first", "content": "first", "description": "first", "position": 1}, {"title": "Two", "url": "https://a.b/2", "content": "%s", "description": null, "position": 4}]' % ("long " * 90)
_LINKS = '[{"title": "One", "link": "https://a.b/@", "snippet": "first", "position": 1}, {"link": "https://a.b/2", "snippet": "second"}]'
#: What each provider sends, as it stands in a capture; @ is the number of the page.
SEEN = [
    ("serpd", '{"ok": true, "results": ' + _LIST + "}"), ("serpd", '{"ok": false, "error": "x", "results": ' + _LIST + "}"), ("searxng", '{"results": ' + _LIST + "}"), ("brave", '{"web": {"results": ' + _LIST + "}}"), ("serper", '{"organic": ' + _LINKS + "}"), ("serpapi", '{"organic_results": ' + _LINKS + "}"),
    ("dataforseo", '{"tasks": [{"result": [{"items": [{"type": "ai_overview"}, {"type": "organic", "title": "One", "url": "https://a.b/@", "description": "first", "rank_absolute": 2}]}]}]}'), ("brave", '{"error": 1}'), ("serper", "no json"),
    ("ddg", '<html><a class="result__a" rel="x" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.b%2F@&amp;rut=z">One <b>&amp; only</b></a> <a class="result__snippet" href="y">the  <b>first</b></a><a class="result__a" href="//c.d/">Two</a></html>'),
]
PAGES_SEEN = Derived(
    "pages",
    "page_id AS id",
    "CASE page_id % 10 " + " ".join(f"WHEN {k} THEN '{p}'" for k, (p, _) in enumerate(SEEN)) + " END AS provider",
    "CASE page_id % 10 " + " ".join(f"WHEN {k} THEN '{body.replace('@', chr(39) + ' || CAST(page_id AS STRING) || ' + chr(39))}'" for k, (_, body) in enumerate(SEEN)) + " END AS body",
)
_JSON_ROWS = lambda provider, path, url, snippet, position: f"SELECT id, provider, i AS place, coalesce(r->>'title', '') AS title, coalesce(r->>'{url}', '') AS url, left(coalesce(r->>'{snippet}', ''), 300) AS snippet, CAST({position} AS INTEGER) AS position FROM (SELECT id, provider, unnest(from_json(json_extract(TRY_CAST(body AS JSON), '{path}'), '[\"JSON\"]')) AS r, generate_subscripts(from_json(json_extract(TRY_CAST(body AS JSON), '{path}'), '[\"JSON\"]'), 1) AS i FROM t WHERE provider = '{provider}' AND coalesce(TRY_CAST(body AS JSON)->>'$.ok', 'true') = 'true')"
_POSITION = "r->>'position'"


@query("S9_result_rows", f"""WITH {PAGES_SEEN.sql('t')}, j AS ({_JSON_ROWS('serpd', '$.results', 'url', 'snippet', _POSITION)} UNION ALL {_JSON_ROWS('searxng', '$.results', 'url', 'content', 'NULL')} UNION ALL {_JSON_ROWS('brave', '$.web.results', 'url', 'description', 'NULL')} UNION ALL {_JSON_ROWS('serper', '$.organic', 'link', 'snippet', _POSITION)} UNION ALL {_JSON_ROWS('serpapi', '$.organic_results', 'link', 'snippet', _POSITION)}),
d AS (SELECT id, provider, row_number() OVER (PARTITION BY id) AS place, r->>'title' AS title, r->>'url' AS url, r->>'description' AS snippet, CAST(r->>'rank_absolute' AS INTEGER) AS position FROM (SELECT id, provider, unnest(from_json(json_extract(TRY_CAST(body AS JSON), '$.tasks[0].result[0].items'), '["JSON"]')) AS r FROM t WHERE provider = 'dataforseo') WHERE r->>'type' = 'organic'),
h AS (SELECT id, provider, unnest(string_split(body, 'class="result__a"')[2:]) AS part, generate_subscripts(string_split(body, 'class="result__a"')[2:], 1) AS i FROM t WHERE provider = 'ddg'),
x AS (SELECT id, provider, i, replace(regexp_replace(regexp_extract(part, '^[^>]*>(.*?)</a>', 1), '<[^>]+>', '', 'g'), '&amp;', '&') AS title, replace(regexp_extract(part, '^[^>]*href="([^"]+)"', 1), '&amp;', '&') AS target, regexp_replace(regexp_replace(regexp_extract(part, 'class="result__snippet"[^>]*>(.*?)</a>', 1), '<[^>]+>', '', 'g'), '\\s+', ' ', 'g') AS snippet FROM h),
u AS (SELECT *, CASE WHEN contains(target, 'uddg=') THEN url_decode(regexp_extract(target, 'uddg=([^&]+)', 1)) ELSE target END AS url FROM x)
SELECT id, provider, CAST(place AS INTEGER) AS place, title, url, snippet, position FROM (SELECT * FROM j UNION ALL SELECT * FROM d UNION ALL SELECT id, provider, i, title, CASE WHEN starts_with(url, '//') THEN 'https:' || url ELSE url END, snippet, NULL FROM u)""")
def s9_rows(spark, sf_dir):
    return T.result_rows(PAGES_SEEN.df(spark, sf_dir))


def _stream(spark, sf_dir):
    """events as a stream of files."""
    t = table(spark, sf_dir, "events")
    path = _folder(spark, "events")
    t.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value").write.parquet(path)
    return spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double").parquet(path)


@query("ST2_daily_counts", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events WHERE CAST(ts AS DATE) < (SELECT CAST(max(ts) - INTERVAL 1 DAY AS DATE) FROM events) GROUP BY 1, 2")
def st2(spark, sf_dir):
    """Days that the watermark has closed."""
    out = _folder(spark, "daily")
    ST.drained(ST.daily_counts(_stream(spark, sf_dir), "ts", "event_type"), out, f"{out}-checkpoint")
    return spark.read.schema("day date, event_type string, n long").parquet(out)


@query("ST1_stream_once", "SELECT count(DISTINCT user_id) AS users FROM events")
def st1(spark, sf_dir):
    """Each user once: the watermark is as long as the log."""
    out = _folder(spark, "once")
    ST.drained(ST.once(_stream(spark, sf_dir), "ts", ["user_id"], "400 days"), out, f"{out}-checkpoint")
    return spark.read.parquet(out).agg(F.count("*").alias("users"))


@query("ST6_last_readings", "WITH l AS (SELECT date_trunc('hour', ts) AS h, user_id, arg_max(value, ts) AS value FROM events GROUP BY 1, 2) SELECT count(*) AS readings, count(DISTINCT h) AS hours FROM l")
def st6(spark, sf_dir):
    out = _folder(spark, "last")
    ST.drained(ST.last_readings(_stream(spark, sf_dir), "ts", "user_id", "value"), out, f"{out}-checkpoint", mode="complete")
    return spark.read.parquet(out).agg(F.count("*").alias("readings"), F.countDistinct("start").alias("hours"))
