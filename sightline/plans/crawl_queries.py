"""Queries of access logs and crawl budget."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import crawl as C
from ..operators import referrers as R
from ..operators.registry_bots import ASSET, BOTS, CATEGORIES, OPERATORS
from ..sources import logs as L
from ..sources.shared import shared_root
from .registry import Derived, query, table

AGENTS = Derived(
    "events",
    """CASE event_id % 13 WHEN 0 THEN 'Mozilla/5.0 (compatible; Googlebot/2.' || CAST(user_id % 9 AS STRING) || '; +http://www.google.com/bot.html)' WHEN 1 THEN 'Googlebot-Image/1.' || CAST(user_id % 9 AS STRING) WHEN 2 THEN 'Mozilla/5.0 ... compatible; OAI-SearchBot/1.0'
    WHEN 3 THEN 'Mozilla/5.0 AppleWebKit; compatible; GPTBot/1.' || CAST(user_id % 9 AS STRING) WHEN 4 THEN 'Mozilla/5.0 (Windows NT 10.0; Win64; x64) Chrome/' || CAST(user_id AS STRING) WHEN 5 THEN 'my-crawler/0.1' WHEN 6 THEN '' WHEN 7 THEN NULL WHEN 8 THEN 'Applebot-Extended/0.1'
    WHEN 9 THEN 'Screaming Frog SEO Spider/19' WHEN 10 THEN event_type || ' http client' WHEN 11 THEN 'meta-externalfetcher/1.1' ELSE upper(event_type) || ' ClaudeBot/1.0' END AS ua""",
)


def _chain(text: str, pairs) -> str:
    return "CASE " + " ".join(f"WHEN contains({text}, '{a}') THEN '{b}'" for a, b in pairs) + " END"


KEY = f"coalesce({_chain('lower(coalesce(ua, ' + chr(39) * 2 + '))', [(b[0], b[0]) for b in BOTS])}, CASE WHEN regexp_matches(lower(coalesce(ua, '')), 'bot|crawler|spider|http') THEN 'other-bot' END)"
LABEL = "CASE key " + " ".join(f"WHEN '{b[0]}' THEN '{b[1]}'" for b in BOTS) + " WHEN 'other-bot' THEN 'other-bot' END"
CATEGORY = "CASE key " + " ".join(f"WHEN '{b[0]}' THEN '{b[2]}'" for b in BOTS) + " WHEN 'other-bot' THEN 'unknown' END"
OPERATOR = _chain("key", OPERATORS)


@query("F2_F3_classify_agents", f"WITH {AGENTS.sql('t')}, k AS (SELECT ua, {KEY} AS key FROM t) SELECT ua, key, {LABEL} AS label, {CATEGORY} AS category, {OPERATOR} AS operator FROM k")
def f2(spark, sf_dir):
    k = AGENTS.df(spark, sf_dir).withColumn("key", C.bot_key(F.col("ua")))
    return k.select("ua", "key", C.bot_field(F.col("key"), 1).alias("label"), C.bot_field(F.col("key"), 2).alias("category"), C.operator_of(F.col("key")).alias("operator"))


URIS = Derived(
    "pages",
    """CASE page_id % 7 WHEN 0 THEN '/' || split_part(url, '/', 4) || '/' || split_part(url, '/', 5) WHEN 1 THEN '/assets/' || CAST(page_id AS STRING) || '.JS?v=2' WHEN 2 THEN '//double//' || split_part(url, '/', 5) WHEN 3 THEN '/guides/' || split_part(url, '/', 4) || '/' || split_part(url, '/', 5) || '#c/d'
    WHEN 4 THEN NULL WHEN 5 THEN '/' || split_part(url, '/', 4) ELSE '' END AS uri""",
)


def _silo(uri: str, depth: int) -> str:
    parts = f"list_filter(string_split(regexp_extract(coalesce({uri}, ''), '^[^?#]*'), '/'), lambda p: p <> '')"
    return f"CASE WHEN len({parts}) = 0 THEN '/' WHEN regexp_matches(regexp_extract(coalesce({uri}, ''), '^[^?#]*'), '{ASSET}') THEN '/' || {parts}[1] || '/ (assets)' ELSE '/' || array_to_string({parts}[1:{depth}], '/') || CASE WHEN len({parts}) > {depth} THEN '/*' ELSE '' END END"


@query("F4_F5_silo", f"WITH {URIS.sql('t')} SELECT uri, {_silo('uri', 1)} AS silo1, {_silo('uri', 2)} AS silo2, regexp_matches(coalesce(uri, ''), '{ASSET}') AS asset FROM t")
def f4(spark, sf_dir):
    return URIS.df(spark, sf_dir).select("uri", C.silo(F.col("uri"), 1).alias("silo1"), C.silo(F.col("uri"), 2).alias("silo2"), C.is_asset(F.coalesce("uri", F.lit(""))).alias("asset"))


@query("F4_silo_pages", f"WITH p AS (SELECT regexp_extract(url, '^https?://[^/?#]*(.*)$', 1) AS uri FROM pages) SELECT {_silo('uri', 1)} AS silo, count(*) AS pages FROM p GROUP BY 1")
def f4_pages(spark, sf_dir):
    uri = F.regexp_extract("url", r"^https?://[^/?#]*(.*)$", 1)
    return table(spark, sf_dir, "pages").groupBy(C.silo(uri, 1).alias("silo")).agg(F.count("*").alias("pages"))


LINES = Derived(
    "events",
    "event_id AS id",
    """CASE event_id % 9 WHEN 0 THEN '{"ts": ' || CAST(1735689600 + event_id AS STRING) || '.5, "request": {"remote_ip": "127.0.0.1", "client_ip": "10.0.0.9", "method": "GET", "host": "example.com", "uri": "/s' || CAST(user_id AS STRING) || '?x=1", "headers": {"User-Agent": ["Googlebot/2.1"], "cf-connecting-ip": ["66.249.66.' || CAST(user_id % 250 AS STRING) || '"], "Referer": ["https://x.org/"]}}, "status": 200, "size": ' || CAST(event_id AS STRING) || ', "duration": 0.1}'
    WHEN 1 THEN '{"ts": "2025-01-02T03:04:05Z", "request": {"remote_ip": "198.51.100.4", "method": "GET", "host": "example.com", "uri": "/b' || CAST(user_id AS STRING) || '", "headers": {"User-Agent": ["Mozilla/5.0"], "Cf-Connecting-Ip": ["{http.request.header}"], "X-Forwarded-For": ["203.0.113.' || CAST(user_id % 250 AS STRING) || ', 10.0.0.1"]}}, "status": 404, "size": 0}'
    WHEN 2 THEN '{"ts": ' || CAST(1735689600 + event_id AS STRING) || ', "request": {"remote_ip": "198.51.100.4", "method": "HEAD", "host": "h", "uri": "/c", "headers": {}}, "status": 301}' WHEN 3 THEN '{broken ' || event_type WHEN 4 THEN '{"level": "' || event_type || '"}'
    WHEN 5 THEN '203.0.113.' || CAST(user_id % 250 AS STRING) || ' - - [01/Jan/2025:10:11:' || lpad(CAST(event_id % 60 AS STRING), 2, '0') || ' +0100] "GET /x/' || event_type || ' HTTP/1.1" 200 ' || CAST(event_id AS STRING) || ' "https://ref.example/" "bingbot/2.0"'
    WHEN 6 THEN '203.0.113.10 - frank [01/Jan/2025:10:11:12 +0000] "POST /form' || CAST(user_id AS STRING) || ' HTTP/2" 500 - "-" "curl http"' WHEN 7 THEN '203.0.113.11 - - [01/Jan/2025:23:59:' || lpad(CAST(event_id % 60 AS STRING), 2, '0') || ' -0500] "GET /plain HTTP/1.0" 304 0' ELSE 'garbage ' || event_type END AS line""",
)


PARSED_SQL = rf"""WITH {LINES.sql('t')}, j AS (SELECT id, line, TRY_CAST(line AS JSON) AS d FROM t WHERE ltrim(line) LIKE '{{%'), jr AS (SELECT id, d, d->'request' AS r FROM j),
h AS (SELECT id, d, r, r->>'$.headers."User-Agent"[0]' AS ua, coalesce(r->>'$.headers."Cf-Connecting-Ip"[0]', r->>'$.headers."cf-connecting-ip"[0]') AS cf, r->>'$.headers."X-Forwarded-For"[0]' AS xff, r->>'$.headers."Referer"[0]' AS ref FROM jr),
s AS (SELECT id, r IS NOT NULL AS read, coalesce(CAST(TRY_CAST(d->>'ts' AS DOUBLE) * 1000000 AS BIGINT), epoch_us(TRY_CAST(d->>'ts' AS TIMESTAMPTZ))) AS us, coalesce(CASE WHEN cf <> '' AND cf NOT LIKE '{{%}}' THEN cf END, trim(split_part(xff, ',', 1)), r->>'client_ip', r->>'remote_ip', '') AS ip, coalesce(r->>'method', '') AS method, coalesce(r->>'uri', '') AS uri, coalesce(CAST(d->>'status' AS INTEGER), 0) AS status, coalesce(CAST(d->>'size' AS BIGINT), 0) AS size, coalesce(ua, '') AS ua, coalesce(ref, '') AS referer FROM h),
c AS (SELECT id, regexp_matches(line, '{L.COMBINED}') AS read, regexp_extract(line, '{L.COMBINED}', ['host', 'user', 'time', 'method', 'uri', 'proto', 'status', 'size', 'referer', 'ua']) AS g FROM t WHERE ltrim(line) NOT LIKE '{{%'),
cc AS (SELECT id, read, epoch_us(strptime(CASE WHEN read THEN g.time END, '%d/%b/%Y:%H:%M:%S %z')) AS us, g.host AS ip, g.method AS method, g.uri AS uri, CAST(CASE WHEN g.status <> '' THEN g.status ELSE '0' END AS INTEGER) AS status, CAST(CASE WHEN regexp_matches(g.size, '^\d+$') THEN g.size ELSE '0' END AS BIGINT) AS size, g.ua AS ua, CASE WHEN g.referer = '-' THEN '' ELSE g.referer END AS referer FROM c),
u AS (SELECT * FROM s UNION ALL SELECT * FROM cc)
SELECT id, read, CASE WHEN read THEN us END AS us, CASE WHEN read THEN ip END AS ip, CASE WHEN read THEN method END AS method, CASE WHEN read THEN uri END AS uri, CASE WHEN read THEN status END AS status, CASE WHEN read THEN size END AS size, CASE WHEN read THEN ua END AS ua, CASE WHEN read THEN referer END AS referer FROM u"""


@query("S3_S4_S6_parse_lines", PARSED_SQL)
def s3(spark, sf_dir):
    r = LINES.df(spark, sf_dir).withColumn("r", L.parse_any(F.col("line"))).select("id", F.col("r").isNotNull().alias("read"), "r.*")
    return r.select("id", "read", F.unix_micros("ts").alias("us"), "ip", "method", "uri", "status", "size", "ua", "referer")


CUSTOM = Derived(
    "events",
    "event_id AS id",
    "CASE event_id % 4 WHEN 0 THEN '2025-01-01T00:00:' || lpad(CAST(event_id % 60 AS STRING), 2, '0') || 'Z|1.2.3.' || CAST(user_id % 250 AS STRING) || '|/' || event_type || '|200|77|Googlebot' WHEN 1 THEN '2025-01-01T00:00:00Z|{ip}|/q|404|-|' || event_type WHEN 2 THEN '2025-01-02T00:00:00Z|9.9.9.9||500|' || CAST(event_id AS STRING) || '|' ELSE 'nothing ' || event_type END AS line",
)
CUSTOM_PATTERN = r"^([^|]*)\|([^|]*)\|([^|]*)\|(\d+)\|([^|]*)\|(.*)$"


@query("S5_custom_lines", rf"""WITH {CUSTOM.sql('t')}, g AS (SELECT id, regexp_matches(line, '{CUSTOM_PATTERN}') AS read, regexp_extract(line, '{CUSTOM_PATTERN}', ['time', 'ip', 'path', 'status', 'size', 'agent']) AS g FROM t)
SELECT id, epoch_us(TRY_CAST(g.time AS TIMESTAMPTZ)) AS us, CASE WHEN read THEN CASE WHEN g.ip LIKE '{{%}}' THEN '' ELSE g.ip END END AS ip, CASE WHEN read THEN g.path END AS uri, CASE WHEN read THEN CAST(nullif(g.status, '') AS INTEGER) END AS status, CASE WHEN read THEN CASE WHEN regexp_matches(g.size, '^\d+$') THEN CAST(nullif(g.size, '') AS BIGINT) ELSE 0 END END AS size, CASE WHEN read THEN g.agent END AS ua FROM g""")
def s5(spark, sf_dir):
    r = CUSTOM.df(spark, sf_dir).withColumn("r", L.parse_custom(F.col("line"), CUSTOM_PATTERN, ["time", "ip", "path", "status", "size", "agent"]))
    return r.select("id", F.unix_micros("r.ts").alias("us"), "r.ip", "r.uri", "r.status", "r.size", "r.ua")


@query("S1_S2_read_logs", f"SELECT read, ip, uri, status FROM ({PARSED_SQL})")
def s1(spark, sf_dir):
    """Lines of a plain and a gzipped log, by list and by pattern; written here first."""
    root = shared_root(spark)
    place = f"{root}/logs-{uuid.uuid4().hex}"
    lines = LINES.df(spark, sf_dir).select(F.col("line").alias("value"))
    lines.where("value NOT LIKE '{%'").write.text(f"{place}/plain")
    lines.where("value LIKE '{%'").write.option("compression", "gzip").text(f"{place}/packed")
    return L.parsed(L.read_lines(spark, [f"{place}/packed", f"{place}/plain/*.txt"])).select("read", "ip", "uri", "status")


#: events stands in for a log: event type as crawler, user as address, value as size, ts as time, k of props as path.
EVENTS = "e AS (SELECT CASE event_type WHEN 'signup' THEN 'gptbot' WHEN 'error' THEN 'bingbot' WHEN 'click' THEN 'googlebot' WHEN 'view' THEN 'Mozilla' ELSE 'other spider' END AS ua, 'ip' || CAST(user_id AS VARCHAR) AS ip, '/s' || CAST(user_id % 7 AS VARCHAR) || '/p' || (props->>'k') || CASE WHEN user_id % 5 = 0 THEN '.png' ELSE '' END AS uri, CAST(CASE WHEN value < 5 THEN 404 ELSE 200 END AS INTEGER) AS status, CAST(floor(value * 1000) AS BIGINT) AS size, ts FROM events), k AS (SELECT *, " + KEY + " AS key FROM e), b AS (SELECT *, " + CATEGORY + " AS category, " + OPERATOR + " AS operator FROM k WHERE key IS NOT NULL)"


def records(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ua = F.when(F.col("event_type") == "signup", "gptbot").when(F.col("event_type") == "error", "bingbot").when(F.col("event_type") == "click", "googlebot").when(F.col("event_type") == "view", "Mozilla").otherwise("other spider")
    uri = F.concat(F.lit("/s"), (F.col("user_id") % 7).cast("string"), F.lit("/p"), F.get_json_object("props", "$.k"), F.when(F.col("user_id") % 5 == 0, ".png").otherwise(""))
    return e.select(ua.alias("ua"), F.concat(F.lit("ip"), F.col("user_id").cast("string")).alias("ip"), uri.alias("uri"), F.when(F.col("value") < 5, 404).otherwise(200).alias("status"), F.floor(F.col("value") * 1000).cast("long").alias("size"), "ts", F.lit(True).alias("read"))


@query("A1_A2_crawl_budget", f"""WITH {EVENTS}, g AS (SELECT key, count(*) AS hits, sum(size) AS bytes, count(DISTINCT split_part(uri, '?', 1)) AS unique_urls, count(DISTINCT ip) AS distinct_ips, count(DISTINCT CAST(ts AS DATE)) AS days, count(*) FILTER (regexp_matches(uri, '{ASSET}')) AS assets, count(*) FILTER (status >= 400) AS errors, min(ts) AS first_seen, max(ts) AS last_seen FROM b GROUP BY 1)
SELECT key, hits, round(hits / days, 1) AS hits_per_day, days AS days_seen, unique_urls, distinct_ips, round(CAST(bytes AS DOUBLE) / 1048576, 1) AS mb, round(assets / hits, 3) AS asset_share, round(errors / hits, 4) AS error_rate, first_seen, last_seen FROM g""")
def a1(spark, sf_dir):
    return C.budget(C.bot_hits(records(spark, sf_dir)))


@query("F7_bot_restriction", f"WITH {EVENTS} SELECT key, count(*) AS hits FROM b WHERE key IN ('googlebot', 'other-bot') GROUP BY 1")
def f7(spark, sf_dir):
    return C.bot_hits(records(spark, sf_dir), ["googlebot", "other-bot"]).groupBy("key").agg(F.count("*").alias("hits"))


_ORDER = "CAST(coalesce(nullif(list_position([" + ", ".join(f"'{c}'" for c in (*CATEGORIES, "unknown")) + "], category), 0), 99) AS BIGINT)"


@query("A3_W6_category_share", f"WITH {EVENTS} SELECT category, count(*) AS hits, round(count(*) / (SELECT count(*) FROM b), 3) AS share, {_ORDER} AS ordinal FROM b GROUP BY 1")
def a3(spark, sf_dir):
    return C.by_category(C.bot_hits(records(spark, sf_dir)))


@query("A4_totals", f"WITH {EVENTS}, t AS (SELECT count(*) AS lines, CAST(0 AS BIGINT) AS unread, count(*) FILTER (key IS NULL) AS human, count(*) FILTER (key IS NOT NULL) AS bots FROM k) SELECT *, round(unread / lines, 4) AS unread_share, round(bots / (bots + human), 3) AS bot_share FROM t")
def a4(spark, sf_dir):
    return C.totals(records(spark, sf_dir))


UNREAD = Derived("documents", "CASE WHEN doc_id % 2 = 0 THEN coalesce(source, 'none') || ' ' || coalesce(lang, 'none') ELSE '{' || coalesce(source, 'none') END AS line")


@query("A4_nothing_read", rf"""WITH {UNREAD.sql('t')}, r AS (SELECT (TRY_CAST(line AS JSON)->'request') IS NOT NULL OR regexp_matches(line, '{L.COMBINED}') AS read FROM t), c AS (SELECT count(*) AS lines, count(*) FILTER (NOT read) AS unread, count(*) FILTER (read) AS human, CAST(0 AS BIGINT) AS bots FROM r)
SELECT *, round(unread / lines, 4) AS unread_share, CASE WHEN bots + human > 0 THEN round(bots / (bots + human), 3) END AS bot_share FROM c""")
def a4_nothing(spark, sf_dir):
    return C.totals(L.parsed(UNREAD.df(spark, sf_dir)))


@query("A5_top_silos", f"WITH {EVENTS}, c AS (SELECT key, {_silo('uri', 1)} AS item, count(*) AS n FROM b GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, item) AS rank FROM c) SELECT * FROM r WHERE rank <= 3")
def a5(spark, sf_dir):
    """A5, O9: the most frequent three of each crawler (a top-k report)."""
    return C.top_k(C.bot_hits(records(spark, sf_dir)), ["key"], C.silo(F.col("uri"), 1), 3)


@query("A46_verify_candidates", f"WITH {EVENTS}, c AS (SELECT key, ip AS item, count(*) AS n FROM b GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, item) AS rank FROM c) SELECT * FROM r WHERE rank <= 5")
def a46(spark, sf_dir):
    return C.top_k(C.bot_hits(records(spark, sf_dir)), ["key"], F.col("ip"), 5)


_SPOOFED = "f AS (SELECT ip, count(DISTINCT operator) AS operator_count, string_agg(DISTINCT operator, ',' ORDER BY operator) AS operators, string_agg(DISTINCT bot, ',' ORDER BY bot) AS crawlers, count(*) AS hits FROM (SELECT *, " + LABEL + " AS bot FROM b) WHERE operator IS NOT NULL GROUP BY 1 HAVING count(DISTINCT operator) >= 2)"


@query("A6_J19_spoofed_agents", f"WITH {EVENTS}, {_SPOOFED} SELECT * FROM f")
def a6(spark, sf_dir):
    return C.spoofed(C.bot_hits(records(spark, sf_dir)))


@query("A6_spoof_report", f"WITH {EVENTS}, {_SPOOFED}, r AS (SELECT *, row_number() OVER (ORDER BY operator_count DESC, hits DESC, ip) AS rank, count(*) OVER () AS flagged, CAST(sum(hits) OVER () AS BIGINT) AS spoofed_hits FROM f) SELECT * FROM r WHERE rank <= 25")
def a6_report(spark, sf_dir):
    """The 25 worst addresses (a top-k report), with the totals of all."""
    return C.spoof_report(C.spoofed(C.bot_hits(records(spark, sf_dir))))


@query("A1_counters", f"""WITH {EVENTS}, c AS (SELECT key, 'status' AS kind, CAST(status AS VARCHAR) AS item FROM b UNION ALL SELECT key, 'silo', {_silo('uri', 1)} FROM b UNION ALL SELECT key, 'day', strftime(ts, '%Y-%m-%d') FROM b UNION ALL SELECT key, 'agent', left(ua, 120) FROM b UNION ALL SELECT key, 'error', CAST(status AS VARCHAR) || ' ' || split_part(uri, '?', 1) FROM b WHERE status >= 400)
SELECT key, kind, item, count(*) AS n FROM c GROUP BY 1, 2, 3""")
def a1_counters(spark, sf_dir):
    return C.counters(C.bot_hits(records(spark, sf_dir)))


@query("F1_ST3_recent", "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY GROUP BY 1")
def f1(spark, sf_dir):
    return C.recent(table(spark, sf_dir, "events"), "ts", "2024-01-31", 7).groupBy("event_type").agg(F.count("*").alias("n"))


DATED = Derived("sales", "sale_id AS id", "CASE WHEN sale_id % 10 <> 3 THEN substr(CAST(sold_at AS STRING), 1, 10) END AS d")


@query("F1_keeps_undated", f"WITH {DATED.sql('t')} SELECT id FROM t WHERE d IS NULL OR CAST(d AS TIMESTAMP) >= TIMESTAMP '2024-02-02' - INTERVAL 7 DAY")
def f1_undated(spark, sf_dir):
    return C.recent(DATED.df(spark, sf_dir).withColumn("ts", F.to_timestamp("d")), "ts", "2024-02-02", 7).select("id")


STATUSES = Derived("events", "event_id", "CAST(200 + event_id % 4 * 100 + user_id % 6 AS INT) AS status")


@query("F6_status_filter", f"WITH {STATUSES.sql('t')} SELECT event_id, status FROM t WHERE status BETWEEN 500 AND 599 OR status = 404")
def f6(spark, sf_dir):
    return STATUSES.df(spark, sf_dir).where(C.status_filter("status", "5xx, 404"))


RESOLVED = Derived(
    "events",
    "event_id",
    "'1.1.' || CAST(user_id AS STRING) || '.' || CAST(event_id % 250 AS STRING) AS ip",
    "CASE event_id % 8 WHEN 1 THEN ARR('evil.example') WHEN 2 THEN ARR() WHEN 3 THEN NULL WHEN 7 THEN ARR('x.y') ELSE ARR('crawl-' || CAST(event_id AS STRING) || '.googlebot.com') END AS ptr",
    "CASE event_id % 8 WHEN 2 THEN ARR() WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN ARR() WHEN 6 THEN ARR('9.9.9.9') ELSE ARR('1.1.' || CAST(user_id AS STRING) || '.' || CAST(event_id % 250 AS STRING)) END AS fwd",
    "CASE WHEN event_id % 8 = 7 THEN ARR() WHEN event_type = 'click' THEN ARR('.googlebot.com', '.google.com') ELSE ARR('.googlebot.com') END AS suffixes",
)


@query("R18_verify_addresses", f"""WITH {RESOLVED.sql('t')}, v AS (SELECT ip, CASE WHEN len(suffixes) = 0 THEN 'unverifiable' WHEN ptr IS NULL THEN 'unknown' WHEN len(ptr) = 0 THEN 'no_ptr' WHEN len(list_filter(ptr, lambda p: len(list_filter(suffixes, lambda s: ends_with(p, s))) > 0)) = 0 THEN 'wrong_name' WHEN fwd IS NULL THEN 'unknown' WHEN list_contains(fwd, ip) THEN 'verified' WHEN len(fwd) = 0 THEN 'unproven' ELSE 'forward_mismatch' END AS verdict FROM t)
SELECT ip, verdict, CASE WHEN verdict = 'verified' THEN true WHEN verdict IN ('no_ptr', 'wrong_name', 'forward_mismatch') THEN false END AS verified FROM v""")
def r18(spark, sf_dir):
    return C.verify(RESOLVED.df(spark, sf_dir))


@query("R18_control_failed", f"WITH {RESOLVED.sql('t')} SELECT ip, 'control_failed' AS verdict, CAST(NULL AS BOOLEAN) AS verified FROM t")
def r18_control(spark, sf_dir):
    return C.verify(RESOLVED.df(spark, sf_dir), control=False)


@query("J7_sitemap_gap", f"""WITH p AS (SELECT url LIKE 'https%' AS secure, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages), c AS (SELECT DISTINCT path FROM p WHERE secure), s AS (SELECT DISTINCT path FROM p WHERE NOT secure)
SELECT path, 'never_crawled' AS state FROM s WHERE path NOT IN (SELECT path FROM c) UNION ALL SELECT path, 'not_in_sitemap' FROM c WHERE path NOT IN (SELECT path FROM s) AND NOT regexp_matches(path, '{ASSET}') UNION ALL SELECT path, 'crawled' FROM s WHERE path IN (SELECT path FROM c)""")
def j7(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("url").startswith("https").alias("secure"), F.regexp_extract("url", r"^https?://[^/?#]*([^?#]*)", 1).alias("path"))
    return C.sitemap_gap(p.where("secure"), p.where("not secure"))


SITEMAP = Derived(
    "pages",
    "page_id AS id",
    "CASE page_id % 4 WHEN 0 THEN '<urlset><url><loc> ' || url || ' </loc></url><url><loc>https://a.b/' || split_part(url, '/', 4) || '/y</loc></url></urlset>' WHEN 1 THEN '<sitemapindex><sitemap><loc>' || url || '/s1.xml</loc></sitemap></sitemapindex>' WHEN 2 THEN '<urlset><url><loc>' || url || '</loc></url></urlset>' ELSE '<html>no</html>' END AS body",
)


@query("S11_F31_sitemap", rf"""WITH {SITEMAP.sql('t')}, l AS (SELECT id, contains(body, '<sitemapindex') AS is_index, unnest(regexp_extract_all(body, '<loc>\s*([^<\s]+)\s*</loc>', 1)) AS loc FROM t) SELECT id, is_index, loc, regexp_matches(loc, '^https?://[^/]+/[a-z][a-z](?:/|$)') AS locale FROM l""")
def s11(spark, sf_dir):
    from ..sources.sitemaps import locations

    return locations(SITEMAP.df(spark, sf_dir), "body").select("id", "is_index", "loc", F.col("loc").rlike(r"^https?://[^/]+/[a-z][a-z](?:/|$)").alias("locale"))


REFERRERS = Derived(
    "events",
    "event_id AS id",
    """CASE event_id % 14 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'https://www.example.com/' || event_type WHEN 3 THEN 'https://blog.example.com/' WHEN 4 THEN 'http://localhost:8282/x' WHEN 5 THEN 'http://192.168.1.' || CAST(user_id % 250 AS STRING) || '/' WHEN 6 THEN 'https://www.google.de/search?q=' || event_type WHEN 7 THEN 'https://chatgpt.com/'
    WHEN 8 THEN 'https://news' || CAST(user_id % 5 AS STRING) || '.site.org/p?' || CAST(user_id % 3 AS STRING) WHEN 9 THEN 'https://news' || CAST(user_id % 5 AS STRING) || '.site.org/q' WHEN 10 THEN 'https://other' || CAST(user_id % 40 AS STRING) || '.net/' || event_type WHEN 11 THEN 'http://a.local/' WHEN 12 THEN 'nonsense' ELSE 'https://www.bing.com/' END AS referer""",
    "'/' || event_type || CASE WHEN user_id % 2 = 0 THEN '?x' ELSE '' END AS uri",
    "event_id % 9 AS day",
)
_CONTAINS = lambda hosts: " OR ".join(f"contains(h, '{x}')" for x in hosts)
_CLASS = f"""CASE WHEN coalesce(trim(referer), '') = '' THEN 'direct' WHEN h = '' THEN NULL WHEN h = 'example.com' OR ends_with(h, '.example.com') THEN 'internal'
WHEN split_part(h, ':', 1) IN ({', '.join(repr(x) for x in R.LOCAL)}) OR regexp_matches(split_part(h, ':', 1), '\\.localhost$|\\.local$|^(192\\.168\\.|10\\.|172\\.16\\.|172\\.17\\.|172\\.18\\.|169\\.254\\.)') THEN 'local'
WHEN {_CONTAINS(R.SEARCH)} THEN 'search' WHEN {_CONTAINS(R.ASSISTANTS)} THEN 'ai' ELSE 'backlink' END"""
_REF = f"{REFERRERS.sql('t')}, x AS (SELECT *, regexp_replace(lower(regexp_extract(coalesce(referer, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') AS h FROM t), c AS (SELECT *, {_CLASS} AS class FROM x)"


@query("F9_F10_referrer_class", f"WITH {_REF} SELECT id, h AS host, class FROM c")
def f9(spark, sf_dir):
    return R.classified(REFERRERS.df(spark, sf_dir), "example.com").select("id", "host", "class")


@query("A7_backlinks", f"""WITH {_REF}, b AS (SELECT *, split_part(uri, '?', 1) AS landing, left(referer, 180) AS source FROM c WHERE class = 'backlink'),
s AS (SELECT h, source, row_number() OVER (PARTITION BY h ORDER BY count(*) DESC, source) AS rn FROM b GROUP BY 1, 2),
l AS (SELECT h, string_agg(landing || '=' || CAST(n AS VARCHAR), ' ' ORDER BY n DESC, landing) AS landings FROM (SELECT h, landing, count(*) AS n, row_number() OVER (PARTITION BY h ORDER BY count(*) DESC, landing) AS rn FROM b GROUP BY 1, 2) WHERE rn <= 3 GROUP BY 1)
SELECT h AS host, count(*) AS visits, count(DISTINCT b.source) AS sources, max(s.source) FILTER (rn = 1) AS top_source, max(landings) AS top_landings, min(day) AS first_seen, max(day) AS last_seen FROM b JOIN (SELECT * FROM s WHERE rn = 1) s USING (h) JOIN l USING (h) GROUP BY 1""")
def a7(spark, sf_dir):
    return R.backlinks(R.classified(REFERRERS.df(spark, sf_dir), "example.com"), "day")


@query("A7_referrals", f"WITH {_REF} SELECT 'all' AS class, '' AS host, count(*) AS visits FROM c UNION ALL SELECT class, CASE WHEN class IN ('search', 'ai') THEN h ELSE '' END, count(*) FROM c WHERE class IS NOT NULL GROUP BY 1, 2")
def a7_referrals(spark, sf_dir):
    return R.referrals(R.classified(REFERRERS.df(spark, sf_dir), "example.com"))


CAPTURES = Derived(
    "events",
    "'h' || CAST(user_id % 40 AS STRING) || '.com' AS host",
    "CASE WHEN user_id % 3 = 0 THEN CASE WHEN event_id % 5 = 0 THEN 'absent' ELSE 'error' END WHEN event_type = 'view' THEN 'absent' ELSE 'present' END AS state",
    "CASE WHEN user_id % 3 <> 0 AND event_type <> 'view' THEN 'http://h.com/' || CAST(event_id % 7 AS STRING) || CASE WHEN event_id % 2 = 0 THEN '#x' ELSE '' END END AS url",
    "CASE WHEN user_id % 3 <> 0 AND event_type <> 'view' THEN CASE WHEN event_id % 4 = 0 THEN '404' ELSE '200' END END AS status",
    "CASE WHEN user_id % 3 <> 0 AND event_type <> 'view' THEN 'text/html' END AS mime",
)


@query("A42_footprint", f"WITH {CAPTURES.sql('t')} SELECT host, CASE WHEN bool_or(state = 'present') THEN 'present' WHEN bool_or(state = 'absent') THEN 'absent' ELSE 'unknown' END AS verdict, count(DISTINCT split_part(url, '#', 1)) AS urls, count(*) FILTER (status = '200') AS ok_captures FROM t GROUP BY 1")
def a42(spark, sf_dir):
    return R.footprint(CAPTURES.df(spark, sf_dir))
