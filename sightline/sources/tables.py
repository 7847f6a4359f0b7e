"""Readers and sinks: search-metric JSON, append-only logs, suggestions, document folders, XML feeds, saved tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decode_entities

METRIC = "struct<keys:array<string>,page:string,query:string,clicks:double,impressions:double,position:double>"
RANK = "keyword string, position int, url string, provider string, checked_at string"


def metric_rows(bodies: DataFrame, body: str) -> DataFrame:
    """Rows of search-metric bodies: an object with rows, data or results, or a bare list; others give none."""
    wrapped = F.from_json(body, f"rows array<{METRIC}>, data array<{METRIC}>, results array<{METRIC}>")
    listed = F.from_json(body, f"array<{METRIC}>")
    rows = F.when(F.ltrim(body).startswith("["), listed).otherwise(F.coalesce(wrapped["rows"], wrapped["data"], wrapped["results"]))
    return bodies.select(*[c for c in bodies.columns if c != body], F.inline(rows))


def read_appended(spark: SparkSession, path: str, schema: str = RANK) -> DataFrame:
    """Rows of an append-only log of JSON lines; bad and blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def suggestions(body: Column) -> Column:
    """Texts of a suggestion answer in any of its shapes: [query, [texts]], [query, [[text, ...]]], {"suggestions": [{"value": ...}]}, [{"phrase": ...}]; guards before the JSON are dropped."""
    text = F.regexp_replace(body, r"^\)\]\}'\s*", "")
    plain = F.from_json(F.get_json_object(text, "$[1]"), "array<string>")
    nested = F.transform(F.from_json(F.get_json_object(text, "$[1]"), "array<array<string>>"), lambda x: F.get(x, F.lit(0)))
    objects = F.from_json(F.get_json_object(text, "$.suggestions[*].value"), "array<string>")
    phrases = F.from_json(F.get_json_object(text, "$[*].phrase"), "array<string>")
    is_nested = F.get_json_object(text, "$[1][0][0]").isNotNull()
    return F.when(is_nested, nested).otherwise(F.coalesce(plain, objects, phrases, F.array().cast("array<string>")))


def double_encoded(body: Column, schema: str) -> Column:
    """A JSON text whose value is a JSON text."""
    return F.from_json(F.coalesce(F.get_json_object(F.concat(F.lit('{"x":'), body, F.lit("}")), "$.x"), body), schema)


def documents(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("md", "html"), newest: int | None = None) -> DataFrame:
    """(path, modified, text) of a folder and those below; ``newest`` keeps so many by time of change."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    mine = files.where(F.lower(F.substring_index("path", ".", -1)).isin(*suffixes)).select("path", F.col("modificationTime").alias("modified"), F.decode("content", "utf-8").alias("text"))
    return mine.orderBy(F.desc("modified"), "path").limit(newest) if newest else mine


#: Where each provider's answer holds its results, and what it calls their columns.
_PLAIN, _ORGANIC = "struct<title:string,url:string,snippet:string,content:string,description:string,position:int>", "struct<title:string,link:string,snippet:string,position:int>"
_ITEM = "struct<type:string,title:string,url:string,description:string,rank_absolute:int>"
ANSWER = f"ok boolean, results array<{_PLAIN}>, web struct<results:array<{_PLAIN}>>, organic array<{_ORGANIC}>, organic_results array<{_ORGANIC}>, tasks array<struct<result:array<struct<items:array<{_ITEM}>>>>>"
SNIPPET = 300


def _uniform(results: Column, url: str, snippet: str, position: str | None) -> Column:
    empty = lambda c: F.coalesce(c, F.lit(""))
    return F.transform(results, lambda r: F.struct(empty(r["title"]).alias("title"), empty(r[url]).alias("url"), F.left(empty(r[snippet]), F.lit(SNIPPET)).alias("snippet"), (r[position] if position else F.lit(None).cast("int")).alias("position")))


def _from_markup(body: Column) -> Column:
    """Results of a plain result page: links of a class, their targets taken out of the redirect, and the snippets after them."""
    parts = F.slice(F.split(body, 'class="result__a"'), 2, F.greatest(F.length(body), F.lit(1)))
    text = lambda t: F.trim(F.regexp_replace(decode_entities(F.regexp_replace(t, r"<[^>]+>", "")), r"\s+", " "))

    def one(part: Column) -> Column:
        target = F.regexp_replace(F.regexp_extract(part, r'^[^>]*href="([^"]+)"', 1), "&amp;", "&")
        inner = F.regexp_extract(target, r"uddg=([^&]+)", 1)
        url = F.when(inner != "", F.url_decode(inner)).otherwise(target)
        snippet = F.left(text(F.regexp_extract(part, r'(?s)class="result__snippet"[^>]*>(.*?)</a>', 1)), F.lit(SNIPPET))
        return F.struct(text(F.regexp_extract(part, r"(?s)^[^>]*>(.*?)</a>", 1)).alias("title"), F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url).alias("url"), snippet.alias("snippet"), F.lit(None).cast("int").alias("position"))

    return F.transform(parts, one)


def result_rows(answers: DataFrame, provider: str = "provider", body: str = "body") -> DataFrame:
    """answers without their body, with (place, title, url, snippet, position): one row a result, in the order of the answer.

    An answer that is refused, or is not what its provider sends, gives no rows.
    """
    a = F.from_json(body, ANSWER)
    organic = lambda rows: _uniform(rows, "link", "snippet", "position")
    items = F.filter(F.get(F.get(a["tasks"], F.lit(0))["result"], F.lit(0))["items"], lambda x: x["type"] == "organic")
    p = F.col(provider)
    found = (
        F.when(p == "serpd", F.when(a["ok"], _uniform(a["results"], "url", "snippet", "position")))
        .when(p == "searxng", _uniform(a["results"], "url", "content", None))
        .when(p == "brave", _uniform(a["web"]["results"], "url", "description", None))
        .when(p == "serper", organic(a["organic"]))
        .when(p == "serpapi", organic(a["organic_results"]))
        .when(p == "dataforseo", _uniform(items, "url", "description", "rank_absolute"))
        .when(p == "ddg", _from_markup(F.col(body)))
    )
    return answers.select(*[c for c in answers.columns if c != body], F.posexplode(found).alias("place", "r")).select("*", "r.*").drop("r").withColumn("place", F.col("place") + 1)


def feed_items(bodies: DataFrame, body: str) -> DataFrame:
    """(title, link, source, day) of the items of RSS bodies."""
    items = F.regexp_extract_all(body, F.lit(r"(?is)<item\b[^>]*>(.*?)</item>"), F.lit(1))
    one = lambda t, name: F.trim(F.regexp_replace(F.regexp_extract(t, rf"(?is)<{name}\b[^>]*>(.*?)</{name}>", 1), r"^<!\[CDATA\[|\]\]>$", ""))
    each = bodies.select(*[c for c in bodies.columns if c != body], F.explode(items).alias("i"))
    return each.select(*[c for c in each.columns if c != "i"], one(F.col("i"), "title").alias("title"), one(F.col("i"), "link").alias("link"), one(F.col("i"), "source").alias("source"))


def save(df: DataFrame, path: str) -> str:
    """Writes a new version beside the old one and returns its place; readers of the old one are not disturbed."""
    place = f"{path.rstrip('/')}/version-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return place


def save_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").csv(path)
