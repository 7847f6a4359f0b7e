"""Pages: features of their markup, what agents can do with them, and the structure that competitors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.text import word_count
from .order_stats import order_statistics

#: Heading words that tell no subtopic.
HEADING_STOP = """a an the and or of for to in on with without your you how what why is are be can do does not it its this that then than from at as by best top guide tutorial vs cs counter strike 1 6 16 2024 2025 2026 free online play navigation nav menu footer header sidebar search subscribe newsletter comments comment related share cookies cookie privacy policy terms login signin signup account filter filters results projects categories category tags tag archive home page site links link more read about contact follow us social advertisement recommended popular latest trending posts post reply replies thread quote""".split()
FORM_FIELD = r"(?i)<(?:input|select|textarea)\b[^>]*>"


def social_meta(html: Column) -> Column:
    """Map of the og: and twitter: properties; of repeated ones the last counts."""
    name = lambda t: F.lower(F.coalesce(F.nullif(H.value(t, "property"), F.lit("")), H.value(t, "name")))
    found = F.filter(F.transform(H.tags(html, "meta"), lambda t: F.struct(name(t).alias("key"), H.value(t, "content").alias("value"))), lambda m: m["key"].startswith("og:") | m["key"].startswith("twitter:"))
    # a lambda over a single element names the list once
    last = lambda ms: F.filter(ms, lambda m, i: ~F.exists(F.slice(ms, i + 2, F.greatest(F.size(ms), F.lit(1))), lambda n: n["key"] == m["key"]))
    return F.map_from_entries(F.element_at(F.transform(F.array(found), last), 1))


def page_features(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """pages with what one reading of the markup gives (see the columns); links with a bare host count as internal where pages have their url."""
    doc = F.col(html)
    site = F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1) if url in pages.columns else F.lit("")
    targets = F.regexp_extract_all(doc, F.lit(r"""(?i)<a\b[^>]*\bhref\s*=\s*["']([^"']*)"""), F.lit(1))
    head, after = H.head(doc), H.body(doc)
    text = H.without(F.when(after != "", after).otherwise(doc), H.SCRIPT_STYLE)
    return pages.withColumns(
        {
            "alternates": H.alternates(head), "alternates_in_body": H.alternates(after), "switcher_links": F.array_sort(F.array_distinct(F.transform(F.filter(H.tags(doc, "a"), lambda t: H.value(t, "hreflang") != ""), lambda t: H.value(t, "hreflang")))),
            "canonical": F.nullif(F.trim(H.value(F.try_element_at(H.links(head, "canonical"), F.lit(-1)), "href")), F.lit("")), "html_lang": F.nullif(H.value(F.try_element_at(H.tags(doc, "html"), F.lit(1)), "lang"), F.lit("")),
            "robots": H.named_meta(head, "robots"), "description": H.named_meta(head, "description"), "title": F.try_element_at(H.inner(head, "title"), F.lit(1)), "h1": H.inner(doc, "h1"),
            "h2_count": H.count(doc, r"(?i)<h2\b"), "h3_count": H.count(doc, r"(?i)<h3\b"), "img_count": H.count(doc, r"(?i)<img\b"), "schema_types": F.array_sort(F.array_distinct(F.regexp_extract_all(doc, F.lit(r'"@type"\s*:\s*"([^"]+)"'), F.lit(1)))),
            "words": word_count(H.decode_once(F.regexp_replace(text, H.TAG, " "))), "internal_links": F.size(F.filter(targets, lambda t: t.startswith("/") | ((site != "") & t.startswith(site)))), "social": social_meta(doc), "body_hash": F.substring(F.sha2(H.plain(H.without(doc, H.SCRIPT_STYLE)), 256), 1, 16),
        }
    )


def profile(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with words and headings outside of chrome, and what they hold."""
    body = H.without(F.col(html), r"(?is)<(script|style|noscript)\b.*?</\1\s*>", H.COMMENT, H.CHROME)
    years = F.regexp_extract_all(F.col(html), F.lit(r"\b(20[12]\d)-(?:0[1-9]|1[0-2])-(?:[0-2]\d|3[01])\b"), F.lit(1))
    heads = F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<h[23]\b[^>]*>(.*?)</h[23]>"), F.lit(1)), lambda t: safe_heading(F.regexp_replace(t, H.TAG, "")))
    return pages.withColumns({"words": word_count(H.plain(body)), "headings": F.slice(F.filter(heads, lambda h: h != ""), 1, 25), "heading_count": F.size(heads), "has_table": body.rlike(r"(?i)<table\b"), "has_code": body.rlike(r"(?i)<(pre|code)\b"), "images": H.count(body, r"(?i)<img\b"), "newest_year": F.array_max(years)})


def safe_heading(text: Column) -> Column:
    """Collapsed, at most 110 characters, without wording that is meant as an instruction."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.left(F.regexp_replace(flat, r"(?i)\b(ignore|disregard|forget)\b\s+(all\s+)?(previous|prior|above)\b", "[redacted-injection-shape]"), F.lit(110))


def subtopics(profiles: DataFrame) -> DataFrame:
    """(subtopic, covered_by, share, contract): heading words by pages that have them; contract from max(2, half) pages on. Pages of users do not vote."""
    voters = profiles.where("ok and not ugc")
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.array_join("headings", " \n ")), F.lit(r"[a-z][a-z0-9'\-]{2,}"), F.lit(0)), lambda w: ~F.array_contains(F.array(*[F.lit(x) for x in HEADING_STOP]), w)))
    n = voters.agg(F.count("*").alias("n"))
    counts = voters.select(F.explode(words).alias("subtopic")).groupBy("subtopic").agg(F.count("*").alias("covered_by"))
    least = F.greatest(F.lit(2), F.floor((F.col("n") + 1) / 2))
    return counts.crossJoin(F.broadcast(n)).select("subtopic", "covered_by", F.round(F.col("covered_by") / F.col("n"), 2).alias("share"), (F.col("covered_by") >= least).alias("contract"))


def depth_stats(profiles: DataFrame) -> DataFrame:
    """Upper medians and counts over the pages that could be read; the failed ones are counted, not averaged in."""
    total = profiles.agg(F.count_if("ok").alias("read"), F.count_if(~F.col("ok")).alias("failed"), F.max(F.when(F.col("ok"), F.col("words"))).alias("most_words"), F.count_if(F.col("ok") & F.col("has_table")).alias("with_table"))

    upper = lambda value, name: order_statistics(profiles.where("ok"), value, {name: 0.5}).agg(F.max(name).alias(name))
    out = total.crossJoin(F.broadcast(upper("words", "median_words"))).crossJoin(F.broadcast(upper("heading_count", "median_headings")))  # one row each
    return out.select("read", "failed", "median_words", "median_headings", "most_words", "with_table")


def weak_results(profiles: DataFrame) -> DataFrame:
    """(url, why) of results that a better page could beat; an old date only annotates."""
    why = F.concat_ws(
        ", ", F.when(F.col("ugc"), "UGC/forum/video"), F.when(F.col("words") < 600, F.concat(F.lit("thin ("), F.col("words").cast("string"), F.lit(" words)"))), F.when(F.col("heading_count") < 2, "no heading structure"),
        F.when(F.col("newest_year") < "2024", F.concat(F.lit("nothing dated after "), F.col("newest_year"))),
    )
    return profiles.where(F.col("ok") & (F.col("ugc") | (F.col("words") < 600) | (F.col("heading_count") < 2))).select("url", why.alias("why"))


def contract_note(n: Column, shared: Column) -> Column:
    return F.when(n == 0, "only user pages: no structure to share").when(n < 3, "fewer than three pages: a weak contract").when(shared == 0, "no subtopic is shared by half of the pages").otherwise("ok")


#: The patterns below are those that pages are told by.
def agent_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with what an agent finds: text share, fake buttons, dead anchors, unlabelled fields, landmarks, images."""
    doc = F.col(html)
    markup = H.without(doc, H.COMMENT, r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>")
    text = H.plain(H.without(doc, r"(?is)<(script|style|noscript)\b.*?</\1\s*>"))
    static = H.plain(H.without(F.regexp_replace(doc, r"(?is)^.*?<body[^>]*>", ""), r"(?is)<(script|style|noscript)\b.*?</\1\s*>"))
    labelled = F.regexp_extract_all(markup, F.lit(r'(?i)<label\b[^>]*\bfor\s*=\s*"([^"]+)"'), F.lit(1))
    fields = F.filter(F.regexp_extract_all(markup, F.lit(FORM_FIELD), F.lit(0)), lambda t: ~t.rlike(r'(?i)\btype\s*=\s*"(hidden|submit|button|image)"') & ~t.rlike(r"(?i)\baria-label(?:ledby)?\s*="))
    ident = lambda t: F.regexp_extract(t, r'(?i)\bid\s*=\s*"([^"]+)"', 1)
    return pages.withColumns(
        {
            "html_bytes": F.octet_length(doc), "text_ratio": F.round(F.try_divide(F.octet_length(text), F.octet_length(doc)), 4), "tokens": F.round(F.length(text) / 4).cast("long"), "static_chars": F.length(static), "doc_chars": F.length(doc),
            "fake_buttons": H.count(markup, r"(?i)<(?:div|span)\b(?![^>]*\brole=)(?![^>]*\btabindex=)[^>]*\bon(?:click|mousedown)\s*="), "dead_anchors": H.count(markup, r"(?i)<a\b(?![^>]*\bhref=)[^>]*>"),
            "unlabelled": F.size(F.filter(fields, lambda t: (ident(t) == "") | ~F.array_contains(labelled, ident(t)))), "has_main": markup.rlike(r"(?i)<main\b"), "no_alt": H.count(markup, r"(?i)<img\b(?![^>]*\balt\s*=)[^>]*>"),
            "tool_form": doc.rlike(r"(?i)<form\b[^>]*\btool(?:name|description)\s*="), "tool_script": doc.rlike(r"navigator\.modelContext|provideContext\s*\("), "markdown_link": doc.rlike(r'(?i)<link\b[^>]*rel="alternate"[^>]*type="text/(?:markdown|plain)"[^>]*>'),
        }
    )


def agent_findings(counts: DataFrame, key: str) -> DataFrame:
    """(key, severity, rule): one row a rule that a page trips."""
    c = F.col
    rules = [
        ("medium", "low_text_ratio", (c("text_ratio") < 0.05) & (c("html_bytes") > 20000)), ("medium", "oversized_for_context", c("tokens") > 30000), ("critical", "requires_javascript", (c("static_chars") < 200) & (c("doc_chars") > 5000)), ("high", "div_onclick_without_role", c("fake_buttons") > 0),
        ("medium", "anchor_without_href", c("dead_anchors") > 2), ("high", "unlabelled_input", c("unlabelled") > 0), ("medium", "no_main_landmark", ~c("has_main")), ("low", "img_without_alt", c("no_alt") > 0),
    ]
    return fired(counts, [key], rules)


def fired(df: DataFrame, keys: list[str], rules: list[tuple[str, str, Column]]) -> DataFrame:
    """(keys, severity, rule) of the rules (severity, rule, condition) that hold, in one pass."""
    found = F.filter(F.array(*[F.when(condition, F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"))) for severity, rule, condition in rules]), lambda x: x.isNotNull())
    return df.select(*keys, F.inline(found))
