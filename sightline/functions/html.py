"""HTML expressions by pattern: scripts, styles and comments go first, then what is asked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, decode_entities, found

SCRIPT_STYLE = r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>"
CHROME = r"(?is)<(nav|header|footer|aside)\b.*?</\1\s*>"
COMMENT = r"(?s)<!--.*?-->"
TAG = r"<[^>]+>"


def head(html: Column | str) -> Column:
    """What stands before the first </head>, or all."""
    return F.regexp_extract(col(html), r"(?is)^(.*?)(?:</head\s*>|$(?![\s\S]))", 1)


def body(html: Column | str) -> Column:
    """What stands after the first </head>, or nothing."""
    return F.regexp_extract(col(html), r"(?is)</head\s*>(.*)$", 1)


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in any of the three ways of quoting; empty if there is none."""
    return F.regexp_extract(tag, rf"""(?i)(?:^|[\s"'])""" + name + r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s">]+))""", 0)


def value(tag: Column, name: str) -> Column:
    whole = attribute(tag, name)
    return decode_once(F.regexp_replace(F.regexp_replace(whole, r"(?is)^[^=]*=\s*", ""), r"""^["']|["']$""", ""))


def decode_once(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "&quot;", '"'), "&#39;", "'"), "&amp;", "&")


def tags(html: Column, name: str) -> Column:
    return found(html, rf"(?i)<{name}\b[^>]*>")


def plain(html: Column) -> Column:
    """Text without tags, spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, TAG, " "), r"\s+", " "))


def inner(html: Column, name: str) -> Column:
    """Texts of all elements of a name, without tags inside them."""
    raw = found(html, rf"(?is)<{name}\b[^>]*>(.*?)</{name}\s*>", 1)
    return F.transform(raw, lambda t: F.trim(decode_once(F.regexp_replace(t, TAG, ""))))


def named_meta(html: Column, name: str) -> Column:
    """Content of the last meta tag of a name; null without one."""
    mine = F.filter(tags(html, "meta"), lambda t: F.lower(value(t, "name")) == name)
    return F.trim(value(F.try_element_at(mine, F.lit(-1)), "content"))


def links(html: Column, rel: str) -> Column:
    return F.filter(tags(html, "link"), lambda t: F.array_contains(F.split(F.lower(value(t, "rel")), r"\s+"), rel))


def alternates(html: Column) -> Column:
    """array<struct<code,href>> of the alternate links that name a language."""
    mine = F.filter(links(html, "alternate"), lambda t: value(t, "hreflang") != "")
    return F.transform(mine, lambda t: F.struct(F.trim(value(t, "hreflang")).alias("code"), F.trim(value(t, "href")).alias("href")))


def without(html: Column, *patterns: str) -> Column:
    for p in patterns:
        html = F.regexp_replace(html, p, " ")
    return html


def count(html: Column, pattern: str) -> Column:
    return F.regexp_count(html, F.lit(pattern))


def prose(html: Column) -> Column:
    """Text of the paragraphs, links taken out inside them, without scripts, chrome and comments."""
    main = without(html, r"(?is)<(script|style|nav|header|footer|aside).*?</\1>", COMMENT)
    paragraphs = found(main, r"(?is)<p[^>]*>(.*?)</p>", 1)
    clean = lambda t: F.trim(F.regexp_replace(decode_entities(F.regexp_replace(F.regexp_replace(t, r"(?is)<a[^>]*>.*?</a>", " "), TAG, " ")), r"\s+", " "))
    return F.array_join(F.filter(F.transform(paragraphs, clean), lambda t: t != ""), " ")
