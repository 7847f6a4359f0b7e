"""URL expressions. Parts come from one pattern, not parse_url, which fails on odd URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: scheme, authority, path, query, fragment.
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
#: Second-level suffixes under which names are registered.
SECOND_LEVEL = ("co.uk", "com.au", "co.jp", "co.nz", "com.br", "co.in", "org.uk", "ac.uk", "gov.uk")


def part(url: Column | str, number: int) -> Column:
    return F.regexp_extract(F.trim(col(url)), PARTS, number)


def hostname(url: Column | str) -> Column:
    """Lower-cased host without user and port."""
    return F.lower(F.regexp_extract(part(url, 2), r"^(?:[^@]*@)?([^:]*)", 1))


def port(url: Column | str) -> Column:
    return F.regexp_extract(part(url, 2), r":(\d+)$", 1)


def normal_url(url: Column | str) -> Column:
    """Scheme and host lower-cased, default port, one closing slash and fragment dropped, query kept; empty for null or empty."""
    scheme, host, p, query = F.lower(part(url, 1)), hostname(url), port(url), part(url, 4)
    default = (p == "") | ((scheme == "https") & (p == "443")) | ((scheme == "http") & (p == "80"))
    path = F.when(part(url, 3) == "", F.lit("/")).otherwise(part(url, 3))
    path = F.when((F.length(path) > 1) & path.endswith("/"), F.regexp_replace(path, "/$", "")).otherwise(path)
    origin = F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(host != "", F.concat(F.lit("//"), host, F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), p)))).otherwise(""))
    return F.when(F.coalesce(F.trim(col(url)), F.lit("")) == "", F.lit("")).otherwise(F.concat(origin, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def page_path(url: Column | str) -> Column:
    """The path without closing slashes; the root is '/'; empty for null or empty."""
    path = F.regexp_replace(part(url, 3), "/+$", "")
    return F.when(F.coalesce(col(url), F.lit("")) == "", F.lit("")).otherwise(F.when(path == "", F.lit("/")).otherwise(path))


def site(url: Column | str) -> Column:
    """Lower-cased authority without a leading www., port kept."""
    return F.regexp_replace(F.lower(part(url, 2)), r"^www\.", "")


def registrable(host: Column | str, second_level: tuple[str, ...] = SECOND_LEVEL) -> Column:
    """The last two labels, or three under a known second-level suffix."""
    h = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(col(host), F.lit(""))), r"^\.+", ""), r"^www\.", "")
    labels = F.split(h, r"\.")
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    long = (F.size(labels) >= 3) & F.when(F.size(labels) >= 3, last(2)).otherwise("").isin(*second_level)
    return F.when(long, F.when(F.size(labels) >= 3, last(3))).when(F.size(labels) >= 2, F.when(F.size(labels) >= 2, last(2))).otherwise(h)


def clean_domain(text: Column | str) -> Column:
    """A domain out of what people type: no scheme, www., path or closing dot."""
    d = F.regexp_replace(F.lower(F.trim(col(text))), r"^[a-z]+://", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(d, r"^www\.", ""), r"[/?#].*$", ""), r"\.$", "")


def slug_words(url: Column | str) -> Column:
    return F.translate(F.coalesce(col(url), F.lit("")), "-_/", "   ")


def is_relative(url: Column | str) -> Column:
    return (F.coalesce(col(url), F.lit("")) != "") & (part(url, 2) == "")


def ptr_name(ip: Column | str) -> Column:
    """The name that the reverse lookup of an IPv4 or a full IPv6 address asks for."""
    ip = col(ip)
    four = F.concat(F.array_join(F.reverse(F.split(ip, r"\.")), "."), F.lit(".in-addr.arpa"))
    head, tail = F.substring_index(ip, "::", 1), F.when(ip.contains("::"), F.substring_index(ip, "::", -1)).otherwise("")
    groups = lambda t: F.filter(F.split(t, ":"), lambda g: g != "")
    missing = F.array_repeat(F.lit("0"), F.when(ip.contains("::"), F.greatest(F.lit(0), 8 - F.size(groups(head)) - F.size(groups(tail)))).otherwise(0))
    full = F.array_join(F.transform(F.concat(groups(head), missing, groups(tail)), lambda g: F.lpad(F.lower(g), 4, "0")), "")
    six = F.concat(F.array_join(F.split(F.reverse(full), "(?<=.)(?=.)"), "."), F.lit(".ip6.arpa"))
    return F.when(ip.contains(":"), six).otherwise(four)
