"""Text expressions: tokens, shingles, overlap, Markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[a-z0-9']+"
#: Words that never tell a page's own topic.
TITLE_STOPWORDS = ("the", "a", "an", "and", "or", "of", "to", "for", "in", "on", "with", "your", "you", "how", "what", "why", "guide", "complete", "best", "using", "use", "is")
#: Words that do not count when results are held against a query.
RELEVANCE_STOPWORDS = ("the", "a", "an", "and", "or", "of", "to", "for", "in", "on", "with", "how", "what", "why", "is", "are", "was", "were", "best", "vs", "versus", "my", "your", "you", "can", "does", "do", "from", "that", "this", "it")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def found(text: Column | str, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern."""
    return F.regexp_extract_all(col(text), F.lit(pattern), F.lit(group))


def ascii_bounds(pattern: str) -> str:
    r"""The pattern with \b between ASCII word characters and all others, as RE2 has it, and case folded over all letters."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))").replace("(?i)", "(?iu)")


def tokenize(text: Column | str) -> Column:
    """Lower-cased runs of a-z, digits and apostrophes; null text has none."""
    return found(F.lower(F.coalesce(col(text), F.lit(""))), TOKEN)


def once(value: Column | str, use) -> Column:
    """use(value) with the value computed a single time, however often use names it."""
    return F.element_at(F.transform(F.array(col(value)), use), 1)


def shingles(words: Column | str, n: int) -> Column:
    """Distinct runs of n words, joined by blanks; shorter lists have none."""

    def runs(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))

    return once(words, runs)


def shingle_hashes(words: Column | str, n: int) -> Column:
    """Distinct 64-bit hashes of the runs of n words, without making their strings; shorter lists have none."""

    def runs(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.xxhash64(*[F.get(w, i + k - 1) for k in range(n)]))
        return F.when(F.size(w) >= n, F.array_distinct(each)).otherwise(F.array().cast("array<bigint>"))

    return once(words, runs)


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Share of common elements of two lists as sets; 0 if either is empty."""

    def share(a: Column, b: Column) -> Column:
        return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))

    return once(a, lambda x: once(b, lambda y: share(x, y)))


def pair_score(headings_a, headings_b, body_a, body_b, opening_a, opening_b) -> Column:
    """Weighted likeness of two documents' headings, phrases and openings."""
    return F.round(0.5 * jaccard(headings_a, headings_b) + 0.3 * jaccard(body_a, body_b) + 0.2 * jaccard(opening_a, opening_b), 4)


def strip_markdown(text: Column | str) -> Column:
    """Prose of a Markdown text: front matter, code, images, links with their words, tags and marks become blanks."""
    out = col(text)
    # fixed values: the patterns, in this order
    for pattern in (r"(?s)\A---\n.*?\n---", r"(?s)```.*?```", r"`[^`]*`", r"!\[[^\]]*\]\([^)]*\)", r"\[[^\]]*\]\([^)]*\)", r"<[^>]+>", r"[#*_>|]"):
        out = F.regexp_replace(out, pattern, " ")
    return out


def without(words: Column, stop: Column) -> Column:
    """The words in order, repeats kept, without those in stop."""
    return F.filter(words, lambda w: ~F.array_contains(stop, w))


def normal_heading(heading: Column, keyword: Column) -> Column:
    return F.array_join(without(tokenize(heading), keyword), " ")


def markdown_headings(text: Column | str, keyword: Column) -> Column:
    """Second-level headings without the page's own keyword, empty ones left out."""
    raw = found(text, r"(?m)^##[ \t]+(.+)$", 1)
    return F.filter(F.transform(raw, lambda h: normal_heading(h, keyword)), lambda h: h != "")


def first_paragraph(body: Column) -> Column:
    """The first blank-line paragraph of over 40 characters, or an empty text."""
    trimmed = F.transform(F.split(body, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.coalesce(F.get(F.filter(trimmed, lambda p: F.length(p) > 40), F.lit(0)), F.lit(""))


def opening(body: Column, size: int = 12) -> Column:
    return F.slice(tokenize(first_paragraph(body)), 1, size)


def keyword_tokens(mapped: Column, title: Column, slug: Column) -> Column:
    """A page's own keyword words: those mapped, else the title's, else the slug's, without stop words."""
    source = F.coalesce(mapped, title, F.translate(slug, "-_", "  "))
    return without(tokenize(source), F.array(*[F.lit(w) for w in TITLE_STOPWORDS]))


def relevance_tokens(text: Column | str) -> Column:
    stop = F.array(*[F.lit(w) for w in RELEVANCE_STOPWORDS])
    words = found(F.lower(F.coalesce(col(text), F.lit(""))), r"[a-z0-9]+")
    return F.filter(words, lambda w: ~F.array_contains(stop, w) & (F.length(w) > 2))


def word_count(text: Column | str) -> Column:
    """Runs of characters other than white space."""
    return F.size(F.filter(F.split(col(text), r"\s+"), lambda w: w != ""))


def slugify(text: Column | str, fallback: str = "untitled", most: int = 80) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(col(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(F.left(slug, F.lit(most)), F.lit("")), F.lit(fallback))


def normal_keyword(text: Column | str) -> Column:
    """One blank between lower-cased words; null below three characters."""
    out = F.trim(F.regexp_replace(F.lower(col(text)), r"\s+", " "))
    return F.when(F.length(out) >= 3, out)


def content_hash(text: Column | str) -> Column:
    return F.substring(F.sha2(col(text), 256), 1, 16)


def token_estimate(text: Column | str) -> Column:
    return F.round(F.length(col(text)) / 4)


def decode_entities(text: Column) -> Column:
    """Six families of character references; what is left of others becomes a blank."""
    # fixed values: the references and what they stand for, in this order
    for pattern, mark in ((r"(?i)&(?:#0*39|#x0*27|apos|lsquo|rsquo);", "'"), (r"(?i)&(?:#0*34|#x0*22|quot|ldquo|rdquo);", '"'), (r"(?i)&(?:#0*160|nbsp);", " "), (r"(?i)&(?:#0*38|#x0*26|amp);", "&"), (r"(?i)&(?:#0*60|#x0*3c|lt);", "<"), (r"(?i)&(?:#0*62|#x0*3e|gt);", ">")):
        text = F.regexp_replace(text, pattern, mark)
    return F.regexp_replace(text, r"(?i)&[a-z]+;|&#x?[0-9a-f]+;", " ")
