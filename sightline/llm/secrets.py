"""Secret scans with built-in expressions only.

Base kinds are found by pattern. Further candidates are long strings of one
character class; a window slides over each, and the Shannon entropy in it is
kept by incremental counts: a character that enters or leaves changes one
count and one term of the sum of ``c * log2(c)``. Candidates whose best window
is random enough, and that no allow-list pattern matches, become ``entropy``
spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in order; the first three are base kinds.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"(?i:passw(?:or)?d|secret|token|api_?key)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}+"
LEAST_SECRET, LEAST_ACCESS = 8, 16
#: Candidates of the entropy rule: runs of these characters with at least WINDOW of them.
WINDOW = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
#: Character classes: pattern, alphabet, least entropy in bits of the best window.
CLASSES = (
    ("^[0-9a-fA-F]+$", "0123456789abcdefABCDEF", 3.0),
    ("^[0-9a-zA-Z]+$", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 3.6),
    ("^[0-9a-zA-Z+/_-]+$", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-", 3.8),
)
ALLOWED = (
    r"(?i)example|sample|placeholder|dummy|changeme|your[_-]?(?:api|key|token|secret|password)|redacted",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)0123456789|1234567890|abcdefgh|qwerty|(.)\1{5}",
    # numbers, and words: written small, great, or with a capital, one after the other
    r"^[0-9/_+-]+$|^(?:[/_+-]*(?:[A-Z][a-z]+|[a-z]{3,}|[A-Z]{3,}))+[/_+-]*$",
    r"(?i)^(?:sha(?:1|256|384|512)|md5)-",
)
#: Stands around matches while a text is cut; texts' own ones are exchanged first, which changes no match and no length.
_CUT, _SAFE = "\u0001", "\u0002"
#: Parts of a text between and in matches that one list of spans is made of; even.
_BLOCK = 64
_SPAN = "array<struct<start:int,kind_order:int,kind:string,end:int>>"


def _none() -> Column:
    return F.array().cast(_SPAN)


def _parts(text: Column, pattern: str) -> Column:
    """Text between matches and the matches in turn, the first and last being between."""
    return F.split(F.regexp_replace(text, pattern, f"{_CUT}$0{_CUT}"), _CUT, -1)


def _named(value: Column, fn) -> Column:
    """fn(value), the value being worked out once: a lambda over a single element names it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _spans(text: Column, pattern: str, kind: str, accept) -> Column:
    """Spans of the accepted matches of a pattern, in code points.

    Parts are gone through in blocks, whose first places come from the sums of
    the blocks before: a list grows by one block's spans at most, so that time
    grows with the number of matches.
    """

    def step(state: Column, part: Column) -> Column:
        end = state["at"] + F.length(part)
        span = F.struct(state["at"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_order"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), (~state["inside"]).alias("inside"), F.when(state["inside"] & accept(part), F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    def over(parts: Column) -> Column:
        block = lambda b: F.slice(parts, b * _BLOCK + 1, F.lit(_BLOCK))
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / _BLOCK).cast("int")), lambda b: F.aggregate(block(b), F.lit(0), lambda n, part: n + F.length(part)))
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(sums, first, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")), lambda s: s["starts"])
        empty = lambda at: F.struct(at.alias("at"), F.lit(False).alias("inside"), _none().alias("out"))
        return F.flatten(F.transform(starts, lambda at, b: F.aggregate(block(b), empty(at), step, lambda s: s["out"])))

    return _named(_parts(text, pattern), over)


def _blocks(spans: Column) -> Column:
    """Spans in blocks of _BLOCK: spans, low (least start), high (greatest end)."""

    def block(b: Column) -> Column:
        own = F.slice(spans, b * _BLOCK + 1, F.lit(_BLOCK))
        return _named(own, lambda s: F.struct(s.alias("spans"), F.array_min(F.transform(s, lambda x: x["start"])).alias("low"), F.array_max(F.transform(s, lambda x: x["end"])).alias("high")))

    return F.when(F.size(spans) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / _BLOCK).cast("int")), block)).otherwise(F.array().cast(f"array<struct<spans:{_SPAN},low:int,high:int>>"))


def _apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others; both by start. A block is held against the blocks that it reaches into."""
    meets = lambda x, y: (x["low"] < y["high"]) & (y["low"] < x["high"])
    clear = lambda s, near: ~F.exists(near, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    def over(blocks: Column) -> Column:
        near = lambda mine: F.flatten(F.transform(F.filter(blocks, lambda b: meets(b, mine)), lambda b: b["spans"]))
        return F.flatten(F.transform(_blocks(spans), lambda mine: _named(near(mine), lambda others: F.filter(mine["spans"], lambda s: clear(s, others)))))

    return _named(_blocks(others), over)


def _term(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))


def best_entropy(text: Column, alphabet: str) -> Column:
    """The highest Shannon entropy of a window of WINDOW characters; null for shorter strings."""
    places = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(alphabet), c))
    start = F.struct(F.lit(0).alias("i"), F.array_repeat(F.lit(0.0), len(alphabet) + 1).alias("counts"), F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("best"))

    def over(chars: Column) -> Column:
        def step(state: Column, place: Column) -> Column:
            old = F.when(state["i"] >= WINDOW, F.element_at(chars, state["i"] - WINDOW + 1)).otherwise(F.lit(-1))
            # the same character entering and leaving changes nothing
            moved = place != old
            comes, goes = F.element_at(state["counts"], place + 1), F.when(old >= 0, F.element_at(state["counts"], F.greatest(old, F.lit(0)) + 1)).otherwise(F.lit(0.0))
            total = F.when(moved, state["sum"] + _term(comes + 1) - _term(comes) + F.when(old >= 0, _term(goes - 1) - _term(goes)).otherwise(F.lit(0.0))).otherwise(state["sum"])
            counts = F.when(moved, F.transform(state["counts"], lambda c, j: c + (j == place).cast("double") - (j == old).cast("double"))).otherwise(state["counts"])
            now = F.when(state["i"] >= WINDOW - 1, F.log2(F.lit(float(WINDOW))) - total / WINDOW)
            return F.struct((state["i"] + 1).alias("i"), counts.alias("counts"), total.alias("sum"), F.greatest(state["best"], now).alias("best"))

        return F.aggregate(chars, start, step, lambda s: s["best"])

    return _named(places, over)


def looks_random(text: Column) -> Column:
    """Some class holds the string, its best window is random enough, and no allow-list pattern matches."""
    ok = F.lit(False)
    for pattern, alphabet, least in reversed(CLASSES):
        ok = F.when(text.rlike(pattern), best_entropy(text, alphabet) >= least).otherwise(ok)
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | text.rlike(pattern)
    return F.when(allowed, F.lit(False)).otherwise(F.coalesce(ok, F.lit(False)))


def secret_spans(df: DataFrame, text_col: str = "text", into: str = "spans", base_into: str = "base") -> DataFrame:
    """df with two more columns of spans (start, kind_order, kind, end): base ones, and all, by start and kind.

    Positions are code points, ends exclusive; a column of df that has the name
    of a new one is replaced. Null and empty texts have no spans; every row of df
    stays, with its other columns; an empty table gives an empty table.
    """
    text = F.coalesce(F.translate(df[text_col].cast("string"), _CUT, _SAFE), F.lit(""))
    assign = F.when(text.rlike(ASSIGN_HINT), _spans(text, ASSIGN, "assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_SECRET)).otherwise(_none())
    access = F.when(text.contains("AKIA"), _spans(text, ACCESS, "access", lambda m: F.length(m) >= LEAST_ACCESS)).otherwise(_none())
    hexes = F.when(text.rlike(HEX), _spans(text, HEX, "hex", lambda m: F.lit(True))).otherwise(_none())
    entropy = F.when(text.rlike(CANDIDATE), _spans(text, CANDIDATE, "entropy", looks_random)).otherwise(_none())
    out = df.withColumn("__base", F.array_sort(F.concat(assign, access, hexes))).withColumn("__more", entropy)
    more = F.when(F.size("__more") > 0, _apart(F.col("__more"), F.col("__base"))).otherwise(F.col("__more"))
    out = out.withColumn("__all", F.when(F.size("__more") > 0, F.array_sort(F.concat("__base", more))).otherwise(F.col("__base")))
    return out.withColumn(base_into, F.col("__base")).withColumn(into, F.col("__all")).drop("__base", "__more", "__all")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch that spans (by start) cover replaced by a mark.

    Blocks of spans are gone through, each in the stretch of the text that it reaches over.
    """

    def step(at: Column, stretch: Column):
        def one(state: Column, span: Column) -> Column:
            clear = span["start"] >= state["at"]
            kept = F.substring(stretch, state["at"] - at + 1, span["start"] - state["at"])
            return F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.when(clear, F.concat(state["out"], F.array(kept, F.lit(mark)))).otherwise(state["out"]).alias("out"))

        return one

    def over(blocks: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        # each block begins where those before it end
        starts = F.aggregate(blocks, first, lambda s, b: F.struct(F.greatest(s["at"], b["high"]).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")), lambda s: s["starts"])
        begun = lambda at: F.struct(at.alias("at"), F.array().cast("array<string>").alias("out"))
        part = lambda at, b: _named(F.substring(text, at + 1, F.greatest(b["high"] - at, F.lit(0))), lambda stretch: F.aggregate(b["spans"], begun(at), step(at, stretch), lambda s: F.array_join(s["out"], "")))
        parts = F.zip_with(starts, blocks, part)
        end = F.array_max(F.transform(blocks, lambda b: b["high"]))
        return F.concat(F.array_join(parts, ""), F.substring(text, end + 1, F.length(text)))

    return F.when(F.size(spans) > 0, _named(_blocks(spans), over)).otherwise(text)


def redact_secrets(df: DataFrame, text_col: str = "text", size_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """df with its secrets replaced by a mark, and the column of sizes (if df has it) set anew where a text changed."""
    found = secret_spans(df, text_col, "__spans", "__base_spans")
    hit = F.size("__spans") > 0
    clean = found.withColumn("__text", F.when(hit, redact(F.col(text_col).cast("string"), F.col("__spans"))))
    columns = {text_col: F.when(hit, F.col("__text")).otherwise(F.col(text_col).cast("string"))}
    if size_col in df.columns:
        columns[size_col] = F.when(hit, F.length("__text").cast(df.schema[size_col].dataType)).otherwise(F.col(size_col))
    return clean.withColumns(columns).select(*df.columns)


def joined(spans: str) -> Column:
    """'kind:start:end' of an array of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
