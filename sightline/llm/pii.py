"""Personal data: direct identifiers, and terms that disclose them.

Direct identifiers are found by pattern. Identifiers that stand in exactly the
same documents are protected as one entity. For each term that stands in a
document with the entity, at any distance, ``p(entity | term)`` is the number of
documents that hold both over the number of documents that hold the term, drawn
a little to ``p(entity)``, so that terms seen once count too, but with care; the
information a term reveals is ``log2(p(entity | term) / p(entity))`` bits of the
entity's ``-log2 p(entity)``. Terms above the thresholds are generalised (kind
``gen``) or removed (kind ``del``) at all their places in the documents that hold
the entity. All counts are of documents, over the whole corpus.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import flag_possible, materialize, pick, slices

KINDS = ("email", "ip", "card", "phone")
#: p(entity | term) is drawn to p(entity) as if so many more documents held the term: one document gives about 1/2.
PRIOR_DOCS = 1
#: p(entity | term) from which a term is generalised, and removed.
GENERALISE, REMOVE = 0.5, 0.9
#: Share of the entity's information that a term must reveal.
REVEALED = 0.5
#: Bytes of text whose words are Python strings at a time, and words whose hashes a task holds before it sums them; Spark sums these sums before it shuffles them.
STEP_BYTES, HELD_WORDS = 1 << 18, 1 << 19

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match never starts inside a run of digits: where the start of a run fails, its later digits fail too
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_WORD_BYTES = bytes(b if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if n % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def find_base(text: str) -> list[tuple[int, int, str, int]]:
    """(start, kind order, kind, end) of direct identifiers, leftmost and non-overlapping for each kind."""
    found = []
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):
            at = m.start()
            while at > last and text[at - 1] in _LOCAL:
                at -= 1
            if at < m.start():
                found.append((at, 0, "email", m.end()))
                last = m.end()
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            found.append((m.start(), 1, "ip", m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, "card", m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, "phone", m.end()))
    return sorted(found)


def _key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def term_hashes(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False).view(np.int64) if words else np.zeros(0, np.int64)


def entity_key(text: str, span: tuple[int, int, str, int]) -> int:
    start, _, kind, end = span
    return _key(f"{kind}:{text[start:end].lower() if kind in ('email', 'ip') else re.sub('[^0-9]', '', text[start:end])}")


def free_words(text: str, base: list[tuple[int, int, str, int]]) -> list[tuple[str, int, int]]:
    """(lower-cased word, start, end) of the words that no identifier touches, in order."""
    found, at, covered = [], 0, 0
    for m in _WORD.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            covered = max(covered, base[at][3])
            at += 1
        if m.start() >= covered:
            found.append((m[0].lower(), m.start(), m.end()))
    return found


def placed_words(text: str, base: list[tuple[int, int, str, int]]) -> list[np.ndarray]:
    """Hashes, starts and ends of the words that no identifier touches; none where there is no identifier."""
    words = free_words(text, base) if base else []
    return [term_hashes([w for w, _, _ in words]), *(np.array([w[k] for w in words], np.int32) for k in (1, 2))]


def lists(rows: list[list[np.ndarray]], kind: pa.ListType) -> pa.ListArray:
    """A list of structs for each row, which gives the arrays of their fields; no element is a Python object."""
    ends = pa.array(np.cumsum([0, *(len(r[0]) for r in rows)]), pa.int32())
    fields = list(kind.value_type)
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(np.concatenate(x), f.type) for x, f in zip(zip(*rows, strict=True), fields, strict=True)], fields=fields), type=kind)


def scan(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each row of df: a row number, id, base spans, identifiers, and the words of texts with identifiers; written once."""
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind_order", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("end", T.IntegerType())])
    word = T.StructType([T.StructField("term", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", df.schema[id_col].dataType), T.StructField("base", T.ArrayType(span)), T.StructField("identifiers", T.ArrayType(T.LongType())), T.StructField("words", T.ArrayType(word))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            for rows in slices(batch, limit=STEP_BYTES):
                base, identifiers, words = [], [], []
                for text in rows.column("text").to_pylist():
                    found = find_base(text)
                    base.append([dict(zip(("start", "kind_order", "kind", "end"), x, strict=True)) for x in found])
                    identifiers.append(sorted({entity_key(text, x) for x in found}))
                    words.append(placed_words(text, found))
                columns = [pa.array(range(number, number + rows.num_rows), pa.int64()), rows.column("id"), *(pa.array(x, f.type) for x, f in zip((base, identifiers), list(arrow)[2:4], strict=True)), lists(words, arrow.field("words").type)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
                number += rows.num_rows

    return materialize(pick(df, id_col, text_col).mapInArrow(run, schema), "pii")


def summed_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): texts that hold each word, as sums over HELD_WORDS words of consecutive texts (or one step of texts)."""
    held: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        term, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(term), pa.array(n.astype(np.int64))], names=["term", "n"])

    size = 0
    for batch in batches:
        for rows in slices(batch, limit=STEP_BYTES):
            words: list[str] = []
            for text in rows.column("text").to_pylist():
                words += set(text.lower().encode().translate(_WORD_BYTES).decode().split(" "))
            held.append(term_hashes(words))
            size += len(words)
            if size >= HELD_WORDS:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


def word_counts(df: DataFrame, text_col: str) -> DataFrame:
    """(term, n): documents that hold each word, as sums that each task made of some of its texts."""
    return df.select(F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text")).mapInArrow(summed_words, "term long, n long")


def entities(scanned: DataFrame) -> DataFrame:
    """(row, entity, n_entity): the entities of each row, and the documents that hold them.

    Identifiers are one entity if as many documents hold them, with the same
    two exclusive-or sums of 64-bit hashes of their row numbers.
    """
    each = scanned.select("row", F.explode("identifiers").alias("identifier"))
    sums = [F.bit_xor(F.xxhash64(F.lit(k), "row")).alias(f"x{k}") for k in (1, 2)]
    held = each.groupBy("identifier").agg(F.count("*").alias("n_entity"), *sums)
    return materialize(each.join(held, "identifier").select("row", F.xxhash64("n_entity", "x1", "x2").alias("entity"), "n_entity").distinct(), "pii_entities")


def held_together(scanned: DataFrame, df: DataFrame, text_col: str) -> DataFrame:
    """(row, entity, term, n_entity, n_docs): documents that hold an entity and a term.

    Only where n_docs, the documents with the term, is small enough against
    n_entity, those with the entity, for the thresholds to be reached at all:
    both stand together in n_entity documents at most.
    """
    of_row = entities(scanned)
    words = scanned.where(F.size("words") > 0).select("row", F.explode(F.array_distinct(F.transform("words", lambda w: w["term"]))).alias("term"))
    # only words of texts with identifiers are counted, and of them only those rare enough for some entity are looked up
    counted = flag_possible(word_counts(df, text_col), words, "term").where("__maybe").groupBy("term").agg(F.sum("n").alias("n_docs"))
    most = of_row.agg(F.coalesce(F.max("n_entity"), F.lit(0)).alias("most"))  # one row
    enough = lambda n: n >= GENERALISE * F.col("n_docs") - (1 - GENERALISE) * PRIOR_DOCS
    rare = materialize(counted.crossJoin(F.broadcast(most)).where(enough(F.col("most"))).select("term", "n_docs"), "pii_rare")
    near = flag_possible(words, rare, "term").where("__maybe").drop("__maybe").join(rare.hint("merge"), "term")
    return materialize(near.join(of_row.hint("merge"), "row").where(enough(F.col("n_entity"))).select("row", "entity", "term", "n_entity", "n_docs"), "pii_both")


def disclosing_terms(both: DataFrame, scanned: DataFrame) -> DataFrame:
    """(entity, term, kind) of the terms that reveal an entity beyond the thresholds."""
    support = both.groupBy("entity", "term").agg(F.count("*").alias("n_both"), F.first("n_entity").alias("n_entity"), F.first("n_docs").alias("n_docs"))
    total = scanned.agg(F.greatest(F.count("*"), F.lit(1)).alias("n_all"))
    usual = F.col("n_entity") / F.col("n_all")
    p = (F.col("n_both") + PRIOR_DOCS * usual) / (F.col("n_docs") + PRIOR_DOCS)
    whole = -F.log2(usual)
    return (
        support.crossJoin(F.broadcast(total))  # one row
        .where((p >= GENERALISE) & (whole > 0) & (whole + F.log2(p) >= REVEALED * whole))
        .select("entity", "term", F.when(p >= REMOVE, "del").otherwise("gen").alias("kind"))
    )


def pii_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id, base array<struct<start,kind_order,kind,end>>, spans (base and disclosing terms).

    Positions are code points, ends exclusive. Null and empty texts have no
    spans; repeated rows and null ids are kept, each with its own spans; an
    empty table gives an empty table; other columns of df are not read.
    """
    scanned = scan(df, id_col, text_col)
    both = held_together(scanned, df, text_col)
    terms = disclosing_terms(both, scanned)
    # a term that discloses two identifiers of a text, and is to be removed for one, is removed
    kinds = both.join(terms, ["entity", "term"]).groupBy("row", "term").agg((F.max(F.col("kind") == "del")).alias("away"))
    of_row = kinds.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "away"))).alias("away"))
    joined = scanned.select("row", "id", "base", "words").join(of_row, "row", "left")
    held = F.filter("words", lambda w: F.map_contains_key("away", w["term"]))
    away = lambda w: F.element_at("away", w["term"])
    added = F.transform(held, lambda w: F.struct(w["start"].alias("start"), F.when(away(w), 5).otherwise(4).alias("kind_order"), F.when(away(w), "del").otherwise("gen").alias("kind"), w["end"].alias("end")))
    return joined.select("id", "base", F.array_sort(F.concat("base", F.coalesce(added, F.array().cast(scanned.schema["base"].dataType)))).alias("spans"))


def general(term: str) -> str:
    """The class that stands for a term: number, code (letters and digits), name (with a capital) or word."""
    digits = sum(c.isdigit() for c in term)
    return "<number>" if digits == len(term) else "<code>" if digits else "<name>" if term != term.lower() else "<word>"


def pii_sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with identifiers replaced by ``<kind>``, and revealing terms by what general() gives, or taken out; ids must be unique.

    Rows with a null id keep their text, as do null texts.
    """
    spans = pii_spans(df.where(F.col(id_col).isNotNull()), id_col, text_col).select(F.col("id").alias("__id"), F.col("spans").alias("__spans"))

    @F.pandas_udf("string")
    def clean(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, found in zip(text, spans, strict=True):
            if t is not None and found is not None and len(found):
                parts, last = [], 0
                for s in found:
                    if s["start"] >= last:
                        parts += [t[last : s["start"]], "" if s["kind"] == "del" else general(t[s["start"] : s["end"]]) if s["kind"] == "gen" else f"<{s['kind']}>"]
                    last = max(last, s["end"])
                t = "".join(parts) + t[last:]
            out.append(t)
        return pd.Series(out, dtype=object)

    joined = df.join(spans, df[id_col] == spans["__id"], "left")
    return joined.withColumn(text_col, clean(df[text_col].cast("string"), F.col("__spans"))).select(*df.columns)


def base_digest(spans: str = "base"):
    """'kind:start:end' of an array of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: str, kind: str):
    """Spans of one kind in an array of spans."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


__all__ = ["KINDS", "find_base", "pii_spans", "pii_sanitise", "base_digest", "count_kind"]
