"""Quality rules and n-gram perplexity.

A text is a sequence of characters, just as they are. Spark counts all n-grams
of order three of each language over the whole corpus and makes one modified
Kneser-Ney model for each language of them, order by order, with built-in
expressions, and one for all languages that each is mixed with, as texts hold
passages in others. The model is held as sorted arrays of hashed n-grams. Up to a checked
number of n-grams it is broadcast; a larger one stays a table, each block of texts
is joined with its own n-grams' rows, and they make the block's sorted arrays.
Each language has its own band of perplexity, from the quartiles of its
documents; texts outside are rejected.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_field, map_text, materialize, pc, pick, slices

#: Order of the model, and bits of a code point: the history of an n-gram is one long, its last character another.
ORDER, BITS = 3, 21
#: Weight of the model of all languages in a language's own.
OTHERS = 0.3
#: N-grams (12 bytes each in the sorted arrays) up to which the model is broadcast.
MOST_NGRAMS = 4_000_000
#: Bytes of text that are coded together, and that make a block where the model is not broadcast.
BLOCK_BYTES = 2 << 20
#: The band reaches so many interquartile ranges beyond the quartiles of the bits per character.
BAND = 2.0
#: The narrowest interquartile range that counts, in bits per character.
LEAST_SPREAD = 0.05
#: A text counts as if so many more characters at its language's median followed.
PRIOR_CHARS = 150
#: Languages up to which their bands are broadcast; beyond, they are joined by shuffle.
FEW_LANGUAGES = 4096
REPEAT_WINDOW = 5
_MARKS = b"#*$%&|<>"


class Coded:
    """The n-grams that end at each character of some texts, zeros before each text."""

    def __init__(self, texts: list[str]):
        pad = "\0" * (ORDER - 1)
        points = np.frombuffer("".join([pad + t for t in texts]).encode("utf-32-le"), np.uint32)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.letters = np.flatnonzero(np.bincount(points)) if len(points) else np.zeros(1, np.int64)
        number = np.zeros(int(self.letters[-1]) + 1, np.int64)
        number[self.letters] = np.arange(len(self.letters))
        code, width = number[points], len(self.letters)
        history = np.zeros(len(code), np.int64)
        for back in range(ORDER - 1, 0, -1):
            history *= width
            history[back:] += code[:-back]
        real = np.ones(len(code), bool)
        starts = np.cumsum(self.sizes + ORDER - 1) - (self.sizes + ORDER - 1)
        real[(starts[:, None] + np.arange(ORDER - 1)).ravel()] = False
        self.width, history, code = width, history[real], code[real]
        if width**ORDER < 2**62:
            self.held, self.gram = None, history * width + code
        else:  # very many different characters: histories by their rank
            self.held, rank = np.unique(history, return_inverse=True)
            self.gram = rank * width + code

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The different n-grams, in order, and how often each stands."""
        ordered = np.sort(self.gram)
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
        return ordered[first], np.diff(np.append(first, len(ordered)))

    def keys(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(history, last) of n-grams, as code points."""
        history, last = gram // self.width, self.letters[gram % self.width]
        if self.held is not None:
            history = self.held[history]
        packed = np.zeros(len(gram), np.int64)
        for back in range(1, ORDER):
            packed |= self.letters[history % self.width] << (BITS * (back - 1))
            history = history // self.width
        return packed, last

    def bits(self, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Bits of each text by a model (sorted hashes, bits); each different n-gram is looked up once."""
        seen, _ = self.distinct()
        hashes, values = model
        if len(seen):
            found = hashed(*self.keys(seen))
            place = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
            if not np.array_equal(hashes[place], found):
                raise ValueError("the model lacks n-grams of a text")
            each = values[place][np.searchsorted(seen, self.gram)]
        else:
            each = np.zeros(0)
        running = np.append(0.0, np.cumsum(each, dtype=np.float64))
        ends = np.cumsum(self.sizes)
        return running[ends] - running[ends - self.sizes]


def hashed(history: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each n-gram."""
    h = history.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + last.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def arrays(history: np.ndarray, last: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted arrays of a model."""
    h = hashed(history, last)
    order = np.argsort(h)
    return h[order], bits[order].astype(np.float32)


def by_language(rows: pa.RecordBatch) -> Iterator[tuple[str | None, list[int], list[str]]]:
    """(language, places, texts) of the rows of each language."""
    places: dict[str | None, list[int]] = {}
    for i, lang in enumerate(rows.column("lang").to_pylist()):
        places.setdefault(lang, []).append(i)
    texts = rows.column("text").to_pylist()
    for lang, at in places.items():
        yield lang, at, [texts[i] for i in at]


def count_ngrams(df: DataFrame) -> DataFrame:
    """(lang, history, last, n) over every text; a task sends its own sums."""
    schema = pa.schema([("lang", pa.string()), ("history", pa.int64()), ("last", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list[tuple]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang in list(held):
                history, last, n = (np.concatenate(x) for x in zip(*held.pop(lang), strict=True))
                order = np.lexsort([last, history])
                history, last, n = history[order], last[order], n[order]
                first = np.flatnonzero(np.append(True, (history[1:] != history[:-1]) | (last[1:] != last[:-1])))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(first), pa.string()), pa.array(history[first]), pa.array(last[first].astype(np.int32)), pa.array(np.add.reduceat(n, first))], schema=schema)

        size = 0
        for batch in batches:
            for rows in slices(batch, limit=BLOCK_BYTES):
                for lang, _, texts in by_language(rows):
                    coded = Coded(texts)
                    gram, n = coded.distinct()
                    if len(gram):
                        held.setdefault(lang, []).append((*coded.keys(gram), n))
                        size += len(gram)
                if size > 3_000_000:
                    yield from flush()
                    size = 0
        yield from flush()

    return df.select("lang", "text").mapInArrow(run, "lang string, history long, last int, n long").groupBy("lang", "history", "last").agg(F.sum("n").alias("c"))


def language_models(counts: DataFrame) -> DataFrame:
    """(lang, history, last, bits): -log2 of the probability of each n-gram's last character in its language, from (lang, history, last, c)."""
    counts = materialize(counts, "counts")
    own = kneser_ney(counts)
    every = kneser_ney(counts.groupBy("history", "last").agg(F.sum("c").alias("c")).withColumn("lang", F.lit("")))
    mixed = own.join(every.select("history", "last", F.col("p").alias("p_every")), ["history", "last"])
    return mixed.select("lang", "history", "last", (-F.log2((1 - OTHERS) * F.col("p") + OTHERS * F.col("p_every"))).alias("bits"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, history, last, p): the modified Kneser-Ney probability of each n-gram's last character, from (lang, history, last, c).

    An n-gram of a lower order counts the different characters that stand
    before it; below the lowest is the even chance of each character.
    """
    # a language that is null is a language of its own
    keyed = counts.select(F.coalesce("lang", F.lit("")).alias("lang"), F.col("lang").isNull().alias("none"), "history", "last", "c")
    levels = [materialize(keyed, "ngrams")]
    for size in range(ORDER - 1, 0, -1):
        mask = (1 << (BITS * (size - 1))) - 1
        levels.append(materialize(levels[-1].withColumn("history", F.col("history").bitwiseAND(F.lit(mask))).groupBy("lang", "none", "history", "last").agg(F.count("*").alias("c")), "ngrams"))
    of = ["lang", "none"]
    lower = materialize(levels[-1].groupBy(*of).agg((1 / F.count("*")).alias("p")), "languages")
    few = F.broadcast if lower.count() <= FEW_LANGUAGES else lambda each: each
    model = None
    for size, level in zip(range(1, ORDER + 1), levels[::-1], strict=True):
        n = [F.col(f"c{k}") for k in (1, 2, 3, 4)]
        y = F.when(n[0] + 2 * n[1] > 0, n[0] / (n[0] + 2 * n[1])).otherwise(0.5)
        cut = [F.when((n[k - 1] > 0) & (n[k] > 0), F.least(F.lit(float(k)), F.greatest(F.lit(0.05), k - (k + 1) * y * n[k] / n[k - 1]))).otherwise(min(0.5 * k, 1.5)).alias(f"d{k}") for k in (1, 2, 3)]
        taken = level.groupBy(*of).agg(*[F.count_if(F.col("c") == k).cast("double").alias(f"c{k}") for k in (1, 2, 3, 4)]).select(*of, *cut)
        discounted = level.join(few(taken), of).withColumn("d", F.least(F.col("c").cast("double"), F.when(F.col("c") >= 3, F.col("d3")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d1")))).drop("d1", "d2", "d3")
        histories = discounted.groupBy(*of, "history").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("rest"))
        own = discounted.join(histories, [*of, "history"])
        if model is None:
            own = own.join(few(lower), of)
        else:
            own = own.withColumn("shorter", F.col("history").bitwiseAND(F.lit((1 << (BITS * (size - 2))) - 1))).join(model.withColumnRenamed("history", "shorter"), [*of, "shorter", "last"])
        # written order by order: the plan of one does not hold those of all lower ones
        model = materialize(own.select(*of, "history", "last", ((F.col("c") - F.col("d")) / F.col("total") + F.col("rest") * F.col("p")).alias("p")), "order")
    return model.select(F.when(~F.col("none"), F.col("lang")).alias("lang"), "history", "last", "p")


def base_rules(texts: list[str]) -> dict[str, list[int]]:
    """The base counts of each text; words are runs of characters other than ASCII white space."""
    raw = [t.encode() for t in texts]
    words = [r.split() for r in raw]
    flat = [w for ws in words for w in ws]
    sizes = np.array([len(ws) for ws in words], np.int64)
    repeated = np.zeros(len(texts), np.int64)
    if len(flat) >= REPEAT_WINDOW:
        h = pd.util.hash_array(np.array(flat, dtype=object), categorize=False)
        owner = np.repeat(np.arange(len(texts)), sizes)
        window = np.zeros(len(flat) - REPEAT_WINDOW + 1, np.uint64)
        for k in range(REPEAT_WINDOW):
            window = window * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(window)]
            window ^= window >> np.uint64(29)
        inside = owner[: len(window)] == owner[REPEAT_WINDOW - 1 :]
        window = window * np.uint64(0xBF58476D1CE4E5B9) + owner[: len(window)].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        window ^= window >> np.uint64(32)
        at = np.flatnonzero(inside)
        order = np.argsort(window[at], kind="stable")
        ranked = window[at][order]
        same = ranked[1:] == ranked[:-1]
        twice = np.append(same, False) | np.append(False, same)
        cover = np.zeros(len(flat) + 1, np.int64)
        hits = at[order[twice]]
        np.add.at(cover, hits, 1)
        np.add.at(cover, hits + REPEAT_WINDOW, -1)
        repeated = np.bincount(owner[np.cumsum(cover[:-1]) > 0], minlength=len(texts))
    doubles = []
    for r in raw:
        lines = [x for x in r.split(b"\n") if x.strip()]
        doubles.append(len(lines) - len(set(lines)))
    marks = [len(r) - len(r.translate(None, _MARKS)) for r in raw]
    blanks = [len(r) - len(r.translate(None, b" \t\n\r\x0b\x0c")) for r in raw]
    return {"n_words": sizes.tolist(), "word_chars": [len(t) - b for t, b in zip(texts, blanks, strict=True)], "n_symbols": marks, "n_dup_lines": doubles, "n_repeat_words": repeated.tolist()}


_LONGS = [T.StructField(x, T.LongType()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]


def _failed() -> Column:
    """Fewer than 10 words, or more than a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rule_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base counts of each row and base_failed, without a model. Null texts are empty ones; rows stay as they are."""
    docs = pick(df, id_col, text_col)
    counted = map_text(docs, lambda rows: {"id": rows.column("id"), **base_rules(rows.column("text").to_pylist())}, T.StructType([id_field(df, id_col), *_LONGS]))
    return counted.withColumn("base_failed", _failed())


_NONE = np.zeros(1, np.uint64), np.zeros(1, np.float32)


def _measured(rows: pa.RecordBatch, models) -> dict:
    """The columns of rows with their base counts, bits and characters; models gives a language's sorted arrays."""
    bits, chars = np.zeros(rows.num_rows), np.zeros(rows.num_rows, np.int64)
    for lang, at, texts in by_language(rows):
        coded = Coded(texts)
        bits[at], chars[at] = coded.bits(models(lang) or _NONE), coded.sizes
    return {"id": rows.column("id"), "lang": rows.column("lang"), **base_rules(rows.column("text").to_pylist()), "bits": bits, "chars": chars}


def _by_broadcast(docs: DataFrame, model: DataFrame, schema: T.StructType) -> DataFrame:
    found = model.toPandas()  # MOST_NGRAMS rows at most
    parts = {lang if isinstance(lang, str) else None: arrays(x["history"].to_numpy(), x["last"].to_numpy(), x["bits"].to_numpy()) for lang, x in found.groupby("lang", dropna=False)}
    held = docs.sparkSession.sparkContext.broadcast(parts)
    return map_text(docs, lambda rows: _measured(rows, held.value.get), schema, limit=BLOCK_BYTES)


def _by_blocks(docs: DataFrame, model: DataFrame, schema: T.StructType) -> DataFrame:
    """Each block of texts of a language meets the rows of the model for its own n-grams."""
    cut = T.StructType([T.StructField("block", T.LongType()), *[f for f in docs.schema.fields if f.name in ("id", "lang", "text")]])
    order = [f.name for f in cut.fields][1:]

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 36
        for batch in batches:
            for rows in slices(batch, limit=BLOCK_BYTES):
                for _, at, _ in by_language(rows):
                    part = rows.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block)), *[part.column(c) for c in order]], names=["block", *order])
                    block += 1

    blocks = materialize(docs.mapInArrow(number, cut), "blocks")

    def own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in np.unique(batch.column("block").to_numpy()).tolist():
                rows = batch.filter(pc.equal(batch.column("block"), block))
                for lang, _, texts in by_language(rows):
                    coded = Coded(texts)
                    history, last = coded.keys(coded.distinct()[0])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(last), block)), pa.array([lang] * len(last), pa.string()), pa.array(history), pa.array(last.astype(np.int32))], names=["block", "lang", "history", "last"])

    wanted = blocks.select("block", "lang", "text").mapInArrow(own, "block long, lang string, history long, last int").distinct()
    same = (wanted["lang"].eqNullSafe(model["lang"])) & (wanted["history"] == model["history"]) & (wanted["last"] == model["last"])
    parts = wanted.join(model.hint("merge"), same).select("block", wanted["history"], wanted["last"], "bits")
    columns = [f.name for f in schema.fields]

    def score(texts: pa.Table, part: pa.Table) -> pa.Table:
        held = arrays(*(part.column(c).to_numpy() for c in ("history", "last", "bits"))) if part.num_rows else _NONE
        rows = texts.combine_chunks().to_batches()
        made = [_measured(x, lambda _: held) for x in rows]
        return pa.concat_tables([pa.table({c: m[c] for c in columns}) for m in made])

    return blocks.groupBy("block").cogroup(parts.groupBy("block")).applyInArrow(score, schema)


def perplexity_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MOST_NGRAMS) -> DataFrame:
    """One row for each row of df: id, lang, base counts, perplexity, base_failed, kept.

    ``perplexity`` is two to the bits per character (1 for texts without
    characters). A text fails the base rules with fewer than 10 words or more
    than a fifth of them in repeated windows; others are kept if their bits lie
    within the band of their language. A null language is a language of its
    own. Null and empty texts have no words and are not kept; repeated rows and
    null ids are kept as rows; an empty table gives an empty table; other
    columns of df are not read. A model of more than ``most`` n-grams is not
    broadcast.
    """
    docs = pick(df, id_col, text_col, lang_col).withColumnRenamed(lang_col, "lang")
    docs = docs.withColumn("lang", F.col("lang").cast("string"))
    model = materialize(language_models(count_ngrams(docs)), "model")
    schema = T.StructType([id_field(df, id_col), T.StructField("lang", T.StringType()), *_LONGS, T.StructField("bits", T.DoubleType()), T.StructField("chars", T.LongType())])
    way = _by_broadcast if model.count() <= most else _by_blocks
    scored = materialize(way(docs, model, schema), "perplexity")
    rate = F.col("bits") / F.col("chars")
    bands = scored.where("chars > 0").groupBy(F.coalesce("lang", F.lit("")).alias("__lang"), F.col("lang").isNull().alias("__none")).agg(F.percentile_approx(rate, [0.25, 0.5, 0.75], 10000).alias("__q"))
    bands = materialize(bands, "bands")
    bands = F.broadcast(bands) if bands.count() <= FEW_LANGUAGES else bands
    joined = scored.join(bands, (F.coalesce(scored["lang"], F.lit("")) == bands["__lang"]) & (scored["lang"].isNull() == bands["__none"]), "left")
    drawn = (F.col("bits") + F.col("__q")[1] * PRIOR_CHARS) / (F.col("chars") + PRIOR_CHARS)
    reach = BAND * F.greatest(F.col("__q")[2] - F.col("__q")[0], F.lit(LEAST_SPREAD))
    failed = _failed()
    inside = F.coalesce(drawn.between(F.col("__q")[0] - reach, F.col("__q")[2] + reach), F.lit(True))
    return joined.select("id", scored["lang"], *[f.name for f in _LONGS], F.when(F.col("chars") > 0, F.pow(F.lit(2.0), rate)).otherwise(1.0).alias("perplexity"), failed.alias("base_failed"), (~failed & inside).alias("kept"))
