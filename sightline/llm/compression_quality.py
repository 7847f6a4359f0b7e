"""Quality by compression: does a text shrink more by what good or by what bad text repeats?

Two zstandard dictionaries are trained, on labelled good and on labelled bad
text. A text is compressed with either, in short pieces, so that a dictionary
counts throughout a long text and not only at its start. The feature is
``(bytes by the bad one - bytes by the good one) / bytes of the text``, drawn
towards its usual value where the text is short; a
logistic curve fitted on labelled text, weighted to the classes' shares among
all labelled rows, makes it a probability.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import filter_text, id_field, map_text, materialize, pick

#: At most so many labelled rows of either class are read for fitting, the rows with the lowest hash of their id; of them those up to a size.
SAMPLE, SAMPLE_BYTES = 1500, 1 << 16
#: Bytes of either dictionary, and the level texts are compressed at.
DICTIONARY_BYTES, LEVEL = 112640, 3
#: Bytes of the pieces that a dictionary is trained on, and that a text is compressed in.
TRAIN_PIECE, PIECE = 1024, 256
#: A text counts as if so many more bytes of the usual feature followed: short texts tell little.
#: This and PIECE had the least log loss of nine pairs by training on one of the two learning folds and scoring the other.
PRIOR_BYTES = 192


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float
    usual: float


@lru_cache(maxsize=8)
def _compressors(good: bytes, bad: bytes):
    return [zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_dict_id=False, dict_data=_digested(x)) for x in (good, bad)]


def _digested(raw: bytes):
    dictionary = zstandard.ZstdCompressionDict(raw)
    dictionary.precompute_compress(level=LEVEL)
    return dictionary


def feature(text: bytes, good: bytes, bad: bytes, usual: float = 0.0) -> float:
    pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
    a, b = (sum([len(c.compress(x)) for x in pieces]) for c in _compressors(good, bad))
    return (b - a + usual * PRIOR_BYTES) / (len(text) + PRIOR_BYTES)


def score_of(model: Model, x: float) -> float:
    z = model.slope * x + model.offset
    return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def _dictionary(texts: list[bytes]) -> bytes:
    pieces = [t[i : i + TRAIN_PIECE] for t in texts for i in range(0, len(t), TRAIN_PIECE)] or [b"\0"]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: its end serves as it is
        return b"".join(pieces)[-DICTIONARY_BYTES:].ljust(8, b"\0")


def fit(texts: list[bytes], labels: list[int], share: float = 0.5) -> Model:
    """Dictionaries from every second text of a class, the curve from the others; share is that of good rows."""
    order: dict[int, list[bytes]] = {0: [], 1: []}
    for t, y in zip(texts, labels, strict=True):
        order[y].append(t)
    good, bad = (_dictionary(order[y][::2]) for y in (1, 0))
    held = [(t, y) for y in (0, 1) for t in (order[y][1::2] or order[y])]
    if not order[0] or not order[1]:
        return Model(good, bad, 0.0, 2.0 if order[1] else -2.0 if order[0] else 0.0, 0.0)
    y = np.array([y for _, y in held], float)
    plain = np.array([feature(t, good, bad) * (len(t) + PRIOR_BYTES) / max(1, len(t)) for t, _ in held])
    usual = float(share * plain[y == 1].mean() + (1 - share) * plain[y == 0].mean())
    x = np.array([feature(t, good, bad, usual) for t, _ in held])
    weight = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
    slope, offset, ridge = 0.0, 0.0, 1e-4
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        g = np.array([np.sum(weight * (p - y) * x) + ridge * slope, np.sum(weight * (p - y))])
        w = weight * p * (1 - p) + 1e-9
        h = np.array([[np.sum(w * x * x) + ridge, np.sum(w * x)], [np.sum(w * x), np.sum(w)]])
        step = np.linalg.solve(h, g)
        norm = np.abs(step).max()
        slope, offset = slope - step[0] * min(1, 100 / norm), offset - step[1] * min(1, 100 / norm)
        if norm < 1e-8:
            break
    return Model(good, bad, float(slope), float(offset), usual)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled rows of either class, whole texts, chosen by hash of their id.

    Labels that are null or other than 0 and 1 are left out; an id with both
    labels is left out; of rows that repeat an id, the one with the least text
    counts; texts of over SAMPLE_BYTES bytes are scored, but not fitted on.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("key")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("y_max")).where("y = y_max")
    known = materialize(known.select("key", "y"), "labels")
    share = known.agg(F.avg("y")).first()[0]
    order = [F.xxhash64(F.col("key")), F.col("key")]
    chosen = known.where("y = 1").orderBy(*order).limit(sample).unionAll(known.where("y = 0").orderBy(*order).limit(sample)).select("key", "y")
    texts = pick(docs, id_col, text_col).where(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(chosen), F.col("id") == F.col("key"))
    rows = texts.groupBy("key", "y").agg(F.min("text").alias("text")).collect()  # at most 2 * sample rows of SAMPLE_BYTES
    ordered = sorted(rows, key=lambda r: str(r.key))
    return fit([r.text.encode() for r in ordered], [int(r.y) for r in ordered], min(0.99, max(0.01, share if share is not None else 0.5)))


def quality_scores(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score double, predicted int), one for each row of df.

    Only the text is an input. Null and empty texts get the score of the
    usual feature; repeated rows and null ids are kept; an empty table
    gives an empty table; other columns of df are not read.
    """

    def run(rows: pa.RecordBatch) -> dict:
        score = [score_of(model, feature(t.encode(), model.good, model.bad, model.usual)) for t in rows.column("text").to_pylist()]
        return {"id": rows.column("id"), "score": score, "predicted": [int(x >= 0.5) for x in score]}

    schema = T.StructType([id_field(df, id_col), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return map_text(pick(df, id_col, text_col), run, schema)


def keep_good(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of df that are predicted good, with all their columns; null texts count as empty ones."""

    def good(rows: pa.RecordBatch) -> list[bool]:
        return [score_of(model, feature(t.encode(), model.good, model.bad, model.usual)) >= 0.5 for t in rows.column("text").to_pylist()]

    return filter_text(df, text_col, good)


def fold(id_col):
    """crc32 of the id as text, mod 3; 1 is held out."""
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(3))
