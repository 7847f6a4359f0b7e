"""Scores of texts by a log-bilinear language model.

Words are counted over all training texts by Spark: blocks of texts send their
distinct words, as packed arrays of hashes and counts, to buckets of the hash,
and each bucket sends the sums back to the blocks. The most frequent words, the
end, unknown words and bands of rarer words (by powers of two of their count)
are the classes that the model predicts; a word of a band has its share of the
band's tokens. So the probabilities of all words, and of one unknown word, add
up to one.

The model predicts a class from the CONTEXT classes before it: their vectors go
through a matrix for each position, and the sum is compared with the vectors of
all classes. Tasks train it on their own texts by noise-contrastive estimation,
and Spark averages what they learnt after each round. In training a token is
classed by its count without itself, so that words seen once stand for unknown
ones. Scores are normalised over all classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bytes_of, map_text, materialize, pick, slices

#: Bytes of text that share one list of distinct words, and of text for each bucket of words.
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 4 << 20
#: Bytes that are hashed at a time.
HASH_BYTES = 1 << 20
#: Classes: unknown words, the end, bands by powers of two of the count, and the most frequent words.
UNKNOWN, END, BANDS, CLASSES = 0, 1, 40, 256
TOP = CLASSES - 2 - BANDS
#: Classes before a token that the model reads, and the length of their vectors.
CONTEXT, WIDTH = 3, 32
#: Tokens of a step, noise classes of a step, step size, and rounds of training; each round has its own part of the texts.
BATCH, NOISE, RATE, ROUNDS = 2048, 48, 0.1, 2
#: Tokens whose contexts are told apart together when texts are scored.
SCORED_TOKENS = 2 << 20
END_HASH = np.uint64(0x9AE16A3B2F90404F)

_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256))
#: A number for each byte of a word, none for white space; capitals have that of their small letters.
_VALUES = np.where(_SPACE, 0, np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER]).astype(np.uint64)
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the factor and of its inverse, modulo 2 ** 64."""
    if n > HASH_BYTES or HASH_BYTES not in _powers:
        size = max(n, HASH_BYTES)
        made = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, x, np.uint64), dtype=np.uint64)]) for x in (_FACTOR, _INVERSE))
        if size > HASH_BYTES:
            return made
        _powers[HASH_BYTES] = made
    return _powers[HASH_BYTES]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts that stand one after the other, and the number of each text's words."""
    space = _SPACE[raw]
    begins = ~space
    begins[1:] &= space[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    begins[inner] |= ~space[inner]
    starts = np.flatnonzero(begins)
    sizes = np.diff(np.searchsorted(starts, offsets))
    found, at = [], 0
    while at < len(starts):
        # whole words of HASH_BYTES at most, or one word
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + HASH_BYTES)) - 1)
        low, high = int(starts[at]), int(starts[end]) if end < len(starts) else len(raw)
        if end == len(starts) - 1 and len(raw) - low <= HASH_BYTES:
            end, high = len(starts), len(raw)
        up, down = _power_tables(high - low)
        places = starts[at:end] - low
        found.append(np.add.reduceat(_VALUES[raw[low:high]] * up[: high - low], places) * down[places])
        at = end
    h = np.concatenate(found) if found else np.zeros(0, np.uint64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29), sizes


def held_out(key: Column) -> Column:
    """Whether crc32 of the decimal id modulo 7 is 2; a null id is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _written(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """The rows with and without ``kind``, which are written apart."""
    made = materialize(df, label, "kind")
    return made.where("kind = 1").drop("kind"), made.where("kind = 0").drop("kind")


def _code(docs: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """(block, id, held, tokens): texts as places in their block's list of words; (block, bucket, hashes, counts): these lists, cut by bucket."""
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("block", T.LongType()), docs.schema["id"], T.StructField("held", T.BooleanType()), T.StructField("tokens", T.BinaryType()), T.StructField("bucket", T.LongType()), T.StructField("hashes", T.BinaryType()), T.StructField("counts", T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rest, size = TaskContext.get().partitionId() << 32, [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal block, rest, size
            hashes = np.concatenate([x[0] for x in rest])
            codes, words = pd.factorize(hashes)
            order = np.argsort(words)
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            codes, words = place[codes], words[order]
            held = np.concatenate([x[3] for x in rest])
            sizes = np.concatenate([x[1] for x in rest])
            counts = np.bincount(codes[~np.repeat(held, sizes)], minlength=len(words)).astype(np.uint32)
            buckets = (words >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(words), np.int64)
            cuts = np.append(np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])), len(words))
            parts = [(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            n = len(parts)
            ids = pa.chunked_array([x[2] for x in rest]).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * n, pa.int32()), pa.array([block] * n, pa.int64()), pa.nulls(n, ids.type), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary()), pa.array(buckets[cuts[:-1]]), pa.array([words[a:b].tobytes() for a, b in parts]), pa.array([counts[a:b].tobytes() for a, b in parts])],
                names=[f.name for f in schema],
            )
            ends, k = np.append(0, np.cumsum(sizes)), len(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([1] * k, pa.int32()), pa.array([block] * k, pa.int64()), ids, pa.array(held), pa.array([codes[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())],
                names=[f.name for f in schema],
            )
            block, rest, size = block + 1, [], 0

        for batch in batches:
            for rows in slices(batch):
                raw, offsets = bytes_of(rows.column("text"))
                hashes, sizes = word_hashes(raw, offsets)
                ends = np.cumsum(sizes)
                rest.append((np.insert(hashes, ends, END_HASH), sizes + 1, rows.column("id"), rows.column("held").to_numpy(zero_copy_only=False).astype(bool)))
                size += len(raw)
                if size >= BLOCK_BYTES:
                    yield from close()
        if rest:
            yield from close()

    coded, lists = _written(docs.mapInArrow(run, schema), "coded")
    return coded.select("block", "id", "held", "tokens"), lists.select("block", "bucket", "hashes", "counts")


def bands(counts: np.ndarray) -> np.ndarray:
    """The class of each count: unknown for none, then a band for each power of two."""
    out = np.zeros(len(counts), np.int64)
    some = counts > 0
    out[some] = END + np.minimum(np.frexp(counts[some].astype(np.float64))[1], BANDS)
    return out


_COUNTED = "kind int, block long, bucket long, counts binary, places binary, hashes binary, tokens array<long>, words array<long>, others array<long>, top binary"


def _count(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, bucket, counts, places, hashes): the count over all training texts of each word of a block's list, and the places of the most frequent; (tokens, words, others, top): sums of each bucket by class."""

    def merge(part: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, np.uint64) for x in part.column("hashes").to_pylist()]
        codes, words = pd.factorize(np.concatenate(hashes))
        sums = np.bincount(codes, weights=np.concatenate([np.frombuffer(x, np.uint32) for x in part.column("counts").to_pylist()]), minlength=len(words)).astype(np.int64)
        ends = words == END_HASH
        best = np.lexsort([words, -np.where(ends, 0, sums)])[:TOP]
        best = best[(sums[best] > 1) & ~ends[best]]
        often = np.zeros(len(words), bool)
        often[best] = True
        cls, less = np.where(ends, END, bands(sums)), np.where(ends, END, bands(np.maximum(sums - 1, 0)))
        total = lambda c, w: np.bincount(c, weights=w, minlength=CLASSES).astype(np.int64).tolist()
        counts, places, found, at = [], [], [], 0
        for own in hashes:
            local = codes[at : at + len(own)]
            hits = np.flatnonzero(often[local])
            counts.append(sums[local].tobytes())
            places.append(hits.astype(np.uint32).tobytes())
            found.append(own[hits].tobytes())
            at += len(own)
        n = part.num_rows
        top = np.stack([words[best], sums[best].astype(np.uint64)]).tobytes()
        nothing = [None] * n
        return pa.table({
            "kind": pa.array([1] * n + [0], pa.int32()), "block": pa.array(part.column("block").to_pylist() + [None], pa.int64()), "bucket": pa.array(part.column("bucket").to_pylist() + [None], pa.int64()),
            "counts": pa.array(counts + [None], pa.binary()), "places": pa.array(places + [None], pa.binary()), "hashes": pa.array(found + [None], pa.binary()),
            "tokens": pa.array([*nothing, total(cls, sums)], pa.list_(pa.int64())), "words": pa.array([*nothing, total(cls, sums > 0)], pa.list_(pa.int64())), "others": pa.array([*nothing, total(less, sums)], pa.list_(pa.int64())), "top": pa.array([*nothing, top], pa.binary()),
        })

    back, sums = _written(lists.groupBy("bucket").applyInArrow(merge, _COUNTED), "counts")
    return back.select("block", "bucket", "counts", "places", "hashes"), sums.select("tokens", "words", "others", "top")


class Words:
    """What training texts say of words: their tokens and distinct words, the most frequent, and the tokens of each class."""

    def __init__(self, sums: DataFrame):
        spread = sums.select(F.posexplode(F.arrays_zip("tokens", "words", "others")).alias("class", "x"))
        found = {r["class"]: r for r in spread.groupBy("class").agg(F.sum("x.tokens").alias("tokens"), F.sum("x.words").alias("words"), F.sum("x.others").alias("others")).collect()}
        of = lambda name: np.array([found[k][name] if k in found else 0 for k in range(CLASSES)], np.int64)
        tokens, others = of("tokens"), of("others")
        self.tokens, self.words = int(tokens.sum()), int(of("words").sum())

        def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for raw in batch.column("top").to_pylist():
                    words, counts = np.frombuffer(raw, np.uint64).reshape(2, -1)
                    yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["word", "n"])

        best = sums.select("top").mapInArrow(pairs, "word long, n long").orderBy(F.desc("n"), "word").limit(TOP).collect()
        self.top = np.array([r["word"] for r in best], np.int64).astype(np.uint64)
        for k, r in enumerate(best):
            c = np.array([r["n"]])
            tokens[bands(c)] -= r["n"]
            others[bands(c - 1)] -= r["n"]
            tokens[END + BANDS + 1 + k] = others[END + BANDS + 1 + k] = r["n"]
        self.by_class, self.noise = tokens, (others + 1.0) / (others.sum() + CLASSES)

    def classes(self, counts: np.ndarray, places: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, class in training, log of the word's share of its class) of a block's words."""
        cls, less = bands(counts), bands(np.maximum(counts - 1, 0))
        share = np.log(np.maximum(counts, 1) / np.maximum(self.by_class[cls], 1))
        order = np.argsort(self.top)
        at = np.searchsorted(self.top, hashes, sorter=order)
        at = order[np.minimum(at, len(order) - 1)] if len(order) else np.zeros(len(hashes), np.int64)
        hit = self.top[at] == hashes if len(order) else np.zeros(len(hashes), bool)
        where = places[hit]
        cls[where] = less[where] = END + BANDS + 1 + at[hit]
        share[where] = 0
        share[cls == UNKNOWN] = 0
        return cls, less, share


def _classed(coded: DataFrame, back: DataFrame, words: Words) -> DataFrame:
    """(id, held, n_tokens, n_known, base, rest, classes, learn) of each text."""
    schema = T.StructType([coded.schema["id"], T.StructField("held", T.BooleanType()), *[T.StructField(x, T.LongType()) for x in ("n_tokens", "n_known")], *[T.StructField(x, T.DoubleType()) for x in ("base", "rest")], T.StructField("classes", T.BinaryType()), T.StructField("learn", T.BinaryType())])

    def join(texts: pa.Table, parts: pa.Table) -> pa.Table:
        parts = parts.sort_by("bucket")
        counts, places, hashes = [], [], []
        at = 0
        for c, p, h in zip(*(parts.column(x).to_pylist() for x in ("counts", "places", "hashes")), strict=True):
            counts.append(np.frombuffer(c, np.int64))
            places.append(np.frombuffer(p, np.uint32).astype(np.int64) + at)
            hashes.append(np.frombuffer(h, np.uint64))
            at += len(counts[-1])
        c = np.concatenate(counts)
        cls, less, share = words.classes(c, np.concatenate(places), np.concatenate(hashes))
        logs, known = np.log10(c + 1.0), c > 0
        cls8, less8 = cls.astype(np.uint8), less.astype(np.uint8)
        held = texts.column("held").to_pylist()
        out: dict[str, list] = {f.name: [] for f in schema if f.name not in ("id", "held")}
        for raw, away in zip(texts.column("tokens").to_pylist(), held, strict=True):
            own = np.frombuffer(raw, np.uint32)
            mine = cls8[own]
            mine[-1] = END
            out["n_tokens"].append(len(own))
            out["n_known"].append(int(known[own].sum()))
            out["base"].append(float(logs[own].sum()))
            out["rest"].append(float(share[own[:-1]].sum()))
            out["classes"].append(mine.tobytes())
            if not away:
                mine = less8[own]
                mine[-1] = END
            out["learn"].append(None if away else mine.tobytes())
        return pa.table({"id": texts.column("id"), "held": texts.column("held"), **{k: pa.array(v, pa.binary() if k in ("classes", "learn") else pa.float64() if k in ("base", "rest") else pa.int64()) for k, v in out.items()}})

    return materialize(coded.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(join, schema), "classed")


class Model:
    """Vectors of classes as context and as target, a matrix for each position, and a bias for each class, in one array."""

    SIZES = (CLASSES * WIDTH, CLASSES * WIDTH, CONTEXT * WIDTH * WIDTH, CLASSES)

    def __init__(self, flat: np.ndarray):
        self.flat = flat.astype(np.float32)
        context, target, matrices, self.bias = np.split(self.flat, np.cumsum(self.SIZES)[:-1])
        self.context, self.target, self.matrices = context.reshape(CLASSES, WIDTH), target.reshape(CLASSES, WIDTH), matrices.reshape(CONTEXT, WIDTH, WIDTH)

    @classmethod
    def begin(cls, noise: np.ndarray) -> Model:
        """Small random vectors; the biases are the logarithms of the noise."""
        random = np.random.default_rng(0)
        matrices = random.normal(0, 0.02, (CONTEXT, WIDTH, WIDTH)) + np.eye(WIDTH)
        return cls(np.concatenate([random.normal(0, 0.1, CLASSES * WIDTH), random.normal(0, 0.1, CLASSES * WIDTH), matrices.ravel(), np.log(noise)]))

    def predicted(self, before: np.ndarray) -> np.ndarray:
        """The vector expected after each row of ``before``, the nearest class first."""
        out = (self.context @ self.matrices[0]).take(before[0], axis=0)
        for k in range(1, CONTEXT):
            out += (self.context @ self.matrices[k]).take(before[k], axis=0)
        return out

    def logs(self, before: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Normalised log-probability of each target after its context, by matrix products over BATCH different contexts at a time."""
        key = np.zeros(len(targets), np.uint64)
        for row in before:
            key = key * np.uint64(CLASSES) + row
        ranked = np.sort(key << np.uint64(32) | np.arange(len(key), dtype=np.uint64))
        order = (ranked & np.uint64(0xFFFFFFFF)).astype(np.int64)
        key = ranked >> np.uint64(32)
        edge = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)]), len(key))
        out = np.empty(len(targets), np.float32)
        for at in range(0, len(edge) - 1, BATCH):
            cuts = edge[at : at + BATCH + 1]
            scores = self.predicted(before[:, order[cuts[:-1]]]) @ self.target.T
            scores += self.bias
            scores -= scores.max(axis=1, keepdims=True)
            own, of = order[cuts[0] : cuts[-1]], np.repeat(np.arange(len(scores)), np.diff(cuts))
            found = scores[of, targets[own]]
            np.exp(scores, out=scores)
            out[own] = found - np.log(scores.sum(axis=1))[of]
        return out


def contexts(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(classes before each token, by distance; the tokens) of some texts; before a text stand ends."""
    flat = np.concatenate([np.concatenate([np.full(CONTEXT, END, np.uint8), t]) for t in texts])
    sizes = np.array([len(t) for t in texts])
    real = np.ones(len(flat), bool)
    begins = np.cumsum(sizes + CONTEXT) - sizes - CONTEXT
    real[(begins[:, None] + np.arange(CONTEXT)).ravel()] = False
    at = np.flatnonzero(real)
    return np.stack([flat[at - k] for k in range(1, CONTEXT + 1)]), flat[at]


_PLACES = np.arange(CLASSES * WIDTH).reshape(CLASSES, WIDTH)


def _add(sums: np.ndarray, rows: np.ndarray, keys: np.ndarray) -> None:
    """Adds rows of vectors to the sums of their classes."""
    np.add.at(sums.reshape(-1), _PLACES.take(keys, axis=0).reshape(-1), rows.reshape(-1))


class Trainer:
    """Noise-contrastive estimation by steps of BATCH tokens, with step sizes by parameter."""

    def __init__(self, model: Model, noise: np.ndarray, seed: int):
        self.model, self.noise, self.random = Model(model.flat.copy()), noise, np.random.default_rng(seed)
        self.seen = np.full(len(model.flat), 1e-6, np.float32)
        self.log_noise = np.log(NOISE * noise).astype(np.float32)

    def step(self, before: np.ndarray, targets: np.ndarray) -> None:
        m = self.model
        drawn = self.random.choice(CLASSES, NOISE, p=self.noise)
        expected, wanted, noise = m.predicted(before), m.target.take(targets, axis=0), m.target[drawn]
        own = np.einsum("ij,ij->i", expected, wanted) + m.bias[targets] - self.log_noise[targets]
        false = expected @ noise.T
        false += m.bias[drawn] - self.log_noise[drawn]
        scale = np.float32(1 / len(targets))
        miss = (1 / (1 + np.exp(-np.clip(own, -30, 30))) - 1) * scale  # the gradient at data and at noise
        np.clip(false, -30, 30, out=false)
        np.negative(false, out=false)
        np.exp(false, out=false)
        false += 1
        np.divide(scale, false, out=false)
        wanted *= miss[:, None]
        back = wanted + false @ noise
        grad = Model(np.zeros(len(m.flat)))
        _add(grad.target, miss[:, None] * expected, targets)
        grad.bias[:] = np.bincount(targets, weights=miss, minlength=CLASSES)
        np.add.at(grad.target, drawn, false.T @ expected)
        np.add.at(grad.bias, drawn, false.sum(axis=0))
        for k in range(CONTEXT):
            moved = np.zeros((CLASSES, WIDTH), np.float32)
            _add(moved, back, before[k])
            grad.context[:] += moved @ m.matrices[k].T
            grad.matrices[k] = m.context.T @ moved
        self.seen += grad.flat**2
        m.flat -= RATE * grad.flat / np.sqrt(self.seen)


def train(classed: DataFrame, noise: np.ndarray) -> Model:
    """Learns from all training texts, a part of them each round; tasks learn apart and are averaged by their tokens."""
    model = Model.begin(noise)
    rows = classed.where("NOT held").select("learn")
    for k in range(ROUNDS):
        part = rows.where(F.pmod(F.xxhash64("learn"), F.lit(ROUNDS)) == k)
        start = model.flat

        def learn(batches: Iterable[pa.RecordBatch], start: np.ndarray = start, k: int = k) -> Iterator[pa.RecordBatch]:
            trainer, held, size, tokens = Trainer(Model(start), noise, 1000 * TaskContext.get().partitionId() + k), [], 0, 0

            def use() -> None:
                before, targets = contexts(held)
                for at in range(0, len(targets), BATCH):
                    trainer.step(before[:, at : at + BATCH], targets[at : at + BATCH])

            for batch in batches:
                for raw in batch.column("learn").to_pylist():
                    held.append(np.frombuffer(raw, np.uint8))
                    size, tokens = size + len(raw), tokens + len(raw)
                    if size >= 64 * BATCH:
                        use()
                        held, size = [], 0
            if held:
                use()
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(start))), pa.array(trainer.model.flat.astype(np.float64) * tokens), pa.array(np.full(len(start), tokens))], names=["i", "v", "n"])

        means = part.mapInArrow(learn, "i long, v double, n long").groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v")).collect()  # as many as the model has numbers
        if means:
            flat = np.empty(len(start))
            flat[[r["i"] for r in means]] = [r["v"] for r in means]
            model = Model(flat)
    return model


def scored(classed: DataFrame, model: Model, words: Words) -> DataFrame:
    """(id, held, n_tokens, n_known, train_tokens, base_score, score) of each text."""
    n, v = words.tokens, words.words
    schema = T.StructType([classed.schema["id"], T.StructField("held", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    per_token = math.log10(n + v + 1)

    def score(rows: pa.RecordBatch) -> dict:
        texts = [np.frombuffer(x, np.uint8) for x in rows.column("classes").to_pylist()]
        logs = model.logs(*contexts(texts)).astype(np.float64)
        sizes = np.array([len(t) for t in texts])
        sums = np.add.reduceat(logs, np.cumsum(sizes) - sizes) + rows.column("rest").to_numpy()
        tokens = rows.column("n_tokens").to_numpy()
        return {"id": rows.column("id"), "held": rows.column("held"), "n_tokens": rows.column("n_tokens"), "n_known": rows.column("n_known"), "train_tokens": np.full(len(texts), n), "base_score": rows.column("base").to_numpy() - tokens * per_token, "score": sums / math.log(10)}

    return map_text(classed.select("id", "held", "n_tokens", "n_known", "base", "rest", "classes"), score, schema, SCORED_TOKENS, "classes")


def lm_scores(df: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id, held, n_tokens, n_known, train_tokens, base_score, score; learnt from the rows where ``held`` is false.

    Tokens are the lower-cased words (A-Z only; runs without ASCII white space) and one
    end. ``base_score`` is the sum of log10 of their add-one probabilities,
    ``score`` the log10 probability of the text by the model. Null and empty
    texts have the end only; repeated rows and null ids are kept as rows; an empty table
    gives an empty table; other columns of df are not read. Words meet by a hash of 64
    bits: among a billion different words some 0.03 pairs share one.
    """
    docs = pick(df.withColumn("__held", F.coalesce(held, F.lit(False))), id_col, text_col, "__held").withColumnRenamed("__held", "held")
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = max(0, math.ceil(math.log2(max(size, 1) / BUCKET_BYTES)))
    coded, lists = _code(docs, bits)
    back, sums = _count(lists)
    words = Words(sums)
    classed = _classed(coded, back, words)
    model = train(classed, words.noise)
    return scored(classed, model, words)
