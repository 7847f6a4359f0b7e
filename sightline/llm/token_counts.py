"""Token counts by rank-synchronous merging of ragged symbol arrays.

All distinct pre-tokens of a slice are held in one flat array of symbols with
the number of the pre-token each belongs to. In each round every sequence
finds its lowest-ranked neighbouring pair, and all sequences merge theirs at
once; a sequence without a mergeable pair is finished, and its surviving
symbols are its token count.

A long pre-token would take a round for nearly each of its symbols, over all of
them. It is cut into short sequences that merge in the same arrays; then
neighbours are joined, all pairs at once, by merging a window of symbols around
their border again. A sequence of symbols is the right one if and only if each
two neighbours are what their bytes merge to, so a window is wide enough once
the pairs at its ends are.
"""

from __future__ import annotations

import json
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import id_field, map_text, pc, pick

#: Counts of pre-tokens of at most LONG bytes that a worker remembers between slices.
CACHE, LONG = 400_000, 96
#: Bytes of the sequences that longer pre-tokens are cut into, and symbols of either side in a window at first.
PART, FIRST_SYMBOLS = 32, 2
NO_RANK = np.int32(2**31 - 1)
#: The pattern of the tokenizer's byte-level splitter (fixed by its format).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> list[str]:
    """The letter that the vocabulary file writes for each byte: printable ones stand for themselves, the others follow from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class PairTable:
    """Ranks of (left, right) pairs in two open tables; a key is in the first or, where that place is taken, in the second.

    Of n keys in tables of m places some n^2 / 2m go to the second, where (n^2 / 2m)^2 / 2m
    meet another: the tables are large enough for less than one.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray, symbols: int):
        self.symbols = np.int64(symbols)
        keys = left.astype(np.int64) * self.symbols + right
        self.bits = max(20, math.ceil(math.log2(max(len(keys), 1) ** (4 / 3) / 2)))
        for seed in range(1, 200):
            self.factors = [np.uint64((0x9E3779B97F4A7C15 * (2 * seed + k) | 1) & 2**64 - 1) for k in (0, 1)]
            tables, rest = [], np.arange(len(keys))
            for factor in self.factors:
                table = np.full(1 << self.bits, -1, np.int32)
                at = self._place(keys[rest], factor)
                table[at[::-1]] = rest[::-1]
                tables.append(table)
                rest = rest[table[at] != rest]
            if not len(rest):
                break
        else:
            raise ValueError("no placement of the merges was found")
        self.tables = tables
        self.keys, self.merged = np.append(keys, -1), np.append(merged, -1).astype(np.int32)

    def _place(self, keys: np.ndarray, factor: np.uint64) -> np.ndarray:
        return ((keys.view(np.uint64) * factor) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.symbols + right
        first = self.tables[0][self._place(keys, self.factors[0])]
        rank = np.where(self.keys[first] == keys, first, NO_RANK).astype(np.int32)
        miss = np.flatnonzero((rank == NO_RANK) & (first >= 0))
        if len(miss):
            second = self.tables[1][self._place(keys[miss], self.factors[1])]
            rank[miss] = np.where(self.keys[second] == keys[miss], second, NO_RANK)
        return rank


class RankMerger:
    """Counts tokens as the tokenizer described by a byte-level BPE file gives them."""

    def __init__(self, spec: dict):
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("only plain byte-level BPE files are supported")
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.first = np.array([vocab[x] for x in byte_letters()], np.int32)
        left, right, merged = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in merges), strict=True))
        self.pairs = PairTable(left, right, merged, max(vocab.values()) + 1)
        special = [x["content"] for x in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.hints = special
        self.split = regex.compile(SPLIT)
        self.known: dict[str, int] = {}
        letters = {x: i for i, x in enumerate(byte_letters())}
        self.bytes_of = {i: bytes(letters[c] for c in x) for x, i in vocab.items() if all(c in letters for c in x)}

    def merge(self, sequences: list[bytes], survivors: list | None = None) -> np.ndarray:
        """How many symbols of each sequence survive; ``survivors`` gets (symbols, sequences they belong to) as these finish."""
        sizes = np.array([len(x) for x in sequences], np.int64)
        counts = sizes.copy()
        symbol = self.first[np.frombuffer(b"".join(sequences), np.uint8)]
        owner = np.repeat(np.arange(len(sequences)), sizes)
        while len(symbol) > 1:
            rank = np.append(self.pairs.ranks(symbol[:-1], symbol[1:]), NO_RANK)
            rank[np.flatnonzero(owner[:-1] != owner[1:])] = NO_RANK
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            spans = np.diff(np.append(starts, len(symbol)))
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == NO_RANK
            counts[owner[starts[done]]] = spans[done]
            best = np.repeat(lowest, spans)
            if survivors is not None and done.any():
                over = best == NO_RANK
                survivors.append((symbol[over], owner[over]))
            hit = (rank == best) & (best != NO_RANK)
            at = np.flatnonzero(hit)
            if not len(at):
                break
            # of overlapping hits (a pair of equal symbols) every second one, from the left
            fresh = np.append(True, np.diff(at) > 1)
            order = np.arange(len(at))
            at = at[(order - np.maximum.accumulate(np.where(fresh, order, 0))) % 2 == 0]
            symbol[at] = self.pairs.merged[rank[at]]
            keep = best != NO_RANK
            keep[at + 1] = False
            symbol, owner = symbol[keep], owner[keep]
        else:
            if len(symbol):
                counts[owner[0]] = 1
                if survivors is not None:
                    survivors.append((symbol, owner))
        return counts

    def symbols(self, sequences: list[bytes]) -> list[list[int]]:
        """The surviving symbols of each sequence."""
        found: list = []
        counts = self.merge(sequences, found)
        if not found:
            return [[] for _ in sequences]
        symbol, owner = (np.concatenate(x) for x in zip(*found, strict=True))
        flat = symbol[np.argsort(owner, kind="stable")].tolist()
        ends = np.cumsum(counts).tolist()
        return [flat[e - n : e] for e, n in zip(ends, counts.tolist(), strict=True)]

    def raw(self, symbols: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in symbols])

    def count_long(self, raw: bytes) -> int:
        """Symbols that survive of a long pre-token."""
        parts = self.symbols([raw[i : i + PART] for i in range(0, len(raw), PART)])
        while len(parts) > 1:
            parts = self.join(parts[::2], parts[1::2]) + parts[len(parts) - len(parts) % 2 :]
        return len(parts[0])

    def join(self, lefts: list[list[int]], rights: list[list[int]]) -> list[list[int]]:
        """The symbols of each left and right together."""
        out: list = [None] * len(rights)
        wide = {i: (FIRST_SYMBOLS, FIRST_SYMBOLS) for i in range(len(rights))}
        while wide:
            wide = {i: (min(a, len(lefts[i])), min(b, len(rights[i]))) for i, (a, b) in wide.items()}
            windows = self.symbols([self.raw(lefts[i][len(lefts[i]) - a :] + rights[i][:b]) for i, (a, b) in wide.items()])
            ends = []
            for (i, (a, b)), window in zip(wide.items(), windows, strict=True):
                ends.append([lefts[i][len(lefts[i]) - a - 1], window[0]] if a < len(lefts[i]) else [])
                ends.append([window[-1], rights[i][b]] if b < len(rights[i]) else [])
            stand = [not x or x == y for x, y in zip(ends, self.symbols([self.raw(x) for x in ends]), strict=True)]
            again = {}
            for k, ((i, (a, b)), window) in enumerate(zip(wide.items(), windows, strict=True)):
                if stand[2 * k] and stand[2 * k + 1]:
                    out[i] = lefts[i][: len(lefts[i]) - a] + window + rights[i][b:]
                else:
                    again[i] = (a if stand[2 * k] else 2 * a, b if stand[2 * k + 1] else 2 * b)
            wide = again
        return out

    def learn(self, words: set[str]) -> dict[str, int]:
        """Remembers the counts of the words; the counts of long ones are returned."""
        if len(self.known) + len(words) > CACHE:
            self.known.clear()
        new = [x for x in words if x not in self.known]
        raw = [x.encode() for x in new]
        short = [k for k, x in enumerate(raw) if len(x) <= LONG]
        if short:
            self.known.update(zip([new[k] for k in short], self.merge([raw[k] for k in short]).tolist(), strict=True))
        return {x: self.count_long(r) for x, r in zip(new, raw, strict=True) if len(r) > LONG} if len(short) < len(new) else {}

    def count(self, texts: list[str]) -> list[int]:
        parts, extra = [], []
        for text in texts:
            if self.special and any(x in text for x in self.hints):
                pieces = self.special.split(text)
                extra.append(len(pieces) - 1)
                parts.append([w for x in pieces for w in self.split.findall(x)])
            else:
                extra.append(0)
                parts.append(self.split.findall(text))
        long = self.learn({w for x in parts for w in x})
        known = self.known
        if long:
            return [n + sum([known[w] if w in known else long[w] for w in x]) for n, x in zip(extra, parts, strict=True)]
        return [n + sum([known[w] for w in x]) for n, x in zip(extra, parts, strict=True)]


@lru_cache(maxsize=4)
def merger(path: str) -> RankMerger:
    with open(path, encoding="utf-8") as f:
        return RankMerger(json.load(f))


def token_counts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Rows (id, n_bytes long, n_tokens long, over_limit boolean), one for each row of df.

    Counts are those of the tokenizers library for the file, without begin,
    end or added special tokens; strings of special tokens inside a text count
    as one token each, which is the library's default. Null and empty texts
    have 0 tokens; repeated rows and null ids are kept; an empty table gives an
    empty table; other columns of df are not read.
    """

    def run(rows: pa.RecordBatch) -> dict:
        texts = rows.column("text")
        n = merger(tokenizer_path).count(texts.to_pylist())
        return {"id": rows.column("id"), "n_bytes": pc.binary_length(texts).cast(pa.int64()), "n_tokens": n, "over_limit": [x > limit for x in n]}

    schema = T.StructType([id_field(df, id_col), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return map_text(pick(df, id_col, text_col), run, schema, limit=2 << 20)
