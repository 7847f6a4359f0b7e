"""Byte-level BPE encoding and decoding by a monoid tree reduction.

A text is halved until a part has at most ``leaf`` characters. A leaf is cut by
the splitting pattern, and each match is merged on its own. Two neighbours are
joined by encoding a window around their border again, which grows until the
tokens outside provably stay as they are. There are two kinds of border:

* Between matches: the window reaches to *stable cuts*, places where the pattern
  always starts a new match, whatever stands further left or right. They are
  known for the one pattern STABLE_CUT is made for; for any other the window
  is the whole node, which is the plain encoding.
* Within a match, whose bytes are halved in the same way: an encoding is the
  right one if and only if each two neighbouring tokens are what their bytes are
  encoded to. Both sides and the window are right in themselves, so the joined
  tokens are proved by the two pairs at the window's ends; where a pair fails
  the window takes in more tokens.

Decoding joins the bytes of halves up the same kind of tree.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import id_field, map_text, pick

#: Characters of a leaf of a text, and bytes of a leaf of a match.
LEAF, WORD_LEAF = 1024, 48
#: Characters looked at on either side of a border at first; doubles as the window grows.
FIRST_WINDOW = 32
#: Tokens of either side in a window within a match at first; doubles as well.
FIRST_TOKENS = 2
#: Bytes of encoded matches, and pairs of tokens, that a worker remembers.
CACHE_BYTES, CACHE_PAIRS = 64 << 20, 200_000
#: The pattern that the stable cuts hold for (fixed value of its vocabularies).
KNOWN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A letter or digit before a blank or common mark: no match of the pattern
#: holds a blank after another kind of character, nor a letter and a mark in
#: this order, so a match ends here. Only long-assigned characters are listed.
STABLE_CUT = regex.compile(r"(?<=[0-9A-Za-zÀ-ÖØ-öø-ɏЀ-ѿ一-龥ぁ-ゖァ-ヺ가-힣])(?=[ \n\t.,;:!?，。、！？])")


class TreeCodec:
    """Encoder and decoder for one rank file and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, word_leaf: int = WORD_LEAF):
        self.ranks, self.leaf, self.word_leaf = ranks, leaf, word_leaf
        self.split = regex.compile(pattern)
        self.stable = STABLE_CUT if pattern == KNOWN else None
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.sizes = [len(x) for x in self.bytes_of]
        self.known: dict[str, list[int]] = {}
        self.held = 0
        self.pairs: dict[tuple[int, int], bool] = {}

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, low: int, high: int) -> list[int]:
        # without a stable cut inside, a join would encode the whole node again
        if high - low <= self.leaf or self.stable is None or not self.stable.search(text, low + 1, high):
            return self.plain(text[low:high])
        middle = (low + high) // 2
        return self.join(text, low, middle, high, self._encode(text, low, middle), self._encode(text, middle, high))

    def join(self, text: str, low: int, middle: int, high: int, left: list[int], right: list[int]) -> list[int]:
        """Ids of text[low:high] from those of text[low:middle] and text[middle:high]."""
        start, reach = low, FIRST_WINDOW
        while middle - reach > low:
            if cuts := [m.start() for m in self.stable.finditer(text, middle - reach, middle)]:
                start = cuts[-1]
                break
            reach *= 2
        end, reach = high, FIRST_WINDOW
        while middle + reach < high:
            if found := self.stable.search(text, middle + 1, middle + reach):
                end = found.start()
                break
            reach *= 2
        return left[: len(left) - self.covering(reversed(left), text[start:middle])] + self.plain(text[start:end]) + right[self.covering(right, text[middle:end]) :]

    def covering(self, ids, text: str) -> int:
        """How many of the ids stand for the text."""
        rest, n = len(text.encode()), 0
        if not rest:
            return 0
        for i in ids:
            rest -= self.sizes[i]
            n += 1
            if rest <= 0:
                break
        if rest:
            raise ValueError("a stable cut must be a token border")
        return n

    def plain(self, text: str) -> list[int]:
        """Ids of a text, match by match."""
        out, known = [], self.known
        for word in self.split.findall(text):
            out += known.get(word) or self.learn(word)
        return out

    def learn(self, word: str) -> list[int]:
        """Ids of one match, remembered if it is short; a match that is a token is that token."""
        raw = word.encode()
        whole = self.ranks.get(raw)
        ids = self.word(raw) if whole is None else [whole]
        if len(raw) <= self.word_leaf:
            self.held += 160 + len(raw)
            if self.held > CACHE_BYTES:
                self.known.clear()
                self.held = 160 + len(raw)
            self.known[word] = ids
        return ids

    def word(self, raw: bytes) -> list[int]:
        """Ids of the bytes of one match."""
        if len(raw) <= self.word_leaf:
            return self.merge(raw)
        middle = len(raw) // 2
        return self.join_tokens(self.word(raw[:middle]), self.word(raw[middle:]))

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the bytes that left and right stand for together."""
        a = b = FIRST_TOKENS
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            window = self.word_of(left[len(left) - a :] + right[:b])
            left_holds = a == len(left) or self.stands(left[len(left) - a - 1], window[0])
            right_holds = b == len(right) or self.stands(window[-1], right[b])
            if left_holds and right_holds:
                return left[: len(left) - a] + window + right[b:]
            a, b = a if left_holds else 2 * a, b if right_holds else 2 * b

    def word_of(self, ids: list[int]) -> list[int]:
        return self.merge(b"".join([self.bytes_of[i] for i in ids]))

    def stands(self, a: int, b: int) -> bool:
        """Whether the bytes of two tokens are encoded to just these."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.word_of([a, b]) == [a, b]
        return known

    def merge(self, raw: bytes) -> list[int]:
        """Joins the pair of lowest rank, the leftmost of equals, until no neighbours are a token together."""
        ranks, none = self.ranks, len(self.bytes_of)
        cuts = list(range(len(raw) + 1))
        rank = [ranks.get(raw[i : i + 2], none) for i in range(len(raw) - 1)]
        while rank:
            least = min(rank)
            if least == none:
                break
            i = rank.index(least)
            del cuts[i + 1], rank[i]
            if i < len(rank):
                rank[i] = ranks.get(raw[cuts[i] : cuts[i + 2]], none)
            if i:
                rank[i - 1] = ranks.get(raw[cuts[i - 1] : cuts[i + 1]], none)
        return [ranks[raw[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join([self.bytes_of[i] for i in ids])
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


@lru_cache(maxsize=4)
def codec(path: str, pattern: str, leaf: int = LEAF) -> TreeCodec:
    """The codec of a rank file (lines of base64 token and rank), once for each worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return TreeCodec(ranks, pattern, leaf)


def bpe_encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """Rows (id, token_ids array<int>, decoded binary), one for each row of df.

    ``ranks_path`` is on every executor. Null and empty texts have no ids and
    decode to no bytes; texts and words of any length are encoded whole, in time
    about proportional to their length; repeated rows and null ids are kept as
    they are; an empty table gives an empty table; other columns of df are not
    read.
    """

    def run(rows: pa.RecordBatch) -> dict:
        code = codec(ranks_path, pattern, leaf)
        ids = [code.encode(x) for x in rows.column("text").to_pylist()]
        return {"id": rows.column("id"), "token_ids": ids, "decoded": [code.decode(x) for x in ids]}

    schema = T.StructType([id_field(df, id_col), T.StructField("token_ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.BinaryType())])
    return map_text(pick(df, id_col, text_col), run, schema)
