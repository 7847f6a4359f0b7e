"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of ``k`` edits is cut into ``k + 2`` pieces: a
copy with at most ``k`` edits holds at least two pieces unchanged, shifted against
each other by at most ``k``. All pieces are found at once by an Aho-Corasick
automaton; around each such pair the item's edit distance to the text is
verified by Myers' bit-parallel algorithm. Items and
texts are compared as lower-cased words with one blank between them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import filter_text, id_field, map_text, pick

#: Edits allowed, as a share of an item's characters; below 1.
ERROR_RATE = 0.1
#: Items (and their characters) that are searched for in one pass over the texts; more take more passes.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 8_000_000
_WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normal(text: str) -> str:
    """Lower-cased words, one blank between, before and after them."""
    words = text.lower().encode().translate(_WORD_BYTES).split()
    return " " + b" ".join(words).decode() + " " if words else ""


def budget(size: int, rate: float = ERROR_RATE) -> int:
    return int(size * rate)


def needed(size: int, errors: int) -> int:
    """Pieces that must stand unchanged: two, where the item has edits and characters enough."""
    return 2 if 0 < errors <= size - 2 else 1


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of nearly equal length, with their places."""
    cuts = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(item: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for i, c in enumerate(item):
        found[c] = found.get(c, 0) | 1 << i
    return found


def myers(peq: dict[str, int], size: int, text: str) -> int:
    """The least edit distance of the pattern to any stretch of the text."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    pv, mv, now, best = full, 0, size, size
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            now += 1
        elif mh & top:
            now -= 1
            if now < best:
                best = now
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return best


class Matcher:
    def __init__(self, items: tuple[str, ...], rate: float):
        self.items = items
        self.errors = [budget(len(x), rate) for x in items]
        self.masks: dict[int, dict[str, int]] = {}
        places: dict[str, list[tuple[int, int]]] = {}
        for n, item in enumerate(items):
            for at, piece in pieces(item, self.errors[n] + needed(len(item), self.errors[n]) - 1):
                places.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()

    def match(self, text: str) -> dict[int, int]:
        """Items that the text holds, with their least distances."""
        if not self.items or not text:
            return {}
        hits: dict[int, list[tuple[int, int]]] = {}
        for end, (size, found) in self.automaton.iter(text):
            for n, at in found:
                hits.setdefault(n, []).append((end + 1 - size - at, at))
        out = {}
        for n, places in hits.items():
            starts = self.agreed(n, sorted(places))
            if starts:
                best = self.verify(n, starts, text)
                if best <= self.errors[n]:
                    out[n] = best
        return out

    def agreed(self, n: int, places: list[tuple[int, int]]) -> list[int]:
        """The starts that enough different pieces give, within the budget before each."""
        errors = self.errors[n]
        least = needed(len(self.items[n]), errors)
        near: dict[int, int] = {}
        out, low = [], 0
        for start, at in places:
            near[at] = near.get(at, 0) + 1
            while places[low][0] < start - errors:
                old = places[low][1]
                near[old] -= 1
                if not near[old]:
                    del near[old]
                low += 1
            if len(near) >= least and (not out or out[-1] != start):
                out.append(start)
        return out

    def verify(self, n: int, starts: list[int], text: str) -> int:
        item, errors = self.items[n], self.errors[n]
        if item in text:
            return 0
        if not errors:
            return 1
        best, size = errors + 1, len(item)
        low, high = None, 0
        for start in [*starts, None]:
            if low is not None and (start is None or start - errors > high):
                peq = self.masks.get(n) or self.masks.setdefault(n, masks(item))
                best = min(best, myers(peq, size, text[max(0, low) : high]))
                low = None
            if start is not None:
                low = start - errors if low is None else low
                high = start + size + errors
        return best


@lru_cache(maxsize=2)
def _matcher(items: tuple[str, ...], rate: float) -> Matcher:
    return Matcher(items, rate)


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    block, chars = [], 0
    for row in pick(items, id_col, text_col).toLocalIterator():
        text = normal(row["text"])
        if not text:
            continue
        if block and (len(block) >= BLOCK_ITEMS or chars + len(text) > BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append((row["id"], text))
        chars += len(text)
    if block:
        yield block


def find_leaks(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """Rows (id, item_id, distance, allowed) for each row of df and each item it holds within the item's budget.

    Every item is held against every text; items come in blocks of bounded
    size, one pass over the texts for each. Null and empty texts and items
    without words match nothing; repeated rows and repeated items each give
    their rows; an empty table on either side gives an empty table; other
    columns are not read.
    """
    schema = T.StructType([id_field(df, id_col), T.StructField("item_id", items.schema[item_id_col].dataType), T.StructField("distance", T.IntegerType()), T.StructField("allowed", T.IntegerType())])
    texts, found = pick(df, id_col, text_col), None
    for block in _blocks(items, item_id_col, item_text_col):
        ids: dict[str, list] = {}
        for item_id, text in block:
            ids.setdefault(text, []).append(item_id)
        held = df.sparkSession.sparkContext.broadcast((tuple(ids), [*ids.values()]))

        def run(rows: pa.RecordBatch, held=held) -> dict | None:
            unique, item_ids = held.value
            matcher = _matcher(unique, rate)
            out = {f.name: [] for f in schema.fields}
            for row_id, text in zip(rows.column("id").to_pylist(), rows.column("text").to_pylist(), strict=True):
                for n, distance in matcher.match(normal(text)).items():
                    for item_id in item_ids[n]:
                        for name, value in zip(out, (row_id, item_id, distance, matcher.errors[n]), strict=True):
                            out[name].append(value)
            return out if out["id"] else None

        part = map_text(texts, run, schema)
        found = part if found is None else found.unionAll(part)
    return found if found is not None else df.sparkSession.createDataFrame([], schema)


def drop_leaks(df: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """The rows of df that hold no item within its budget, with all their columns; see find_leaks."""
    for block in _blocks(items, item_id_col, item_text_col):
        held = df.sparkSession.sparkContext.broadcast(tuple(dict.fromkeys(text for _, text in block)))

        def clean(rows: pa.RecordBatch, held=held) -> list[bool]:
            matcher = _matcher(held.value, rate)
            return [not matcher.match(normal(t)) for t in rows.column("text").to_pylist()]

        df = filter_text(df, text_col, clean)
    return df


__all__ = ["find_leaks", "drop_leaks", "normal", "budget"]
