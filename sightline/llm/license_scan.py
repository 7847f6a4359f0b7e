"""License scans: ordered signature rules with a keyword prefilter.

A text becomes a stream of lower-cased words. An Aho-Corasick automaton over
the rules' keywords tells which rules can match at all; only their patterns
run. Detections are resolved by priority: one that lies inside an accepted
detection (of higher priority, or as high and longer) is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import id_field, map_text, pick
from .license_rules import rules

#: Phrases and labels of the base part.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Bytes that are not part of a word become blanks, A-Z become a-z; all others stay.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_stream(text: str) -> tuple[str, int]:
    """The words with a blank before and after each, and their number."""
    words = text.encode().translate(WORD_BYTES).split()
    return (" " + b" ".join(words).decode() + " " if words else " "), len(words)


class Places:
    """Word numbers of places in a stream, asked for in any order."""

    def __init__(self, stream: str):
        self.blanks = [i for i, c in enumerate(stream) if c == " "]

    def word(self, at: int) -> int:
        """Number of the word that starts after the blank at ``at``."""
        return bisect_right(self.blanks, at) - 1


class Scanner:
    def __init__(self):
        self.rules = rules()
        self.patterns: dict[int, re.Pattern] = {}
        self.automaton = ahocorasick.Automaton()
        by_key: dict[str, list[int]] = {}
        for n, (_, _, keyword, _) in enumerate(self.rules):
            by_key.setdefault(keyword, []).append(n)
        for phrase, _ in BASE:
            by_key.setdefault(phrase, [])
        for keyword, numbers in by_key.items():
            self.automaton.add_word(f" {keyword} ", (keyword, numbers))
        self.automaton.make_automaton()
        self.base = dict(BASE)

    def pattern(self, number: int) -> re.Pattern:
        if number not in self.patterns:
            self.patterns[number] = re.compile(f" (?:{self.rules[number][3]})(?= )")
        return self.patterns[number]

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str, int, int]]]:
        """Number of words; base places (first word, end word, label); detections (first word, end word, label, priority, rule)."""
        stream, n_words = word_stream(text)
        base_at, gated = [], {}
        for end, (keyword, numbers) in self.automaton.iter(stream):
            if keyword in self.base:
                base_at.append((end - len(keyword) - 1, keyword))
            for n in numbers:
                gated[n] = True
        if not base_at and not gated:
            return n_words, [], []
        places = Places(stream)
        base = sorted((places.word(at), places.word(at) + keyword.count(" ") + 1, self.base[keyword]) for at, keyword in base_at)
        found = []
        for n in gated:
            for m in self.pattern(n).finditer(stream):
                found.append((places.word(m.start()), places.word(m.end()), self.rules[n][0], self.rules[n][1], n))
        return n_words, base, resolve(found)


def resolve(found: list[tuple[int, int, str, int, int]]) -> list[tuple[int, int, str, int, int]]:
    """Drops each detection whose interval lies inside that of an accepted one; by priority, then length, then order of rules."""
    order = sorted(found, key=lambda d: (-d[3], d[0] - d[1], d[0], d[4]))
    starts = sorted({d[0] for d in found})
    size, reach, kept = len(starts), [0] * (len(starts) + 1), []  # a Fenwick tree of the furthest ends by start
    for d in order:
        place = bisect_right(starts, d[0])
        i, furthest = place, 0
        while i:
            furthest = max(furthest, reach[i])
            i &= i - 1
        if furthest >= d[1]:
            continue
        kept.append(d)
        i = place
        while i <= size:
            reach[i] = max(reach[i], d[1])
            i += i & -i
    return sorted(kept)


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    ``detections`` holds the accepted intervals in words, with label, priority
    and number of the rule. ``score`` is 1 - prod(1 - priority / 100) over the
    accepted detections (a base place counts 50), at most 1. Null and empty
    texts have no words, empty label strings, null first and last word and
    score 0; repeated rows and null ids are kept; an empty table gives an empty
    table; other columns of df are not read.
    """

    def run(rows: pa.RecordBatch) -> dict:
        out = {f.name: [] for f in schema.fields}
        out["id"] = rows.column("id")
        for text in rows.column("text").to_pylist():
            n_words, base, found = scanner().scan(text)
            own = {x[2] for x in base}
            doubt = 1.0
            for _, _, label, priority, _ in found:
                doubt *= 1 - priority / 100
            for _ in own:
                doubt *= 0.5
            out["n_words"].append(n_words)
            out["n_base"].append(len(base))
            out["first_word"].append(base[0][0] if base else None)
            out["last_word"].append(base[-1][0] if base else None)
            out["base_labels"].append(",".join(sorted(own)))
            out["labels"].append(",".join(sorted(own | {x[2] for x in found})))
            out["score"].append(1.0 - doubt)
            out["detections"].append([dict(zip(("first_word", "end_word", "label", "priority", "rule"), x, strict=True)) for x in found])
        return out

    place = T.StructType([T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("label", T.StringType()), T.StructField("priority", T.IntegerType()), T.StructField("rule", T.IntegerType())])
    longs = [T.StructField(x, T.LongType()) for x in ("n_words", "n_base", "first_word", "last_word")]
    schema = T.StructType([id_field(df, id_col), *longs, T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("detections", T.ArrayType(place))])
    return map_text(pick(df, id_col, text_col), run, schema)
