"""The difference of two snapshots against a plain version."""

import collections
import hashlib
import random

import pytest

from sightline.llm.snapshot_diff import numbered, snapshot_diff

COLUMNS = ["text", "lang", "source"]


def digest(row):
    return None if row is None else hashlib.sha256("\n".join("~" if x is None else x for x in row).encode()).hexdigest()


def order(row):
    """Contents by their digests, as the operator orders them."""
    return [("" if x is None else hashlib.sha256(x.encode()).hexdigest()) for x in row]


def plain(old, new):
    """Rows (key, old_key, op, changed, sha) of two lists of (key, content)."""
    out, gone, come = [], [], []
    by_key = lambda rows: {k: [c for key, c in rows if key == k] for k, _ in rows}
    a, b = by_key(old), by_key(new)
    for k in {*a, *b}:
        left, right = collections.Counter(a.get(k, [])), collections.Counter(b.get(k, []))
        for c, n in (left & right).items():
            out += [(k, k, "same", "", digest(c))] * n
        x, y = (sorted((rest).elements(), key=order) for rest in (left - right, right - left))
        for c, d in zip(x, y):
            out.append((k, k, "update", ",".join(n for n, p, q in zip(COLUMNS, c, d, strict=True) if p != q), digest(d)))
        gone += [(k, c) for c in x[len(y) :]]
        come += [(k, c) for c in y[len(x) :]]
    low = lambda k: (k is not None, k or 0)
    for c in {c for _, c in gone + come}:
        x, y = (sorted((k for k, d in rows if d == c), key=low) for rows in (gone, come))
        out += [(q, p, "rekey", "", digest(c)) for p, q in zip(x, y)]
        out += [(p, p, "delete", "", None) for p in x[len(y) :]]
        out += [(q, None, "insert", "", digest(c)) for q in y[len(x) :]]
    return out


def frame(spark, rows, parts=3):
    flat = [(k, *c, "other") for k, c in rows]
    return spark.createDataFrame(flat, "key long, text string, lang string, source string, side string").repartition(parts)


def found(spark, old, new, **more):
    return [tuple(r) for r in snapshot_diff(frame(spark, old), frame(spark, new), "key", COLUMNS, **more).select("key", "old_key", "op", "changed", "row_sha256").collect()]


def same(a, b):
    key = lambda rows: sorted(map(repr, rows))
    assert key(a) == key(b)


@pytest.mark.parametrize("leaf_rows", [1, 3, 1000])
def test_against_plain(spark, leaf_rows):
    """Updates, swaps, new keys, copies, nulls, repeated and null keys, further columns with the operator's own names."""
    draw = random.Random(leaf_rows)
    text = lambda: draw.choice(["a", "b", "", None, "ä\nb", "~"])
    content = lambda: (text(), draw.choice(["en", None]), draw.choice(["s", "t"]))
    old = [(draw.choice([*range(60), None]), content()) for _ in range(90)]
    new = []
    for k, c in old:
        what = draw.randrange(8)
        new += {0: [], 1: [(k, content())], 2: [(None if k is None else -1 - k, c)], 3: [(k, c), (None if k is None else -1 - k, c)]}.get(what, [(k, c)])
    same(found(spark, old, new, leaf_rows=leaf_rows), plain(old, new))


def test_empty(spark):
    rows = [(1, ("a", "b", "c")), (None, (None, None, None))]
    same(found(spark, [], []), [])
    same(found(spark, rows, []), plain(rows, []))
    same(found(spark, [], rows), plain([], rows))
    same(found(spark, rows, rows), plain(rows, rows))


def test_one_content_and_one_key(spark):
    """A content under many keys and a key with many rows are numbered over ranges."""
    one = ("x" * 50, "en", "s")
    old = [(k, one) for k in range(400)] + [(-7, (str(k), None, None)) for k in range(300)] + [(-8, one)] * 200
    new = [(k + 1000, one) for k in range(500)] + [(-7, (str(k), None, None)) for k in range(100, 350)] + [(-8, one)] * 250
    same(found(spark, old, new), plain(old, new))


def test_numbers_cross_ranges(spark):
    rows = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 7 = 0 THEN NULL ELSE string(id % 11) END AS g", "(id * 7919) % 5000 AS k").repartition(7)
    places = collections.defaultdict(list)
    for r in numbered(rows, ["g"], ["k"], "n").collect():
        places[r["g"]].append((r["k"], r["n"]))
    for held in places.values():
        assert [n for _, n in sorted(held)] == list(range(1, len(held) + 1))


def test_equal_digests_are_verified(spark, monkeypatch):
    """Leaves whose digests are the same by chance are found by their rows."""
    from pyspark.sql import functions as F

    from sightline.llm import snapshot_diff as module

    plain_digests = module._row_digests
    monkeypatch.setattr(module, "_row_digests", lambda *a: plain_digests(*a).withColumns({"h": F.lit(1).cast("long"), "g": F.lit(2).cast("long")}))
    old = [(k, ("a", None, "s")) for k in range(50)]
    new = [(k, ("b" if k % 9 == 0 else "a", None, "s")) for k in range(50)]
    same(found(spark, old, new), plain(old, new))
