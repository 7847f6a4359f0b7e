import hashlib
import random
from collections import Counter

import numpy as np

from sightline.llm import anchors
from sightline.llm.queries import op4_repeats
from sightline.llm.repeats import remove_repeats, repeated_spans, union
from sightline.llm.suffixes import ladder, previous_factors, repeats, suffix_order


def plain(rows, length, keep_first=False):
    """(n_bytes, spans, kept sha256) of each text in turn."""
    raws = [(t or "").encode() for t in rows]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    first, out = set(), []
    for r in raws:
        marked = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            w = r[i : i + length]
            if seen[w] > 1 and not (keep_first and w not in first):
                marked[i : i + length] = True
            first.add(w)
        edge = np.flatnonzero(np.diff(np.append(False, marked).astype(int)))
        spans = [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        kept, last = b"", 0
        for a, b in spans:
            kept, last = kept + r[last:a], b
        out.append((len(r), spans, hashlib.sha256(kept + r[last:]).hexdigest()))
    return out


def test_suffix_order_and_factors():
    rng = np.random.default_rng(3)
    for alphabet, n in ((1, 90), (2, 200), (4, 300), (255, 120)):
        data = rng.integers(0, alphabet, n).astype(np.uint8)
        depth = 16
        starts = np.arange(n - depth + 1)
        sa, lcp = suffix_order(ladder(data, depth), starts, depth)
        raw = data.tobytes()
        assert sa.tolist() == sorted(starts.tolist(), key=lambda i: (raw[i : i + depth], i))
        match = lambda i, j: next((k for k in range(depth) if raw[i + k] != raw[j + k]), depth)
        # common prefixes are told in steps of eight bytes
        assert all(lcp[k] == match(sa[k - 1], sa[k]) // 8 * 8 for k in range(1, len(sa)))
        factor = previous_factors(sa, lcp)
        for k, i in enumerate(sa):
            assert factor[k] == max((match(i, j) // 8 * 8 for j in range(i)), default=0)
        got = repeats(data, starts, depth, later_only=False).tolist()
        count = Counter(raw[i : i + depth] for i in starts)
        assert got == [i for i in starts if count[raw[i : i + depth]] > 1]


def test_pieces_partition_windows():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab") for _ in range(rng.choice([0, 10, 399, 400, 401, 3000]))) for _ in range(30)] + ["a" * 1500, "ab" * 700]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    text, lo, n, distance, h = anchors.pieces(data, offsets, 400)
    for i, t in enumerate(texts):
        mine = text == i
        assert n[mine].sum() == max(0, len(t) - 399)
        assert np.array_equal(np.concatenate([np.arange(a, a + k) for a, k in zip(lo[mine], n[mine])]) if mine.any() else np.zeros(0), np.arange(max(0, len(t) - 399)))
    # equal windows have the same anchor at the same distance
    seen = {}
    for i, a, k, d, x in zip(text, lo, n, distance, h, strict=True):
        for s in range(k):
            w = texts[i][a + s : a + s + 400]
            assert seen.setdefault(w, (d - s, x)) == (d - s, x)


def samples(rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(90) for _ in range(4)] + [prose(60), prose(64), "é" * 230]
    texts = [prose(rng.randint(1, 200)) for _ in range(20)]
    for _ in range(60):
        p = rng.choice(passages)
        a, b = sorted((rng.randint(0, len(p)), rng.randint(0, len(p))))
        texts.append(prose(rng.randint(0, 40)) + (p if rng.random() < 0.6 else p[a:b]) + prose(rng.randint(0, 40)))
    base = prose(300)
    for _ in range(12):
        at = rng.randrange(len(base))
        texts.append(base[:at] + "#" + base[at + 1 :])
    texts += [base, base, "x" * 1000, "x" * 399, "xy" * 350, None, "", passages[0] * 3, (prose(20) + "\n") * 30]
    rng.shuffle(texts)
    return texts


def test_against_all_windows(spark):
    rng = random.Random(11)
    for keep_first, most in ((False, 4000), (False, 3), (True, 4000), (True, 3)):
        texts = samples(rng)
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 as row", "2 as spans").coalesce(1)
        got = {r.id: (r.n_bytes, [(s.start, s.end) for s in r.spans], r.kept_sha256) for r in repeated_spans(df, keep_first=keep_first, most=most).collect()}
        want = dict(enumerate(plain(texts, 400, keep_first)))
        assert got == want


def test_very_long_text(spark):
    """A text of several chunks beside short ones: the same anchors, repeats within it, across chunks and with others."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    p, q = prose(120), prose(100)
    long = prose(20000) + p + prose(20000) + q + prose(3000) + p
    assert len(long) > anchors.CHUNK
    texts = [prose(60), long, "x " + p + " y", q, prose(90) + q[10:]]
    for keep_first in (False, True):
        got = {r.id: (r.n_bytes, [(s.start, s.end) for s in r.spans], r.kept_sha256) for r in repeated_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), keep_first=keep_first).collect()}
        assert got == dict(enumerate(plain(texts, 400, keep_first))) and got[1][1]


def test_chunks_cut_alike():
    """Windows have the same anchors in a long text's chunks as in short data."""
    rng = np.random.default_rng(4)
    data = rng.integers(0, 3, anchors.CHUNK + 5000).astype(np.uint8)
    text, lo, n, distance, h = anchors.pieces(data, np.array([0, len(data)]), 400)
    assert n.sum() == len(data) - 399 and np.array_equal(lo[1:], lo[:-1] + n[:-1])
    at = np.repeat(lo + distance, n)
    for start in (0, anchors.CHUNK - 300, anchors.CHUNK + 100):
        part = anchors.pieces(data[start : start + 900], np.array([0, 900]), 400)
        assert np.array_equal(np.repeat(part[1] + part[3], part[2]) + start, at[start : start + 501])


def test_odd_rows(spark):
    long = "word " * 100
    df = spark.createDataFrame([(None, long), (1, None), (1, long), (1, long), (2, "")], "doc_id long, text string")
    got = sorted((r.id or 0, r.n_bytes, len(r.spans)) for r in repeated_spans(df, keep_first=False).collect())
    assert got == [(0, 500, 1), (1, 0, 0), (1, 500, 1), (1, 500, 1), (2, 0, 0)]
    assert repeated_spans(df.limit(0)).count() == 0
    unique = spark.createDataFrame([(1, "start " + "abcdefghij" * 50), (2, "other " + "abcdefghij" * 50)], "doc_id long, text string").coalesce(1)
    cut = {r.doc_id: r.text for r in remove_repeats(unique).collect()}
    # the blank before the passage is a part of what both hold
    assert cut[2] == "other" and cut[1].startswith("start abcdefghij") and len(cut[1]) < 506


def test_union():
    assert union([(5, 2), (0, 1), (13, 1)], 4) == [(0, 4), (5, 10), (13, 17)]
    assert union([(0, 2), (5, 1)], 4) == [(0, 9)]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {d: (x[0], sum(b - a for a, b in x[1]), len(x[1]), x[2]) for (d, _), x in zip(rows, plain([t for _, t in rows], 400), strict=True)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op4_repeats(spark, sf).collect()}
    assert got == want and any(x[1] for x in want.values())
