import random

from sightline.functions.graph import components
from sightline.llm.near_duplicates import choose_bands, drop_near_duplicates, intersections, near_duplicates, shingles
from sightline.llm.queries import op2_near_duplicates


def words(text):
    return "".join(c if c.isalnum() or ord(c) >= 128 else " " for c in (text or "").lower()).split()


def grams(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(rows, threshold=0.8):
    """(class ids, links) of rows (id, text) by comparing all pairs of different texts."""
    sets = {t: grams(t) for _, t in rows}
    texts = [t for t in sets if sets[t]]
    near = {t: set() for t in sets}
    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                near[a].add(b)
                near[b].add(a)
    out = []
    for d, t in rows:
        part, todo = {t}, [t]
        while todo:
            for x in near[todo.pop()] - part:
                part.add(x)
                todo.append(x)
        ids = [i for i, x in rows if x in part and i is not None] if sets[t] else [d]
        out.append((d, min(ids, default=None), len(near[t])))
    return out


def family(rng, n, size, edits):
    base = [f"w{rng.randint(0, 9999)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(size)] = f"x{rng.randint(0, 9999)}"
        out.append(" ".join(w))
    return out


def test_bands():
    bands, rows = choose_bands()
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9999


def test_intersections():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (2, 3, 9):
        sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(n)]
        got = intersections(sets)
        assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(n) for j in range(n))


def test_shingles_do_not_cross_texts():
    texts = ["a b c d e f", "", "a b", "b c d e f a b c d e", "A, b! c D-e"]
    flat, n = shingles(texts)
    assert n.tolist() == [2, 0, 1, 6, 1]
    alone = [h for t in texts for h in shingles([t])[0].tolist()]
    assert flat.tolist() == alone and flat[0] == flat[-1]


def test_against_all_pairs(spark):
    rng = random.Random(8)
    texts = family(rng, 450, 60, 3) + family(rng, 30, 200, 6) + family(rng, 20, 8, 1) + [f"tiny {i % 7}" for i in range(20)]
    texts += [texts[0]] * 50 + ["", None, "...", ""] + [" ".join(f"u{rng.randint(0, 10**6)}" for _ in range(40)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (5, texts[5]), (None, "some text of its own here")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "'k' as class_id").repartition(5)
    got = near_duplicates(df).collect()
    want = {}
    for d, c, n in plain([(d, t) for d, t in rows]):
        want.setdefault(d, set()).add((c, n))
    assert len(got) == len(rows)
    for r in got:
        assert (r.class_id, r.n_links) in want[r.id], r
    assert sum(r.first for r in got) == len({r.class_id for r in got if r.class_id is not None}) + sum(r.class_id is None for r in got)
    hot = [r for r in got if r.id == 0][0]
    assert hot.n_copies == 51 and hot.copy_id == 0
    assert near_duplicates(df.limit(0)).count() == 0


def test_large_families(spark):
    """Families of several blocks, with and without numbers of links, against all pairs; some rows are not linked to the least one."""
    rng = random.Random(21)
    texts = family(rng, 1900, 60, 4) + family(rng, 40, 30, 2) + ["copied " * 3 + " ".join(f"c{i}" for i in range(30))] * 1500
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = {d: (c, n) for d, c, n in plain(rows)}
    found = near_duplicates(df)
    assert found.columns == ["id", "class_id", "copy_id", "n_copies", "n_links", "first"]
    got = {r.id: (r.class_id, r.n_links) for r in found.collect()}
    assert got == want and len({c for c, _ in want.values()}) > 5
    classes = {r.id: (r.class_id, r.n_links) for r in near_duplicates(df, links=False).collect()}
    assert classes == {d: (c, None) for d, (c, _) in want.items()}
    assert sorted(r.doc_id for r in drop_near_duplicates(df).collect()) == sorted({c for c, _ in want.values()})


def test_long_paths(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000) for i in range(1, 50)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(v == (0 if k < 1000 else 1000) for k, v in got.items()) and len(got) == 351


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = op2_near_duplicates(spark, sf)
    assert found.columns == ["doc_id", "class_id", "copy_id", "n_copies", "n_links"]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in found.collect())
    assert got == sorted(plain(rows))
