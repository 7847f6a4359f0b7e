"""Cases of the fourth round's findings."""

import random

import numpy as np
import pytest

from sightline.operators import block_pairs, keywords, set_join
from sightline.plans import programme_queries
from tests.test_findings import _shuffled


def _sale_lines(spark, path, ids):
    rows = [(i, n, item, 1) for i in ids for n, item in ((1, 10), (2, 11), (2, 12), (3, 14))]
    spark.createDataFrame(rows, "sale_id bigint, line_no int, item_id bigint, vendor_id bigint").write.parquet(f"{path}/sale_lines.parquet")


def test_places_beyond_an_integer(spark, tmp_path):
    """Works of sales whose number times 100 is no INTEGER are merged like the others, under the same keys."""
    found = {}
    for label, first in (("few", 1), ("many", 30_000_000)):
        _sale_lines(spark, tmp_path / label, [first, first + 1])
        df = programme_queries.j22(spark, str(tmp_path / label))
        found[label] = {(r.key, r.src, r.place - first * 100, r.doi, r.title) for r in df.collect()}, dict(df.dtypes)["place"]
    assert found["few"][0] == found["many"][0] and len(found["few"][0]) == 3
    assert (found["few"][1], found["many"][1]) == ("int", "bigint")


def _sets(seed):
    """Sets of few, of some and of very many elements."""
    rng = random.Random(seed)
    sets = {i: {int(40 * rng.random() ** 2) for _ in range(rng.choice([1, 3, 6, 9, 14, 30]))} for i in range(80)}
    return sets | {100: set(range(30, 1030)), 101: set(range(0, 2000, 2)), 102: set(range(20, 170))}


@pytest.mark.parametrize("overlap", [1, 2, 3, 5, 11])
def test_links_and_degrees_without_pairs(spark, overlap):
    """Against all pairs: the number of each set's pairs, and the sets that they connect."""
    sets = _sets(overlap)
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= overlap]
    edges, degree = set_join.linked(spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "id int, item long"), overlap)
    want = {i: sum(i in p for p in pairs) for p in pairs for i in p}
    assert dict(map(tuple, degree.collect())) == want
    edges = edges.cache()
    assert {tuple(r) for r in edges.collect()} <= {tuple(p) for p in pairs}
    assert keywords.components(edges).exceptAll(keywords.components(spark.createDataFrame(pairs, "a int, b int"))).isEmpty() and keywords.components(edges).count() == len(want)


def _joined(spark, run):
    """Rows that a function's sort-merge joins give."""
    store = spark._jsparkSession.sharedState().statusStore()
    java = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    known = {e.executionId() for e in java(store.executionsList())}
    out, rows = run(), 0
    for e in java(store.executionsList()):
        if e.executionId() not in known:
            values = java(store.executionMetrics(e.executionId()))
            for node in java(store.planGraph(e.executionId()).allNodes()):
                rows += sum(int(values.get(m.accumulatorId(), "0").replace(",", "")) for m in java(node.metrics()) if node.name().startswith("SortMergeJoin") and m.name() == "number of output rows" and values.get(m.accumulatorId()))
    return out, rows


def test_pairs_of_few_elements_come_up_only_if_they_count(spark):
    """Sets of 4 of 60 elements that share one of their rarest with a fifteenth of the others share three with few."""
    rng = random.Random(3)
    sets = [set(rng.sample(range(60), 4)) for _ in range(1500)]
    own = spark.createDataFrame([(i, x) for i, s in enumerate(sets) for x in s], "id int, item long").cache()
    found, joined = _joined(spark, lambda: {tuple(r) for r in set_join.alike_by_count(own, 3).collect()})
    want = {(a, b, len(sets[a] & sets[b])) for a in range(1500) for b in range(a + 1, 1500) if len(sets[a] & sets[b]) >= 3}
    assert found == want and len(want) > 100
    assert 0 < joined < 10 * len(want) + 3 * len(sets)


def test_clusters_are_made_without_their_pairs(spark):
    """1,500 keywords with the same URLs are a million pairs and one cluster; few rows are shuffled for it."""
    df = spark.createDataFrame([(f"k{i:04}", f"u{x}#a") for i in range(1500) for x in range(4)] + [("x", "u1")], "keyword string, url string").cache()
    df.count()
    found, shuffled = _shuffled(spark, lambda: {tuple(r) for r in keywords.clusters(df).collect()})
    assert found == {(f"k{i:04}", "k0000", 1499) for i in range(1500)} | {("x", "x", 0)}
    assert shuffled < 100_000


@pytest.mark.parametrize(("hits", "cells", "common", "matrix"), [(1 << 21, 1 << 20, 16, 256), (5, 40, 1, 2), (1, 1, 10**9, 3), (30, 10**6, 0, 4)])
def test_counts_of_a_block_in_any_pieces(monkeypatch, hits, cells, common, matrix):
    """Counts of common elements against sets, whatever goes at a time and as a matrix."""
    for name, value in (("HITS", hits), ("CELLS", cells), ("COMMON", common), ("MATRIX", matrix)):
        monkeypatch.setattr(block_pairs, name, value)
    rng = random.Random(4)
    a, b = ([{int(50 * rng.random() ** 2) for _ in range(rng.randrange(20))} for _ in range(n)] for n in (23, 31))
    flat = lambda sets: (np.array([x for s in sets for x in s], np.int64), np.array([i for i, s in enumerate(sets) for _ in s], np.int64), len(sets))
    parts = [block_pairs._counts(*flat(a), block_pairs._Block(*flat(b))) for _ in range(2)]
    got = np.zeros((2, 23, 31), int)
    for first, counts in block_pairs._together(parts):
        for k in range(2):
            got[k, first : first + len(counts[k])] = counts[k]
    assert (got == [[len(x & y) for y in b] for x in a]).all()


def test_sets_are_not_carried_with_their_pairs(spark):
    """300 rows of one heading are 44,850 pairs, but each row moves only once a block."""
    df = spark.createDataFrame([(i, ["same"], [f"w{i}-{k}" for k in range(30)] + [f"w{i // 2}"], ["o"] * (i % 2)) for i in range(300)], "id long, h array<string>, b array<string>, o array<string>").cache()
    df.count()
    found, shuffled = _shuffled(spark, lambda: set_join.weighted_pairs(df, "id", {"h": 0.5, "b": 0.3, "o": 0.2}, 0.3).collect())
    assert len(found) == 44_850 and shuffled < 20_000
    score = {(r.a, r.b): r.score for r in found}
    assert (score[0, 1], score[0, 2], score[1, 3]) == (round(0.5 + 0.3 / 61, 4), 0.5, 0.7)


def test_sets_of_shared_elements_are_not_carried_with_their_pairs(spark):
    rows = [(i, 22, x) for i in range(300) for x in [*range(20), 100 + 2 * i, 101 + 2 * i]]
    own = spark.createDataFrame(rows, "id long, n int, item long").cache()
    own.count()
    found, shuffled = _shuffled(spark, lambda: set_join.alike_by_overlap(own, 20).collect())
    assert len(found) == 44_850 and {tuple(r)[2:] for r in found} == {(20, round(20 / 24, 4))} and shuffled < 40_000
