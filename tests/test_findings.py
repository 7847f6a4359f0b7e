"""Cases of the third round's findings."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sightline.functions.graph import components
from sightline.operators import contract, keywords, search_metrics, serp, set_join, similarity, slop, state
from sightline.plans import page_queries
from sightline.sources import logs
from sightline.streaming import streams


@pytest.mark.parametrize("overlap", [1, 2, 3, 5])
def test_alike_by_count_with_wide_sets(spark, overlap):
    """Sets of few, of some and of very many elements, against counting; elements of a wide set go single, not as keys with the whole set."""
    rng = random.Random(overlap)
    sets = {i: {int(60 * rng.random() ** 2) for _ in range(rng.choice([1, 3, 6, 12, 30]))} for i in range(60)}
    sets |= {100: set(range(40, 1040)), 101: set(range(0, 2000, 2)), 102: set(range(30, 180))}
    found = set_join.alike_by_count(spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "id int, item long"), overlap)
    expected = {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= overlap}
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_wide_sets_are_not_carried_with_their_keys(spark, monkeypatch):
    """Rows of the joins hold at most SMALL_SET elements."""
    widest = []
    plain = set_join.alike
    monkeypatch.setattr(set_join, "alike", lambda sets, *a, **k: (widest.append(sets.agg(F.max("n")).first()[0]), plain(sets, *a, **k))[1])
    rows = [(i, x) for i in range(4) for x in range(5 if i else 3000)]
    assert set_join.alike_by_count(spark.createDataFrame(rows, "id int, item long"), 3).count() == 6
    assert max(widest) <= set_join.SMALL_SET


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(1)
    names = rng.sample(range(1000), 400)
    edges = [(names[i], names[i + 1]) for i in range(200)] + [(names[250], names[i]) for i in range(251, 300)] + [(names[300 + i], names[300 + (i + 1) % 50]) for i in range(50)] + [(names[0], names[0])]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    found = {tuple(r) for r in components(spark.createDataFrame(edges, "a int, b int")).select("node", "label").collect()}
    assert found == {(x, root(x)) for x in parent}


def test_relevance_of_all_results(spark):
    """The eleventh result counts where no first ones are asked for."""
    rows = [("alpha beta", i, "alpha beta" if i > 10 else "x", "https://a.b", "") for i in range(1, 21)]
    df = spark.createDataFrame(rows, "query string, position int, title string, url string, snippet string")
    assert serp.relevance(df, top=None).select("coverage", "hit_rate").first() == (1.0, 0.5)
    assert serp.relevance(df).select("coverage", "hit_rate").first() == (0.0, 0.0)


def test_positions_are_rounded_from_exact_sums(spark):
    """0.1, 0.2 and 0.3 in any order have one mean; a tie of the scaled value goes up."""
    df = spark.createDataFrame([(i, v) for i, vs in enumerate([(0.1, 0.2, 0.3), (0.3, 0.2, 0.1), (1e16, 1.0, -1e16)]) for v in vs], "id int, v double").repartition(3)
    means = dict(map(tuple, df.groupBy("id").agg(search_metrics.exact_mean("v")).collect()))
    assert means[0] == means[1] and means[2] == 1 / 3
    assert spark.createDataFrame([(2.25,), (-2.25,)], "v double").select(search_metrics.rounded(F.col("v"), 1)).collect() == [(2.3,), (-2.3,)]


def test_intent_words_end_at_ascii_letters(spark):
    """A letter beyond ASCII is no part of a word, as in the SQL."""
    df = spark.createDataFrame([("\u00e4test\u00e4",), ("best\u00fc",), ("\u00fcbuy",), ("atest",)], "k string")
    rows = df.select(keywords.intent(F.col("k")), keywords.tool_shaped(F.col("k"))).collect()
    assert [tuple(r) for r in rows] == [("informational", True), ("commercial", False), ("transactional", False), ("informational", False)]


def test_outage_of_rows_of_one_url(spark):
    df = spark.createDataFrame([(503,), (200,), (None,)], "now int")
    assert contract.outage_of(df).first() == (3, 2, True)


def test_rows_of_one_key_go_by_their_place(spark, tmp_path):
    """Of equal sites, and of works of one place, the first row of the table stays."""
    pages = [(i, f"https://a.b/{i % 3}", "<p>") for i in (8, 5, 7, 3, 1, 0, 2)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    bodies = {r.site: r.body for r in page_queries._policy(spark, str(tmp_path))[0].collect()}
    assert bodies["https://a.b/2"].startswith("<html>") and bodies["https://a.b/1"].startswith("User-agent: *\nAllow: /page") and bodies["https://a.b/0"].startswith("<html>")


def test_works_of_one_place_go_by_their_order(spark):
    rows = [(1, "10.1/x", f"w{i}", i) for i in (3, 1, 2)]
    works = spark.createDataFrame(rows, "place int, doi string, title string, row int").repartition(3)
    assert state.merge_sources(works, works.limit(0), ties=["row"]).first()["title"] == "w1"


def test_pairs_of_texts_that_share_twenty_phrases(spark):
    """A short text within a long one is alike by less than half, and is a pair all the same; nineteen phrases are none."""
    words = [f"w{i}" for i in range(400)]
    texts = [(1, words), (2, words[:24]), (3, words[100:123]), (4, words[:24])]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "id int, text string")
    found = similarity.pair_overlaps(df, "id", "text", least=20)
    assert [tuple(r) for r in found.collect()] == [(1, 2, 20, round(20 / 396, 4))]


def _shuffled(spark, run):
    """Rows that a function's jobs shuffle."""
    store = lambda: spark.sparkContext._jsc.sc().statusStore()
    none = (None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    stages = lambda: list(spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store().stageList(*none)))
    known = {(s.stageId(), s.attemptId()) for s in stages()}
    out = run()
    return out, sum(s.shuffleWriteRecords() for s in stages() if (s.stageId(), s.attemptId()) not in known)


def _texts(spark, n, words):
    """n texts of rare words with up to two frequent phrases, which come first in the order of a text's phrases; and the set of phrases of each."""
    rng = random.Random(n)
    common = [["0", "0", "0", "0", str(k)] for k in range(2)]
    texts = [sum([rng.choice([c, [f"w{rng.randrange(10**6)}" for _ in range(5)]]) for c in common], []) + [f"w{rng.randrange(10**6)}" for _ in range(words)] for _ in range(n)]
    sets = [{" ".join(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    return spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id int, text string").repartition(4).cache(), sets


@pytest.mark.parametrize("buckets", [1, 64])
def test_frequent_phrases_of_any_buckets(spark, monkeypatch, buckets):
    """Phrases that share a bucket with frequent ones are not frequent for that."""
    monkeypatch.setattr(similarity, "BUCKETS", buckets, raising=False)
    df, sets = _texts(spark, 40, 30)
    counts = {p: sum(p in s for s in sets) for p in set().union(*sets)}
    rare = {i: sorted(p for p in s if counts[p] <= 2) for i, s in enumerate(sets)}
    assert {(r.id, r.n_phrases, r.n_rare) for r in similarity.unique_ratio(df, "id", "text").collect()} == {(i, len(s), len(rare[i])) for i, s in enumerate(sets)}
    assert {tuple(r) for r in similarity.stock_phrases(df, df, "id", "text", share=0.3).collect()} == {(p, c) for p, c in counts.items() if c >= 12}
    both = df.unionAll(df.withColumn("id", F.col("id") + 40))
    assert {tuple(r) for r in similarity.template_groups(both, "id", "text").collect()} == {("|".join(v[:8]), 2) for v in rare.values()}


def test_phrases_are_counted_by_buckets_before_they_are_shuffled(spark, monkeypatch):
    """Of 50,000 phrases, few are shuffled one by one."""
    monkeypatch.setattr(similarity, "BUCKETS", 1 << 11, raising=False)
    df, sets = _texts(spark, 1000, 50)
    df.count()
    for run in (lambda: similarity.unique_ratio(df, "id", "text").collect(), lambda: similarity.template_groups(df, "id", "text").collect(), lambda: similarity.stock_phrases(df, df, "id", "text", share=0.3).collect()):
        assert _shuffled(spark, run)[1] < 30_000 < sum(map(len, sets)) * 0.6


def test_episodes_of_a_gap_to_the_microsecond(spark, tmp_path):
    """A sighting after just the quiet time goes on with its episode, one a microsecond later opens another; no Python keeps the state."""
    quiet, day = 3 * 86400 * 10**6, 86400 * 10**6
    rows = [("a", day), ("a", day + quiet), ("b", day), ("b", day + quiet + 1), (None, day), (None, day + 5), ("c", 19 * day), ("d", 16 * day)]
    schema = "key string, at long, seen boolean"
    for k, part in enumerate([[(*r, True) for r in rows], [("end", 20 * day, False)]]):
        spark.createDataFrame(part, schema).select("key", F.timestamp_micros("at").alias("ts"), "seen").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key string, ts timestamp, seen boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = streams.finding_episodes(stream, "ts", ["key"], quiet // 10**6, "seen")
    assert "Pandas" not in found._jdf.queryExecution().analyzed().toString()
    streams.drained(found, f"{tmp_path}/out", f"{tmp_path}/check")
    micros = [F.unix_micros(c) for c in ("first_seen", "last_seen", "resolved_at")]
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("key", "seen_count", *micros).collect()}
    # d ends at the very watermark, 19 days, and is not over then
    assert got == {("a", 2, day, day + quiet, day + 2 * quiet), ("b", 1, day, day, day + quiet), ("b", 1, day + quiet + 1, day + quiet + 1, day + 2 * quiet + 1), (None, 2, day, day + 5, day + 5 + quiet)}


def _drawn(rng, tree):
    """A text that a parsed pattern matches, but for what stands around it."""
    out = ""
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "NOT_LITERAL":
            out += "z"
        elif op == "IN":
            kind, value = rng.choice([x for x in arg if str(x[0]) != "NEGATE"])
            negated = str(arg[0][0]) == "NEGATE"
            out += "q" if negated else {"LITERAL": lambda: chr(value), "RANGE": lambda: chr(rng.randint(*value)), "CATEGORY": lambda: {"CATEGORY_SPACE": " ", "CATEGORY_WORD": "x"}[str(value)]}[str(kind)]()
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            out += "".join(_drawn(rng, inner) for _ in range(rng.randint(low, min(high, low + 2))))
        elif op == "SUBPATTERN":
            out += _drawn(rng, arg[3])
        elif op == "BRANCH":
            out += _drawn(rng, rng.choice(arg[1]))
        else:
            assert op in ("AT", "ASSERT_NOT"), op
    return out


def test_every_match_of_a_rule_has_a_word_that_is_looked_for_first(spark):
    rng = random.Random(7)
    texts = []
    for rule, _, _, pattern in slop.RULES:
        tree = re._parser.parse(pattern)
        drawn = {"".join(rng.choice((c, c.upper())) if "(?i" in pattern else c for c in _drawn(rng, tree)) for _ in range(600)}
        matches = sorted(t for t in drawn if re.search(pattern, t, re.A))
        assert len(matches) >= min(len(drawn), 3)
        assert all(any(w in t.lower() for w in slop.NEEDED[rule]) for t in matches)
        texts += [(rule, t) for t in matches[:10]]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "id int, text string")
    own = [(r + "_own", s, t, p) for r, s, t, p in slop.RULES]  # names without words: every text is searched
    fired = lambda rules: {(r.id, r.rule.removesuffix("_own"), r["count"]) for r in slop.rule_counts(df, "id", "text", rules).collect()}
    assert fired(slop.RULES) == fired(own)


def test_log_columns_that_nobody_asks_for_are_not_made(spark):
    lines = ['{"ts": 1.5, "request": {"uri": "/a", "headers": {"User-Agent": ["x"]}}, "status": 200}', " {broken", '{"level": "x"}', '1.2.3.4 - - [01/Jan/2025:10:11:12 +0100] "GET /b HTTP/1.1" 200 5 "-" "y"', "garbage", None]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    told = logs.parsed(df)
    whole = df.withColumn("r", logs.parse_any(F.col("line"))).select("line", F.col("r").isNotNull().alias("read"), "r.*")
    assert told.columns == whole.columns and told.exceptAll(whole).count() == whole.exceptAll(told).count() == 0
    plan = told.select("read", "uri")._jdf.queryExecution().optimizedPlan().toString()
    assert "transform_keys" not in plan and "dd/MMM" not in plan
