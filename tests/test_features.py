"""Operators on odd and skewed rows, against plain versions."""

import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from sightline.operators import agents, intervals, link_graph, locales, order_stats, robots_tries, set_join, similarity, sketches, state, trees
from sightline.sources.keyed_store import KeyedStore
from sightline.streaming import streams


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- pairs of sets


@pytest.fixture(scope="module")
def sets():
    """Sets that share very frequent elements, near copies among them, and some that are tiny."""
    draw = random.Random(5)
    common = [f"c{i}" for i in range(6)]
    out = {}
    for i in range(120):
        base = {f"x{draw.randrange(300)}" for _ in range(draw.randrange(0, 14))}
        out[i] = base | set(draw.sample(common, draw.randrange(0, 7)))
        if i % 5 == 4:
            out[i] = set(list(out[i - 1])[: draw.randrange(1, 20)]) | {f"y{i}"}
    return out


def members(spark, sets):
    return spark.createDataFrame([(i, v) for i, s in sets.items() for v in s], "id long, v string").select("id", F.xxhash64("v").alias("item")).repartition(5)


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.8, 1.0])
def test_alike_by_share(spark, sets, threshold, monkeypatch):
    monkeypatch.setattr(set_join, "KEY_ROWS", 3)
    want = [(a, b, len(sets[a] & sets[b])) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] & sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9]
    got = set_join.alike_by_share(members(spark, sets), threshold)
    assert rows_of(got.select("a", "b", "shared")) == sorted(want, key=repr)


@pytest.mark.parametrize("overlap", [1, 3, 6])
def test_alike_by_count(spark, sets, overlap, monkeypatch):
    monkeypatch.setattr(set_join, "KEY_ROWS", 4)
    want = [(a, b, len(sets[a] & sets[b])) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= overlap]
    assert rows_of(set_join.alike_by_count(members(spark, sets), overlap)) == sorted(want, key=repr)


def test_prefixes_leave_frequent_elements_out(spark):
    """An element of every set is no key where sets have rarer ones enough."""
    own = spark.createDataFrame([(i, v) for i in range(200) for v in (["all"] + [f"r{i}-{k}" for k in range(8)] + [f"p{i // 2}"])], "id long, v string").select("id", F.xxhash64("v").alias("item"))
    assert set_join.alike_by_share(own, 0.5).count() == 0
    assert set_join.alike_by_count(own, 2).count() == 100


def test_weighted_pairs(spark):
    draw = random.Random(8)
    some = lambda n: [f"w{draw.randrange(9)}" for _ in range(draw.randrange(n))]
    data = [(i, some(6), some(9), some(4)) for i in range(50)]
    share = lambda a, b: len({*a} & {*b}) / len({*a} | {*b}) if a and b else 0.0
    want = [(p[0], q[0]) for p, q in itertools.combinations(data, 2) if round(0.5 * share(p[1], q[1]) + 0.3 * share(p[2], q[2]) + 0.2 * share(p[3], q[3]), 4) >= 0.4]
    df = spark.createDataFrame(data, "id long, h array<string>, b array<string>, o array<string>")
    assert rows_of(set_join.weighted_pairs(df, "id", {"h": 0.5, "b": 0.3, "o": 0.2}, 0.4).select("a", "b")) == sorted(want, key=repr)


def test_pairs_of_copies(spark):
    text = "one two three four five six seven eight"
    df = spark.createDataFrame([(1, text), (2, text), (3, text + " nine"), (4, None), (5, "")], "id long, text string")
    assert rows_of(similarity.pair_overlaps(df, "id", "text")) == [(1, 3, 4, 0.8)]
    assert rows_of(similarity.copies(df, "id", "text")) == [(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 4, 2), (5, 4, 2)]


# --- kept state


def added(old, new):
    both = new.join(old.withColumnRenamed("n", "m"), "k", "full")
    return both.select("k", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))


def test_keyed_store(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}/store", ["k"], "k string, n long", buckets=8)
    part = lambda *kv: spark.createDataFrame(list(kv), "k string, n long")
    assert store.version() == 0 and store.read().count() == 0
    assert store.merge(part(("a", 1), ("b", 2), (None, 5)), 1, added)
    assert not store.merge(part(("a", 100)), 1, added)  # run again: nothing happens
    assert store.merge(part(("b", 10), ("c", 3)), 4, added)
    assert rows_of(store.read()) == [("a", 1), ("b", 12), ("c", 3), (None, 5)]
    assert rows_of(store.read(1)) == [("a", 1), ("b", 2), (None, 5)]
    with pytest.raises(ValueError):
        store.merge(part(("a", 1)), 2, added)

    def killed(old, new):
        raise RuntimeError("the executor is gone")

    with pytest.raises(RuntimeError):
        store.merge(part(("a", 7)), 5, killed)
    # rows that were written without their manifest are not there, and are written anew
    part(("a", 999)).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"file://{tmp_path}/store/rows/version=5")
    assert store.version() == 4 and rows_of(store.read()) == [("a", 1), ("b", 12), ("c", 3), (None, 5)]
    assert store.merge(part(("a", 7)), 5, added)
    assert rows_of(store.read()) == [("a", 8), ("b", 12), ("c", 3), (None, 5)]
    # a version that empties the table
    assert store.merge(part(), 6, lambda old, new: old.where("false"), everywhere=True)
    assert store.version() == 6 and store.read().count() == 0


def episodes(rows, quiet):
    out = []
    for key in {k for k, _, _ in rows}:
        at = sorted(t for k, t, seen in rows if k == key and seen)
        for i, t in enumerate(at):
            if i == 0 or t - at[i - 1] > quiet:
                out.append([key, t, t, 0])
            out[-1][2], out[-1][3] = t, out[-1][3] + 1
    return out


def test_episodes_after_a_restart(spark, tmp_path):
    """Files in any order within the watermark, a stream that stops and goes on from its checkpoint."""
    draw = random.Random(4)
    hour = 3600
    rows = [(draw.choice(["a", "b", None]), draw.randrange(200 * hour), draw.random() < 0.5) for _ in range(150)] + [("end", 400 * hour, False)]
    rows.sort(key=lambda r: r[1] + draw.randrange(10 * hour))
    want = sorted((k, t, u, n) for k, t, u, n in map(tuple, episodes(rows, 12 * hour)) if k is not None)
    schema = "key string, at long, seen boolean"
    source, out, check = (f"file://{tmp_path}/{x}" for x in ("source", "out", "check"))

    def feed(part):
        df = spark.createDataFrame(part, schema).select("key", F.timestamp_seconds("at").alias("ts"), "seen")
        df.coalesce(1).write.mode("append").parquet(source)
        return df.schema

    def run(kinds):
        stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(source)
        streams.drained(streams.finding_episodes(stream, "ts", ["key"], 12 * hour, "seen"), out, check)

    feed(rows[:60])
    run(feed(rows[60:90]))
    run(feed(rows[90:]))
    told = spark.read.parquet(out)
    got = told.where("key IS NOT NULL").select("key", F.unix_seconds("first_seen"), F.unix_seconds("last_seen"), "seen_count")
    assert rows_of(got) == sorted(want, key=repr)
    assert told.where("key IS NULL").agg(F.sum("seen_count")).first()[0] == sum(1 for k, _, s in rows if k is None and s)


def test_finding_states_as_checks_arrive(spark, tmp_path):
    """A finding opens, is seen again, resolves, and opens anew."""
    schema = "path string, rule string, checked_at string, tripped boolean"
    checks = [[("/a", "x", "d1", True), ("/b", "x", "d1", True)], [("/a", "x", "d2", True), ("/b", "x", "d2", False)], [("/a", "x", "d3", False), ("/b", "x", "d3", True)]]
    source, out = f"file://{tmp_path}/checks", f"file://{tmp_path}/out"
    for part in checks:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    streams.drained(streams.lifecycle(spark.readStream.schema(schema).parquet(source)), out, f"file://{tmp_path}/check", mode="update")
    last = spark.read.parquet(out).groupBy("path").agg(F.max_by(F.struct("state", "first_seen", "last_seen", "seen_count"), "batch").alias("r")).select("path", "r.*")
    assert rows_of(last) == [("/a", "resolved", "d1", "d2", 2), ("/b", "open", "d3", "d3", 1)]


def test_snapshots_delivered_twice(spark, tmp_path):
    source, out, check = (f"file://{tmp_path}/{x}" for x in ("source", "out", "check"))
    schema = "k string, part int"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    for part in ([("a", 0), ("b", 0), ("b", 0)], [("b", 1), ("c", 1)], [("b", 1), ("c", 1)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        streams.snapshot_changes(stream(), "part", ["k"], out, check)
    assert rows_of(spark.read.parquet(out).select("k", "state", "part")) == [("a", "entrant", 0), ("a", "exit", 1), ("b", "entrant", 0), ("b", "held", 1), ("c", "entrant", 1)]


# --- robots


def test_tries_against_patterns():
    draw = random.Random(9)
    for _ in range(150):
        patterns = {"".join(draw.choice("/ab*") for _ in range(draw.randrange(0, 6))) + draw.choice(["", "$"]): draw.random() < 0.5 for _ in range(6)}
        trie = robots_tries.RuleTrie()
        for p, allow in patterns.items():
            trie.add(p, allow)
        for _ in range(20):
            path = "/" + "".join(draw.choice("/ab") for _ in range(draw.randrange(6)))
            fits = [(len(p), allow) for p, allow in patterns.items() if p and re.match("^" + re.escape(p).replace(r"\*", ".*").replace(r"\$", "$"), path)]
            assert trie.best(path) == max(fits, default=None), (patterns, path)


def test_robots_files(spark, monkeypatch):
    """Shared groups, comments, ties, orphans; a host whose paths are dealt out; the same as by regular expressions."""
    monkeypatch.setattr(robots_tries, "HOST_PATHS", 2)
    bodies = spark.createDataFrame(
        [
            ("shared", "Disallow: /orphan\nUser-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\n\nUser-agent: *\nDisallow: /private # note\nAllow: /private/ok\nDisallow: /*.pdf$\nDisallow:\n"),
            ("closed", "User-agent: *\nDisallow: /\nUser-agent: GPTBot\nAllow: /\n"), ("tie", "User-agent: *\nAllow: /page\nDisallow: /page\n"), ("html", "<html>User-agent: *</html>"),
        ],
        "host string, body string",
    )
    rules = agents.robots_rules(bodies, "host")
    paths = ["/x", "/", "/private/no", "/private/ok/1", "/a/b.pdf", "/a/b.pdf?x", "/page", ""]
    bots = ["GPTBot", "ccbot", "Googlebot"]
    asked = spark.createDataFrame([(h, p) for h in ("shared", "closed", "tie", "html", "none") for p in paths], "host string, path string")
    groups = robots_tries.chosen_groups(rules, spark.createDataFrame([(b,) for b in bots], "bot string"), "host")
    told = robots_tries.resolve_paths(rules.select("host", "grp", "field", "pattern").distinct(), asked, "host", "path").join(groups, ["host", "grp"]).select("host", "bot", "path", "allowed")
    plain = agents.resolve(rules, asked.crossJoin(spark.createDataFrame([(b,) for b in bots], "bot string")), "host").where("agent IS NOT NULL").select("host", "bot", "path", "allowed")
    assert rows_of(told) == rows_of(plain) and told.count() == 3 * len(paths) * len(bots)
    assert {tuple(r) for r in told.where("path = '/' AND host = 'shared'").select("bot", "allowed").collect()} == {("GPTBot", False), ("ccbot", False), ("Googlebot", True)}


# --- intervals, links, order statistics, trees, sketches


@pytest.mark.parametrize("width", [None, 1, 7, 1000])
def test_overlap_join(spark, width):
    draw = random.Random(2)
    span = lambda: (draw.choice(["k", "l", None]), *sorted(draw.randrange(-50, 60) for _ in range(2)))
    a = [(i, *span()) for i in range(60)] + [(900, "k", None, 4), (901, "k", 9, 3), (902, "l", -10_000, 10_000)]
    b = [(i, *span()) for i in range(60)] + [(902, "k", -30, -30)]
    schema = "id long, k string, start long, end long"
    want = [(p[0], q[0]) for p in a for q in b if p[1] is not None and p[1] == q[1] and p[2] is not None and p[2] <= p[3] and p[2] <= q[3] and q[2] <= p[3]]
    got = intervals.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema).withColumnRenamed("id", "other"), ["k"], width=width)
    assert rows_of(got.select("id", "other")) == sorted(want, key=repr)
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_links(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("a", "c"), ("c", "c"), ("d", "a"), (None, "a"), ("a", None)], "source string, target string")
    assert rows_of(link_graph.unreturned(links)) == [("a", "c"), ("d", "a")]
    hub = spark.createDataFrame([(f"p{i:04d}", "hub") for i in range(500)] + [("p0001", "hub"), ("x", "y")], "source string, target string")
    assert rows_of(link_graph.fan_in(hub, 2)) == [("hub", 500, "p0000 p0001"), ("y", 1, "x")]
    pages = spark.createDataFrame([("b",), ("b",), (None,)], "url string")
    assert rows_of(link_graph.with_status(links, pages).groupBy("target", "known").count()) == sorted([("a", False, 3), ("b", True, 1), ("c", False, 3), (None, False, 1)], key=repr)


def test_annotated_pages(spark):
    """Returns are asked of pages that were read only; alternates by their status."""
    pair = lambda *xs: [tuple(x.split("=", 1)) for x in xs]
    pages = spark.createDataFrame(
        [("https://a.b/en", False, pair("en=https://a.b/en", "de=https://a.b/de", "fr=https://a.b/fr")), ("https://a.b/de", False, pair("de=https://a.b/de/", "en=https://a.b/en")), ("https://a.b/fr", False, pair("fr=https://a.b/fr")), ("https://a.b/un", True, pair("en=https://a.b/en")), ("https://a.b/src", False, pair("de=https://a.b/un"))],
        "url string, unread boolean, alternates array<struct<code:string,href:string>>",
    )
    assert rows_of(locales.missing_return(pages)) == [("https://a.b/en", "https://a.b/fr")]
    statuses = spark.createDataFrame([("https://a.b/en", 200), ("https://a.b/de", 301), ("https://a.b/fr", 404)], "url string, status int")
    assert rows_of(locales.status_findings(pages, statuses)) == [("https://a.b/de", "high", "alternate_redirects", 2), ("https://a.b/fr", "critical", "alternate_dead", 2), ("https://a.b/un", "medium", "alternate_unreachable", 1)]


def test_order_statistics(spark):
    draw = random.Random(6)
    data = [(draw.choice(["a", "b", None]), draw.choice([None, *range(40)])) for _ in range(700)] + [("one", 5), ("none", None)]
    shares = {"low": 0.0, "median": 0.5, "p90": 0.9}
    want = []
    for g in {g for g, _ in data}:
        own = sorted(v for h, v in data if h == g and v is not None)
        if own:
            want.append((g, len(own), *[own[int(len(own) * q)] for q in shares.values()]))
    df = spark.createDataFrame(data, "g string, v long").repartition(6)
    assert rows_of(order_stats.order_statistics(df, "v", shares, ["g"])) == sorted(want, key=repr)
    every = sorted(v for _, v in data if v is not None)
    assert rows_of(order_stats.order_statistics(df, "v", shares)) == [(len(every), every[0], every[len(every) // 2], every[int(len(every) * 0.9)])]
    assert rows_of(order_stats.order_statistics(df.limit(0), "v", shares)) == [(0, None, None, None)]
    assert order_stats.order_statistics(df.limit(0), "v", shares, ["g"]).count() == 0


def test_type_trees(spark):
    tree = [{"typeGroup": "Article", "types": [{"value": "Article"}], "nodeProperties": [{"pred": "author", "value": [{"typeGroup": "Person", "types": [{"value": None}], "nodeProperties": [{"value": [{"typeGroup": "X", "types": [{"value": "Place"}, {"value": "Place"}]}]}]}]}]}]
    rows = [("u", json.dumps(tree)), ("v", "[]"), ("w", None), ("x", "{broken"), ("y", '{"types": [{"value": "One"}], "nodeProperties": [{"value": "text"}]}'), ("z", "5")]
    df = spark.createDataFrame(rows, "url string, tree string")
    assert rows_of(trees.count_types(df, "url", "tree")) == [("u", "Article", 1), ("u", "Person", 1), ("u", "Place", 2), ("x", "malformed", 1), ("y", "One", 1)]
    deep = spark.createDataFrame([(1, '{"a": [1, {"b": null}, "x"], "c": {}}'), (2, "oops")], "k long, j string")
    assert rows_of(trees.node_types(deep, "k", "j").select("path", "type")) == sorted([("$", "OBJECT"), ("$.a", "ARRAY"), ("$.a[]", "BIGINT"), ("$.a[]", "OBJECT"), ("$.a[]", "STRING"), ("$.a[].b", "VOID"), ("$.c", "OBJECT"), ("$", "malformed")], key=repr)


def test_sketches(spark):
    df = spark.range(60_000).select((F.col("id") % 20_000).alias("v"), F.timestamp_seconds(F.col("id") % 10 * 86400 + 60).alias("ts"), F.lit("k").alias("k"))
    days = sketches.daily_sketches(df, "ts", ["k"], "v")
    assert days.count() == 10
    one = sketches.distinct_between(days, ["k"], "1970-01-02", "1970-01-06").first()
    exact = df.where("to_date(ts) BETWEEN '1970-01-02' AND '1970-01-06'").select("v").distinct().count()
    assert one["n"] == 30_000 and abs(one["distinct"] - exact) <= 0.03 * exact


def test_lookups(spark):
    queue = spark.createDataFrame([("ab12cd", "rank-tracker", "Rank Tracker", "rank tracker", None, 1), ("ab12xx", "faq", "FAQ", "faq page", "a.com", 2), ("zz99", "ab12", "Other", "ab12cd", "b.com", 3), ("yy88", "last", None, None, None, 4)], "id string, slug string, title string, keyword string, domain string, ord int")
    idents = spark.createDataFrame([("ab12cd",), ("ab12",), ("FAQ",), ("b.com",), ("ab1",), (None,)], "ident string")
    assert rows_of(state.looked_up(queue, idents)) == sorted([("ab12cd", "ab12cd"), ("ab12", "ab12cd"), ("FAQ", "ab12xx"), ("b.com", "zz99"), ("ab1", None), (None, None)], key=repr)
    pages = spark.createDataFrame([(1, "rank-tracker", "rank tracker"), (2, "tracker", "tracker"), (3, "x/faq", "faq page")], "ord int, slug string, keyword string")
    stems = spark.createDataFrame([("guides/rank-tracker",), ("faq",), ("none",)], "stem string")
    assert rows_of(state.slug_matches(pages, stems)) == [("faq", "faq page"), ("guides/rank-tracker", "rank tracker"), ("none", None)]
