"""Cases that the tables do not hold: refusals, unknown values, order and ties."""

import pytest
from pyspark.sql import functions as F

from sightline.functions import text as X
from sightline.functions.graph import components
from sightline.operators import crawl, keywords, locales, markup, search_metrics, similarity, slop, state
from sightline.sources import logs, sitemaps, tables


def test_no_input_is_refused(spark):
    with pytest.raises(ValueError):
        logs.read_lines(spark, [])


def test_empty_period_is_refused(spark):
    rows = spark.createDataFrame([("2024-01-01",), (None,)], "day string")
    with pytest.raises(ValueError):
        search_metrics.split_periods(rows, "day", "2024-02-01")


def test_unparsed_log_gives_no_share(spark):
    r = crawl.totals(logs.parsed(spark.createDataFrame([("x",)], "line string"))).first()
    assert (r.unread, r.bot_share) == (1, None)


def test_specific_agents_come_first(spark):
    rows = [("Googlebot-Image/1.0", "googlebot-image"), ("OAI-SearchBot", "oai-searchbot"), ("Googlebot/2.1 (+http://x)", "googlebot"), ("Firefox", None), ("a crawler", "other-bot")]
    got = spark.createDataFrame(rows, "ua string, key string").select("key", crawl.bot_key(F.col("ua")).alias("got")).collect()
    assert all(r.key == r.got for r in got)


def test_one_company_is_no_spoof(spark):
    hits = spark.createDataFrame([("1.1.1.1", "googlebot"), ("1.1.1.1", "googlebot-image"), ("2.2.2.2", "googlebot"), ("2.2.2.2", "gptbot"), ("2.2.2.2", "other-bot")], "ip string, key string")
    assert [(r.ip, r.operators, r.hits) for r in crawl.spoofed(hits).collect()] == [("2.2.2.2", "Google,OpenAI", 2)]


def test_shingles_of_short_lists(spark):
    df = spark.createDataFrame([(["a"],), ([],), (["a", "b", "a", "b"],)], "w array<string>")
    assert [r[0] for r in df.select(X.shingles("w", 2)).collect()] == [[], [], ["a b", "b a"]]


def test_distribution_takes_the_upper_median(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 4.0)], "v double")
    r = similarity.distribution(df, "v").first()
    assert (r["median"], r["p10"], r["p90"], r["n"]) == (3.0, 1.0, 4.0, 4)
    assert similarity.distribution(df.limit(0), "v").count() == 0


def test_rows_are_numbered_through(spark):
    df = spark.range(0, 1000, 1, 7).withColumn("k", F.col("id") * 7 % 1000)
    got = {r.k: r["__i"] for r in similarity.number_rows(df, "k").collect()}
    assert got == {i: i for i in range(1000)}
    assert similarity.even_sample(df, "k", 10).count() == 10 and similarity.even_sample(df, "k", 5000).count() == 1000


def test_site_wide_needs_fallen_demand(spark):
    rows = [("decay",)] * 9 + [("stable",)]
    assert not search_metrics.verdict_counts(spark.createDataFrame(rows, "verdict string")).first().site_wide
    assert search_metrics.verdict_counts(spark.createDataFrame([*rows, ("demand_drop",)], "verdict string")).first().site_wide


def test_unknown_difficulty_is_kept(spark):
    rows = spark.createDataFrame([("a", None, 50)], "keyword string, kd double, volume long")
    assert keywords.affordable(rows, 1.0, 10).count() == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(61)} == {0} and got[101] == 100
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_parity_without_reference(spark):
    row = ("de", "/de", True, "T", "D", "H", 1, 1, 1, ["A"], 100, "de")
    df = spark.createDataFrame([row], "code string, url string, read boolean, title string, description string, h1 string, h2_count int, h3_count int, img_count int, schema_types array<string>, words int, html_lang string")
    assert locales.parity_findings(df, "/en").count() == 0


def test_clean_prose_has_no_hits(spark):
    df = spark.createDataFrame([(1, "We measured forty servers for a week. Two of them failed."), (2, None)], "id long, text string")
    assert slop.rule_counts(df, "id", "text").count() == 0 and slop.places(df, "id", "text").count() == 0
    assert {r.verdict for r in slop.verdicts(df, "id", "text").collect()} == {"pass"}


def test_each_prose_rule_fires(spark):
    texts = {
        "throat_clearing": "Here's the kicker", "emphasis_crutch": "Let that sink in", "pedagogical": "Imagine a world where", "binary_contrast": "It is not slow, it's careful. ", "negative_listing": "Not a bug. Not a feature.", "rhetorical_question": "The catch? None", "magic_adverb": "quietly", "ai_vocabulary": "a tapestry",
        "serves_as_dodge": "serves as a reminder", "landscape_noun": "the landscape of", "participle_analysis": "it grew, highlighting its reach", "stakes_inflation": "a new era", "signposted_conclusion": "In conclusion,", "bold_first_bullet": "- **Fast**: yes", "em_dash": "a — b", "unicode_arrow": "a → b", "vague_attribution": "Experts say",
        "lazy_extreme": "every single user", "tricolon": "red, green, and blue. ", "fragment_drama": "Done. And that's okay.",
    }
    df = spark.createDataFrame(list(texts.items()), "id string, text string")
    got = {(r.id, r.rule) for r in slop.rule_counts(df, "id", "text").collect()}
    assert {(k, k) for k in texts} <= got


def test_too_short_a_history_is_no_trend(spark):
    rows = [("a", i, 1.0) for i in range(12)] + [("b", i, 1.0) for i in range(13)]
    got = {r.key: r.direction for r in state.year_trend(spark.createDataFrame(rows, "key string, at int, value double")).collect()}
    assert got == {"a": None, "b": "flat"}


def test_sitemap_expansion(spark):
    bodies = {"i": "<sitemapindex><loc>s1</loc><loc>i</loc></sitemapindex>", "s1": "<urlset><loc>http://a/1</loc><loc>http://a/2</loc></urlset>"}
    store = spark.createDataFrame(list(bodies.items()), "url string, body string")
    got = sitemaps.expand(store.where("url = 'i'"), lambda urls: store.join(urls, "url"))
    assert sorted(r.loc for r in got.collect()) == ["http://a/1", "http://a/2"]


def test_malformed_markup(spark):
    df = spark.createDataFrame([("<html><body><b>x<p>one<script>var a='</p>';</script><p>two</p>",), ("",), (None,)], "html string")
    got = [r.words for r in markup.page_features(df).collect()]
    assert got[0] == 3 and got[1] == 0


def test_settling_pages(spark):
    p = spark.createDataFrame([("/a", 1, 50, 3.0)], "page string, clicks long, impressions long, position double")
    dates = spark.createDataFrame([("/a", "2024-12-25")], "page string, published string")
    assert search_metrics.compare(p, p, published=dates, previous_start="2025-01-01").first().verdict == "settling"
    assert search_metrics.compare(p, p, published=dates).first().verdict == "stable"


def test_save_keeps_old_versions(spark, tmp_path):
    first = tables.save(spark.range(3), str(tmp_path))
    second = tables.save(spark.range(5), str(tmp_path))
    assert spark.read.parquet(first).count() == 3 and spark.read.parquet(second).count() == 5
