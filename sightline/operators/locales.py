"""Language annotations: codes, reciprocity of alternates, parity of translations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import normal_url, part

#: Codes that are often written and wrong, and what was meant.
KNOWN_BAD = {"en-uk": "en-GB", "en-eu": "en", "es-la": "es-419", "eng": "en", "deu": "de", "fra": "fr", "spa": "es", "por": "pt", "zho": "zh", "jpn": "ja", "jp": "ja", "gb": "en-GB", "cn": "zh-CN", "gr": "el", "dk": "da", "il": "he"}
#: Languages whose codes are also those of other countries.
CONFUSABLE = {"uk": "en-GB", "be": "nl-BE / fr-BE", "se": "sv-SE", "ie": "en-IE", "ca": "en-CA / fr-CA", "br": "pt-BR"}
#: Scripts that are named in codes.
SCRIPTS = "Hans Hant Latn Cyrl Arab Hebr Grek Jpan Kore Deva Thai Beng Guru Taml Telu Knda Mlym Sinh Mymr Khmr Laoo Ethi Geor Armn Cans Tfng Vaii Adlm Orya Gujr".split()
#: Usual lengths of translations against English.
EXPANSION = {"de": (1.10, 1.50), "nl": (1.10, 1.45), "fr": (1.00, 1.40), "es": (1.00, 1.40), "pt": (1.00, 1.40), "it": (1.00, 1.40), "ru": (0.95, 1.35), "pl": (0.95, 1.35), "uk": (0.95, 1.35), "tr": (0.85, 1.25), "ja": (0.55, 1.00), "zh": (0.50, 0.95), "ko": (0.60, 1.05), "th": (0.70, 1.20), "ar": (0.80, 1.25)}
OTHER_EXPANSION = (0.55, 1.55)


def iso_codes(spark: SparkSession) -> tuple[list[str], list[str]]:
    """(languages, regions): the two-letter registers, from the platform's own tables."""
    locale = spark._jvm.java.util.Locale
    return sorted(set(locale.getISOLanguages()) | {"he", "id", "yi"}), sorted(locale.getISOCountries())


def validate(code: Column, languages: list[str], regions: list[str]) -> Column:
    """struct<valid, severity, note> of a language code; the first rule that decides counts."""
    raw = F.trim(F.coalesce(code, F.lit("")))
    low, parts = F.lower(raw), F.split(raw, "-")
    lang = F.lower(parts[0])
    has_script = (F.size(parts) > 1) & F.coalesce(F.get(parts, F.lit(1)).rlike("^[A-Za-z].{3}$"), F.lit(False))
    script = F.when(has_script, F.initcap(F.get(parts, F.lit(1))))
    rest = F.when(has_script, F.slice(parts, 3, 9)).otherwise(F.slice(parts, 2, 9))
    given = F.get(rest, F.lit(0))
    region = F.when(given.rlike(r"^\d+$"), given).otherwise(F.upper(given))
    known = F.create_map(*[F.lit(x) for kv in KNOWN_BAD.items() for x in kv])
    twin = F.create_map(*[F.lit(x) for kv in CONFUSABLE.items() for x in kv])
    standard = F.concat_ws("-", lang, script, region)
    out = lambda valid, severity, note: F.struct(F.lit(valid).alias("valid"), F.lit(severity).alias("severity"), (F.lit(note) if note is None or isinstance(note, str) else note).cast("string").alias("note"))
    return (
        F.when(raw == "", out(False, "high", "empty"))
        .when(low == "x-default", out(True, "info", "fallback marker"))
        .when(F.map_contains_key(known, low), out(False, "high", F.concat(F.lit("did you mean "), F.try_element_at(known, low))))
        .when(~lang.isin(languages) & (F.length(lang) == 2) & F.upper(lang).isin(regions), out(False, "high", "a country, not a language"))
        .when(~lang.isin(languages) & (F.length(lang) == 3), out(False, "high", "three letters, two are wanted"))
        .when(~lang.isin(languages), out(False, "high", "not a language code"))
        .when((F.size(rest) > 0) & ~given.rlike(r"^\d+$") & ~F.upper(given).isin(regions), out(False, "high", "not a region code"))
        .when(F.size(rest) > 1, out(False, "medium", "unexpected trailing subtag"))
        .when((F.size(rest) > 0) & (raw != standard), out(True, "low", F.concat(F.lit("write "), standard)))
        .when(has_script & ~script.isin(SCRIPTS), out(True, "info", "script not listed"))
        .when((F.size(rest) == 0) & F.map_contains_key(twin, lang), out(True, "info", F.concat(F.lit("if the country was meant: "), F.try_element_at(twin, lang))))
        .otherwise(out(True, "info", None))
    )


def edges(pages: DataFrame) -> DataFrame:
    """(src, dst, code, href) of the alternates of pages (url, unread, alternates) that were read; addresses in normal form."""
    e = pages.where("not unread").select(F.col("url").alias("page"), normal_url("url").alias("src"), F.explode("alternates").alias("a"))
    return e.select("page", "src", normal_url("a.href").alias("dst"), F.col("a.code").alias("code"), F.col("a.href").alias("href"))


def missing_return(pages: DataFrame) -> DataFrame:
    """(src, dst): declared alternates of pages that were read and do not declare back; unread ones are not judged."""
    e = edges(pages).where("href <> ''").select("src", "dst").distinct().where("src <> dst")
    read = pages.where("not unread").select(normal_url("url").alias("dst"))
    back = e.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    return e.join(read, "dst", "left_semi").join(back, ["src", "dst"], "left_anti").select("src", "dst")


def status_findings(pages: DataFrame, statuses: DataFrame) -> DataFrame:
    """(url, severity, rule, advertised_by) of alternates that do not answer with 200; statuses has url and status (null: not reached)."""
    by = edges(pages).where("href <> ''").groupBy(F.col("dst").alias("url")).agg(F.countDistinct("page").alias("advertised_by"))
    j = by.join(statuses.select(normal_url("url").alias("url"), "status"), "url", "left").where(F.coalesce("status", F.lit(0)) != 200)
    kind = F.when(F.col("status").isNull(), F.struct(F.lit("medium").alias("severity"), F.lit("alternate_unreachable").alias("rule"))).when(F.col("status").between(300, 399), F.struct(F.lit("high").alias("severity"), F.lit("alternate_redirects").alias("rule"))).otherwise(F.struct(F.lit("critical").alias("severity"), F.lit("alternate_dead").alias("rule")))
    return j.select("url", kind.alias("k"), "advertised_by").select("url", "k.*", "advertised_by")


def mesh_findings(pages: DataFrame, languages: list[str], regions: list[str]) -> DataFrame:
    """(url, severity, rule) of a set of annotated pages: url, unread, alternates, n_in_body, canonical, html_lang."""
    read = pages.where("not unread")
    e = edges(pages)
    flag = lambda df, severity, rule: df.select("url", F.lit(severity).alias("severity"), F.lit(rule).alias("rule"))
    by_page = e.groupBy(F.col("page").alias("url"), "src").agg(
        F.bool_or((F.col("dst") == F.col("src")) & (F.col("href") != "")).alias("lists_self"), F.countDistinct(F.when(F.lower(F.trim("code")) == "x-default", F.struct("code", "href"))).alias("n_default"),
        F.count_if(F.lower(F.trim("code")) == "x-default").alias("defaults"), F.countDistinct(F.nullif(part("href", 1), F.lit(""))).alias("schemes"), F.count_if((F.col("href") != "") & (part("href", 2) == "")).alias("relative"),
        F.min(F.when((F.col("dst") == F.col("src")) & (F.lower("code") != "x-default"), F.lower("code"))).alias("self_code"),
    )
    j = by_page.join(read.select("url", "canonical", "html_lang"), "url")
    codes = e.select(F.col("page").alias("url"), validate(F.col("code"), languages, regions).alias("v"))
    twice = e.groupBy(F.col("page").alias("url"), F.lower("code").alias("c")).agg(F.countDistinct("dst").alias("n")).where("n > 1")
    speaks = F.substring_index(F.lower("html_lang"), "-", 1)
    parts = [
        flag(read.where("n_in_body > 0"), "high", "hreflang_outside_head"),
        codes.where("not v.valid").select("url", F.col("v.severity").alias("severity"), F.lit("invalid_code").alias("rule")),
        codes.where("v.valid and v.severity <> 'info' and v.note is not null").select("url", F.col("v.severity").alias("severity"), F.lit("code_convention").alias("rule")),
        flag(twice, "high", "duplicate_code_conflict"), flag(j.where("not lists_self"), "critical", "missing_self_reference"), flag(j.where("defaults > 1"), "medium", "multiple_x_default"),
        flag(j.where((F.coalesce("canonical", F.lit("")) != "") & (normal_url("canonical") != F.col("src"))), "high", "hreflang_on_non_canonical"),
        flag(j.where((F.coalesce("html_lang", F.lit("")) != "") & F.col("self_code").isNotNull() & (F.substring_index("self_code", "-", 1) != speaks)), "medium", "html_lang_mismatch"),
        flag(j.where("schemes > 1"), "medium", "mixed_protocol"), flag(j.where("relative > 0"), "high", "relative_alternate_href"),
        flag(missing_return(pages).withColumnRenamed("src", "url"), "critical", "missing_return_tag"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def parity_findings(rows: DataFrame, reference: str) -> DataFrame:
    """(url, severity, rule) of locale rows (code, url, read, title, description, h1, h2_count, h3_count, img_count, schema_types, words, html_lang) against the row of the reference url.

    Without a reference that was read nothing is told, but for unread rows.
    """
    from .markup import fired

    ref = rows.where((F.col("url") == reference) & F.col("read")).select(F.struct(*rows.columns).alias("r"))
    bands = F.create_map(*[F.lit(x) if not isinstance(x, tuple) else F.array(*map(F.lit, x)) for kv in EXPANSION.items() for x in kv])
    lang = F.substring_index(F.lower("code"), "-", 1)
    band = F.coalesce(F.try_element_at(bands, lang), F.array(*map(F.lit, OTHER_EXPANSION)))
    same = lambda c: (F.coalesce(F.col(c), F.lit("")) != "") & (F.col(c) == F.col(f"r.{c}"))
    drift = lambda c: (F.col(f"r.{c}") > 0) & (F.abs(F.col(c) - F.col(f"r.{c}")) > F.greatest(F.lit(1), F.round(F.col(f"r.{c}") * 0.34)))
    ratio = F.col("words") / F.col("r.words")
    speaks = F.substring_index(F.lower(F.coalesce("html_lang", F.lit(""))), "-", 1)
    judged = rows.where(F.col("read") & (F.col("url") != reference)).crossJoin(F.broadcast(ref))  # one row
    unread = rows.where("not read").select("url", F.lit("medium").alias("severity"), F.lit("locale_unread").alias("rule"))
    found = fired(
        judged, ["url"],
        [
            ("high", "title_not_localised", same("title")), ("medium", "description_not_localised", same("description")), ("medium", "h1_not_localised", same("h1")), ("low", "structure_drift", drift("h2_count")), ("low", "structure_drift", drift("h3_count")), ("low", "structure_drift", drift("img_count")),
            ("medium", "schema_missing_on_locale", F.size(F.array_except("r.schema_types", "schema_types")) > 0), ("low", "length_ratio_outlier", (F.col("r.words") >= 120) & (F.col("words") > 0) & ~ratio.between(band[0], band[1])), ("medium", "html_lang_mismatch", (speaks != "") & (speaks != lang)),
        ],
    )
    return unread.unionAll(found)


def collapse(findings: DataFrame, population: int, share: float = 0.6) -> DataFrame:
    """(rule, url, affected, systematic): a rule that most of the population trips becomes one row; others stay as they are."""
    counts = findings.groupBy("rule").agg(F.count("*").alias("affected"))
    whole = (F.col("affected") >= 4) & (F.col("affected") / F.lit(max(population, 1)) >= share) & F.lit(population >= 4)
    kept = findings.join(counts.where(~whole), "rule").select("rule", "url", F.lit(1).cast("long").alias("affected"), F.lit(False).alias("systematic"))
    return kept.unionAll(counts.where(whole).select("rule", F.lit(None).cast("string").alias("url"), "affected", F.lit(True).alias("systematic")))
