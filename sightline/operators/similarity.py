"""Likeness of documents within a corpus: shared phrases, template share, pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import jaccard, shingle_hashes, shingles, tokenize
from ..sources.shared import materialize, spread
from .order_stats import order_statistics
from .set_join import alike_by_overlap, alike_by_share, members

PHRASE, OPENING = 5, 6
#: Rows of two numbers up to which a table is broadcast.
BROADCAST_ROWS = 1_000_000
#: Counters of phrases before these are counted one by one.
BUCKETS = 1 << 18


def phrases(df: DataFrame, id_col: str, text_col: str, n: int = PHRASE) -> DataFrame:
    """(id, phrase): the distinct n-word runs of each text."""
    texts = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    return texts.select("id", F.explode(shingles(tokenize("text"), n)).alias("phrase"))


def hashed(own: DataFrame) -> DataFrame:
    """Phrases by a hash of 128 bits, so that no text is shuffled."""
    return own.withColumns({"a": F.xxhash64("phrase"), "b": F.xxhash64(F.lit(1), "phrase")})


def phrase_hash(phrase: Column | str, n: int = PHRASE) -> Column:
    """The hash that phrase_sets has of a phrase of n words."""
    words = F.split(phrase, " ")
    return F.xxhash64(*[F.get(words, F.lit(k)) for k in range(n)])


def phrase_sets(df: DataFrame, id_col: str, text_col: str, n: int = PHRASE) -> DataFrame:
    """(id, hashes), written once: the distinct n-word runs of each text, by hashes of 64 bits and without making their texts.

    Texts of fewer words have an empty list. Only some thousands of hashes are
    ever looked up in the others, so that for one of them to be taken for another
    has odds of one in a million at a thousand million different phrases.
    """
    texts = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    return materialize(texts.select("id", shingle_hashes(tokenize("text"), n).alias("hashes")), "phrases")


def each_phrase(sets: DataFrame) -> DataFrame:
    """(id, h): a row for each phrase of phrase_sets."""
    return sets.select("id", F.explode("hashes").alias("h"))


def frequent(sets: DataFrame, limit: DataFrame) -> DataFrame:
    """(h) of the phrases in more rows than the limit (one row, at least 1), written.

    Phrases are counted by buckets of their hashes first: one over the limit is in
    a bucket over it, and as the limit is a share of the documents, few buckets
    are, however many documents. Only the phrases of these are counted one by one.
    Where the limit is a share, there are at most the mean number of phrases of a
    document over that share.
    """
    own = each_phrase(sets).select("h", F.pmod("h", F.lit(BUCKETS)).cast("int").alias("bucket"))
    over = lambda keys: own.groupBy(*keys).agg(F.count("*").alias("df")).crossJoin(F.broadcast(limit)).where("df > limit").select(*keys)
    full = bounded(materialize(over(["bucket"]), "buckets"))
    own = own.join(full, "bucket", "left_semi")
    return materialize(over(["h"]), "frequent")


def document_frequency(of: DataFrame) -> DataFrame:
    """(a, b, df) of hashed phrases."""
    return of.groupBy("a", "b").agg(F.count("*").alias("df"))


def bounded(keys: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for broadcast if its rows are few enough."""
    return F.broadcast(keys) if keys.count() <= most else keys


def rare_limit(sets: DataFrame, share: float) -> DataFrame:
    """(limit), one row: the most documents that a rare phrase stands in."""
    return sets.where(F.size("hashes") > 0).agg(F.greatest(F.lit(1), F.floor(F.count("*") * share)).alias("limit"))


def unique_ratio(df: DataFrame, id_col: str, text_col: str, n: int = PHRASE, rare_share: float = 0.05) -> DataFrame:
    """(id, n_phrases, n_rare, unique_ratio) of texts with n words or more.

    A phrase is rare that stands in at most max(1, floor(documents * share)) of them.
    """
    sets = phrase_sets(df, id_col, text_col, n)
    often = bounded(frequent(sets, rare_limit(sets, rare_share))).withColumn("often", F.lit(True))
    out = each_phrase(sets).join(often, "h", "left").groupBy("id").agg(F.count("*").alias("n_phrases"), F.count_if(F.col("often").isNull()).alias("n_rare"))
    return out.withColumn("unique_ratio", F.round(F.col("n_rare") / F.col("n_phrases"), 4))


def distribution(ratios: DataFrame, value: str) -> DataFrame:
    """Count, mean, upper median, p10 and p90 of a column: order statistics at floor(n * q).

    The mean has four digits; without values there is no row.
    """
    places = order_statistics(ratios, value, {"median": 0.5, "p10": 0.1, "p90": 0.9})
    mean = ratios.agg(F.round(F.avg(value), 4).alias("mean"))
    return places.crossJoin(F.broadcast(mean)).where("n > 0").select("n", "mean", "median", "p10", "p90")  # one row each


def histogram(ratios: DataFrame, value: str, buckets: int = 20) -> DataFrame:
    bucket = F.least(F.floor(F.col(value) * buckets), F.lit(buckets - 1)).cast("int")
    return ratios.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("documents"))


def bloat_verdict(median):
    """Of the median unique ratio: below 0.30 and 0.40."""
    return F.when(median < 0.30, "HIGH RISK").when(median < 0.40, "WATCH").otherwise("OK")


def template_groups(df: DataFrame, id_col: str, text_col: str, n: int = PHRASE, size: int = 8, rare_share: float = 0.05) -> DataFrame:
    """(signature, documents): groups of documents whose first ``size`` rare phrases are the same; those without rare phrases are a group."""
    sets = phrase_sets(df, id_col, text_col, n)
    often = frequent(sets, rare_limit(sets, rare_share))
    # so many in the order of a text hold its first rare ones, even if all the frequent ones come before
    most = size + often.count()
    texts = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    own = texts.select("id", F.explode(F.slice(F.sort_array(shingles(tokenize("text"), n)), 1, most)).alias("phrase")).withColumn("h", phrase_hash("phrase", n))
    place = F.row_number().over(W.partitionBy("id").orderBy("phrase"))
    few = own.join(bounded(often), "h", "left_anti").select("id", "phrase").withColumn("place", place).where(F.col("place") <= size)
    first = few.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("phrase")), "|").alias("signature"))
    groups = first.groupBy("signature").agg(F.count("*").alias("documents"))
    # documents without rare phrases are those that are left
    rest = sets.where(F.size("hashes") > 0).agg(F.count("*").alias("n")).crossJoin(first.agg(F.count("*").alias("m"))).select(F.lit("").alias("signature"), (F.col("n") - F.col("m")).alias("documents"))
    return groups.unionAll(rest).where("documents > 1")


def stock_phrases(draft: DataFrame, corpus: DataFrame, id_col: str, text_col: str, n: int = PHRASE, share: float = 0.5) -> DataFrame:
    """(phrase, n_docs): phrases of the draft that stand in at least max(2, that share of the corpus, rounded up) documents."""
    sets = phrase_sets(corpus, id_col, text_col, n)
    majority = corpus.agg(F.greatest(F.lit(2), F.ceil(F.count("*") * share)).alias("majority"))
    if draft is corpus:
        own = sets
        keys = frequent(sets, majority.select((F.col("majority") - 1).alias("limit")))
    else:
        own = phrase_sets(draft, id_col, text_col, n)
        keys = materialize(each_phrase(own).select("h").distinct(), "keys")
    keys = bounded(keys)
    counts = each_phrase(sets).join(keys, "h", "left_semi").groupBy("h").agg(F.countDistinct("id").alias("n_docs"))
    stock = bounded(materialize(counts.crossJoin(F.broadcast(majority)).where("n_docs >= majority").select("h", "n_docs"), "stock"))
    # the words of a phrase are taken from one document of the draft
    witness = each_phrase(own).join(stock, "h", "left_semi").groupBy("h").agg(F.min("id").alias(id_col))
    texts = draft.join(bounded(materialize(witness.select(id_col).distinct(), "witnesses")), id_col, "left_semi")
    return phrases(texts, id_col, text_col, n).select("phrase").distinct().withColumn("h", phrase_hash("phrase", n)).join(stock, "h").select("phrase", "n_docs")


def shared_phrases(left: DataFrame, right: DataFrame, id_col: str, other_id: str, text_col: str, n: int = PHRASE) -> DataFrame:
    """(left_id, right_id, shared): documents of two corpora with common phrases, through an inverted index."""
    a = phrases(left, id_col, text_col, n).withColumnRenamed("id", "left_id")
    b = phrases(right, other_id, text_col, n).withColumnRenamed("id", "right_id")
    return a.join(b, "phrase").groupBy("left_id", "right_id").agg(F.count("*").alias("shared"))


def copies(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, copy_id, n_copies): the least id among the rows of the same text, and their number; null texts are empty ones."""
    keyed = df.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("t"))
    groups = keyed.groupBy("t").agg(F.min("id").alias("copy_id"), F.count("*").alias("n_copies"))
    return keyed.join(groups.hint("merge"), "t").select("id", "copy_id", "n_copies")


def pair_overlaps(df: DataFrame, id_col: str, text_col: str, n: int = PHRASE, threshold: float = 0.5, least: int | None = None) -> DataFrame:
    """(a, b, shared, similarity) of pairs a < b of different texts whose phrases have a Jaccard similarity of ``threshold`` or more; with ``least``, that share so many phrases or more.

    A text stands for all its copies by their least id; copies() tells which rows
    these are. A phrase that many texts share is no key of the join.
    """
    reps = df.groupBy(F.coalesce(text_col, F.lit("")).alias("text")).agg(F.min(id_col).alias("id"))
    own = members(spread(reps), "id", shingle_hashes(tokenize("text"), n))
    return alike_by_overlap(own, least) if least else alike_by_share(own, threshold)


def sameness_flags(draft: DataFrame, corpus: DataFrame, heading_limit: float = 0.6) -> DataFrame:
    """(label, kind): what of a draft repeats a published document. Both sides have opening, headings (lists) and label."""
    d = draft.select(F.col("opening").alias("d_open"), F.col("headings").alias("d_heads"))
    joined = corpus.crossJoin(F.broadcast(d))  # one draft
    opening = joined.where(F.arrays_overlap(shingles("d_open", OPENING), shingles("opening", OPENING))).select("label", F.lit("opening").alias("kind"))
    headings = joined.where(jaccard("d_heads", "headings") > heading_limit).select("label", F.lit("headings").alias("kind"))
    return opening.unionAll(headings)


def new_section_gate(unique, words, pages):
    """Whether a new section of generated pages may ship, by its share of unique phrases, median words and size."""
    return F.when(unique < 0.30, "stop").when(pages > 500, "approval").when(unique < 0.40, "warn").when(words < 300, "flag").when(pages > 100, "sample").otherwise("ship")


def even_sample(df: DataFrame, order: str, limit: int) -> DataFrame:
    """``limit`` rows at even steps through an order, the first included; all rows if there are no more.

    Rows are numbered by range-partitioned sorting, so that no task holds them all.
    """
    numbered = number_rows(df, order)
    total = numbered.agg(F.count("*").alias("__n"))
    step = F.greatest(F.col("__n") / F.lit(limit), F.lit(1.0))
    k = F.ceil((F.col("__i") / step))
    chosen = (k < limit) & (F.floor(k * step) == F.col("__i"))
    return numbered.crossJoin(F.broadcast(total)).where(chosen).drop("__i", "__n")


def number_rows(df: DataFrame, *order: Column | str) -> DataFrame:
    """df with ``__i``, its place from 0 in the order: places within range partitions plus the sizes of those before."""
    # written once: the bounds of the ranges are sampled, and a second sampling could give others
    parts = materialize(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "numbered")
    local = parts.withColumn("__k", F.row_number().over(W.partitionBy("__p").orderBy(*order)) - 1)
    sizes = parts.groupBy("__p").agg(F.count("*").alias("__c"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__c").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("__p", "__before")
    return local.join(F.broadcast(before), "__p").withColumn("__i", F.col("__k") + F.col("__before")).drop("__p", "__k", "__before")
