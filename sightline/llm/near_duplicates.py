"""N-gram Jaccard join by MinHash banding.

1. Equal texts are one class; one row of a class stands for it.
2. Each class gets a MinHash signature of its word shingles, cut into bands;
   the number of bands and rows is chosen for a target recall.
3. Shuffle on band hashes. A bucket is known by its least row, its centre, and
   a centre that lies in buckets with a lower centre passes its buckets on, so
   that a family of near copies meets in few groups. Two rows of a bucket
   always share a group.
4. A group of any size is cut into blocks, and each pair of blocks is a task of
   its own: the full shingle sets are intersected there. A pair that shares
   several groups counts in the least of them only.
5. Tasks send the number of links of each row and one tree of links for each
   connected part, never all pairs; parts become classes as connected components.
6. Where only classes are asked for, a group of several blocks is first held
   against its least row. Rows linked to it are connected already; only pairs
   with a row that is not are compared, so that a family of m copies costs m
   comparisons and not their square. Numbers of links need all of them.
7. Joins by keys that many rows share deal these rows out over several tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.graph import components
from .common import HOT_ROWS, flag_possible, hot_join, materialize, pick, slices

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Most hash functions that a signature may have.
MOST_HASHES = 128
#: Rows and shingles of a block, about; a task of the verification holds two blocks.
BLOCK, BLOCK_GRAMS = 800, 400_000
_WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding whose chance to meet, at the threshold, is the recall or more."""
    best = (most, 1)
    for rows in range(1, most + 1):
        for bands in range(1, most // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                best = (bands, rows)
                break
    return best


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of all texts one after the other, repeats included, and how many each text has.

    A text with fewer words has one shingle, of all of them; one without words has none.
    """
    split = [t.lower().encode().translate(_WORD_BYTES).split() for t in texts]
    sizes = np.array([len(x) for x in split], np.int64)
    flat = [w for x in split for w in x]
    if not flat:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    h = np.append(pd.util.hash_array(np.array(flat, dtype=object), categorize=False), np.zeros(words - 1, np.uint64))
    starts = np.cumsum(sizes) - sizes
    counts = np.where(sizes >= words, sizes - words + 1, np.minimum(sizes, 1))
    place = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    left = np.repeat(starts + sizes, counts) - place
    out = np.zeros(len(place), np.uint64)
    for k in range(words):
        out = out * np.uint64(0x9E3779B97F4A7C15) + np.where(left > k, h[place + k], np.uint64(k + 1))
        out ^= out >> np.uint64(31)
    return out * np.uint64(0xBF58476D1CE4E5B9), counts


def band_hashes(texts: list[str], bands: int, rows: int, words: int = WORDS) -> tuple[list[list[int]], np.ndarray]:
    """Band hashes of each text (none for one without words), and its number of shingles."""
    found, counts = shingles(texts, words)
    rng = np.random.default_rng(20240101)
    factors = rng.integers(0, 2**31, bands * rows, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    masks = rng.integers(0, 2**32, bands * rows, dtype=np.int64).astype(np.uint32)
    some = counts > 0
    starts = (np.cumsum(counts) - counts)[some]
    low = (found >> np.uint64(32)).astype(np.uint32)
    signature = np.empty((len(starts), bands * rows), np.uint32)
    for k in range(bands * rows):
        x = (low ^ masks[k]) * factors[k]
        x ^= x >> np.uint32(15)
        if len(starts):
            signature[:, k] = np.minimum.reduceat(x, starts)
    key = np.full((len(starts), bands), np.uint64(0x51ED270B), np.uint64) + np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        key = (key ^ signature[:, k::rows].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    out: list[list[int]] = [[] for _ in texts]
    for i, row in zip(np.flatnonzero(some).tolist(), key.view(np.int64).tolist(), strict=True):
        out[i] = row
    return out, counts


def _signatures(docs: DataFrame, bands: int, rows: int, words: int) -> DataFrame:
    """A row number for each text, its keys of equality and its band hashes; written once."""
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", docs.schema["id"].dataType), T.StructField("ka", T.LongType()), T.StructField("kb", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch):
                keys, counts = band_hashes(part.column("text").to_pylist(), bands, rows, words)
                row = np.arange(number, number + part.num_rows)
                # a text without words equals no other
                ka = np.where(counts > 0, part.column("ka").to_numpy(zero_copy_only=False), row)
                kb = np.where(counts > 0, part.column("kb").to_numpy(zero_copy_only=False), 0)
                yield pa.RecordBatch.from_arrays([pa.array(row), part.column("id"), pa.array(ka), pa.array(kb), pa.array(counts), pa.array(keys, arrow[5].type)], schema=arrow)
                number += part.num_rows

    return materialize(docs.mapInArrow(run, schema), "signatures")


def _shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(row, grams): the sorted distinct shingle hashes of each text as bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found, counts = shingles(part.column("text").to_pylist(), words)
                ends = np.cumsum(counts)
                sets = [np.unique(found[b - n : b]).tobytes() for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(sets, pa.binary())], names=["row", "grams"])

    return texts.select("row", "text").mapInArrow(run, "row long, grams binary")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    out = np.diag(sizes).astype(np.int64)
    if n == 2:
        out[0, 1] = out[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return out
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.append(True, flat[1:] != flat[:-1]) if len(flat) else np.zeros(0, bool)
    number = np.cumsum(first) - 1
    shared = np.bincount(number) > 1 if len(number) else np.zeros(0, bool)  # a gram of one set adds to no pair
    column = np.cumsum(shared) - 1
    keep = shared[number]
    column, owner = column[number[keep]], owner[keep]
    total, width = np.zeros((n, n), np.float64), 8192
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, (low, low + width))
        part = np.zeros((n, width), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        total += part @ part.T
    np.fill_diagonal(total, 0)
    return out + np.rint(total).astype(np.int64)


def verify(rows: list[tuple[int, int, list[int], np.ndarray]], group: int, low: int, high: int, threshold: float) -> tuple[list[int], list[int], list[tuple[int, int]]]:
    """Links among the rows (row, block, groups, set) of one pair of blocks: rows, their links, and a tree of links for each part."""
    unique = {r[0]: r for r in rows}
    rows = [unique[k] for k in sorted(unique)]
    n = len(rows)
    if n < 2:
        return [], [], []
    common = intersections([r[3] for r in rows])
    sizes = np.diag(common)
    linked = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
    np.fill_diagonal(linked, False)
    if low != high:  # pairs within a block have a task of their own
        block = np.array([r[1] for r in rows])
        linked &= block[:, None] != block[None, :]
    if any(len(r[2]) > 1 for r in rows):
        groups = [set(r[2]) for r in rows]
        for i, j in zip(*np.nonzero(np.triu(linked)), strict=True):
            if min(groups[i] & groups[j]) != group:
                linked[i, j] = linked[j, i] = False
    links = linked.sum(1)
    tree, left = [], links > 0
    for root in range(n):
        if left[root]:
            part = np.zeros(n, bool)
            part[root] = front = True
            front = part.copy()
            while front.any():
                front = linked[front].any(0) & ~part
                part |= front
            left &= ~part
            tree += [(rows[i][0], rows[root][0]) for i in np.flatnonzero(part) if i != root]
    at = np.flatnonzero(links)
    return [rows[i][0] for i in at], links[at].tolist(), tree


def _verified(blocks: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n): rows with b null give n links to a, the others are links of trees. blocks come sorted by group, low, high."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close() -> pa.RecordBatch:
            row, links, tree = verify(held, *key, threshold)
            return pa.RecordBatch.from_arrays([pa.array(row + [x[0] for x in tree], pa.int64()), pa.array([None] * len(row) + [x[1] for x in tree], pa.int64()), pa.array(links + [0] * len(tree), pa.int64())], names=["a", "b", "n"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("group", "low", "high", "row", "block", "groups")]
            for group, low, high, row, block, groups, grams in zip(*columns, batch.column("grams"), strict=True):
                if (group, low, high) != key:
                    if len(held) > 1:
                        yield close()
                    key, held = (group, low, high), []
                held.append((row, block, groups, np.frombuffer(grams.as_buffer(), np.uint64)))
        if len(held) > 1:
            yield close()

    return blocks.mapInArrow(run, "a long, b long, n long")


def _near_star(placed: DataFrame, threshold: float) -> DataFrame:
    """(row, group, star, n, linked) of rows (row, group, grams, star, star_grams): shingles of each, and whether it is as similar to the star."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, sizes = [], []
            for mine, other in zip(batch.column("grams"), batch.column("star_grams"), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (mine, other))
                both = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(both >= threshold * (len(a) + len(b) - both) - 1e-9)
                sizes.append(len(a))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("row", "group", "star")] + [pa.array(sizes, pa.int64()), pa.array(linked, pa.bool_())], names=["row", "group", "star", "n", "linked"])

    return placed.select("row", "group", "star", "grams", "star_grams").mapInArrow(run, "row long, group long, star long, n long, linked boolean")


def _paired(placed: DataFrame) -> DataFrame:
    """placed (with block, n_blocks, n_open) once for each pair of blocks low <= high it is part of, low being below n_open."""
    other = F.sequence(F.lit(0), F.when(F.col("block") < F.col("n_open"), F.col("n_blocks")).otherwise(F.col("n_open")) - 1)
    return placed.withColumn("other", F.explode(other)).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other")


def _pairs_of_all(member: DataFrame, of_row: DataFrame, sets: DataFrame, n_blocks: DataFrame) -> DataFrame:
    """Rows with their sets, for each pair of blocks of their groups."""
    hot = materialize(n_blocks.where("n_blocks > 1"), "hot-groups")
    placed = hot_join(member.select("row", "group"), n_blocks, ["group"], hot, "row").withColumns({"block": F.pmod(F.xxhash64("row"), F.col("n_blocks")).cast("int"), "n_open": F.col("n_blocks")})
    # the plan is the same at every size: a small side is not broadcast only where the input is small
    return _paired(placed).join(of_row, "row").join(sets.hint("merge"), "row")


def _pairs_with_open(member: DataFrame, of_row: DataFrame, sets: DataFrame, n_blocks: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """As _pairs_of_all for groups of one block; of larger ones, pairs with rows that are not linked to the star; and the links to stars."""
    sets = materialize(sets, "sets")
    large = materialize(n_blocks.where("n_blocks > 1"), "hot-groups")
    inside = member.join(n_blocks.where("n_blocks = 1"), "group").select("row", "group")
    small = inside.withColumns({"block": F.lit(0), "low": F.lit(0), "high": F.lit(0)}).join(of_row, "row").join(sets.hint("merge"), "row")
    if large.isEmpty():
        return small, None
    rows = materialize(hot_join(member.select("row", "group"), large.select("group"), ["group"], large, "row"), "large-groups")
    stars = rows.groupBy("group").agg(F.min("row").alias("star")).join(sets.select(F.col("row").alias("star"), F.col("grams").alias("star_grams")), "star")
    of_large = flag_possible(sets, rows, "row").where("__maybe").drop("__maybe")
    held = materialize(_near_star(hot_join(rows.join(of_large.hint("merge"), "row"), stars, ["group"], large, "row"), threshold), "near-star")
    count = lambda which: F.greatest(F.ceil(F.count_if(which) / BLOCK), F.ceil(F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)) / BLOCK_GRAMS)).cast("int")
    sizes = materialize(held.groupBy("group").agg(count(~F.col("linked")).alias("n_open"), count(F.col("linked")).alias("n_linked")).where("n_open > 0").withColumn("n_blocks", F.col("n_open") + F.col("n_linked")), "open")
    placed = hot_join(held, sizes, ["group"], sizes, "row")
    block = F.when(F.col("linked"), F.col("n_open") + F.pmod(F.xxhash64("row"), F.greatest("n_linked", F.lit(1)))).otherwise(F.pmod(F.xxhash64("row"), F.col("n_open")))
    # sets are read again only for groups with rows that are not linked
    again = _paired(placed.withColumn("block", block.cast("int"))).join(of_row, "row").join(of_large.hint("merge"), "row")
    columns = ["row", "group", "block", "low", "high", "groups", "grams"]
    return small.select(*columns).unionAll(again.select(*columns)), held.where("linked and row <> star").select(F.col("row").alias("a"), F.col("star").alias("b"), F.lit(0).cast("long").alias("n"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, keys: bool = False, links: bool = True) -> DataFrame:
    """One row for each row of df: id, class_id, copy_id, n_copies, n_links, first.

    ``copy_id`` is the least id of the rows with the same text, ``n_copies``
    their number; ``n_links`` counts the *different* texts whose word shingles
    have a Jaccard similarity of at least ``threshold`` (null without ``links``,
    which spares large families the comparison of all their pairs); ``class_id``
    is the least id of the rows that copies and links connect. ``first`` marks one
    row of each class. Words are lower-cased runs of letters and digits; a text with
    fewer than ``words`` of them is one shingle. Null, empty and wordless texts
    equal no other and have no links. Null ids stay as rows and count as
    highest; repeated rows are copies of each other; an empty table gives an
    empty table; other columns of df are not read. ``keys`` adds the two hashes
    of the text that rows were compared by, ``ka`` and ``kb``.
    """
    docs = pick(df, id_col, text_col).withColumns({"ka": F.xxhash64("text"), "kb": F.xxhash64(F.lit(7), "text")})
    signed = _signatures(docs, *choose_bands(threshold, recall), words)
    copies = materialize(signed.groupBy("ka", "kb").agg(F.min_by("row", F.struct(F.col("id").isNull(), "id", "row")).alias("rep"), F.min("id").alias("copy_id"), F.count("*").alias("n_copies")), "copies")
    often = materialize(copies.where(F.col("n_copies") >= HOT_ROWS).select("ka"), "often")

    # rows that only repeat a text drop out; bands of rows that surely do not are not shuffled for that
    repeats = materialize(hot_join(signed.select("row", "ka", "kb"), copies.where("n_copies > 1").select("ka", "kb", "rep"), ["ka", "kb"], often, "row").where("row <> rep").select("row"), "repeats")
    flagged = flag_possible(signed.select("row", "n", "bands"), repeats, "row")
    firsts = flagged.where("not __maybe").drop("__maybe").unionAll(flagged.where("__maybe").drop("__maybe").join(repeats, "row", "left_anti"))
    banded = firsts.select("row", "n", F.explode("bands").alias("key"))
    buckets = materialize(banded.groupBy("key").agg(F.min("row").alias("centre"), F.count("*").alias("c")).where("c > 1"), "buckets")
    # nearly all band hashes stand once and stay where they are
    met = flag_possible(banded, buckets, "key").where("__maybe").drop("__maybe")
    member = materialize(hot_join(met, buckets.select("key", "centre"), ["key"], buckets.where(F.col("c") >= HOT_ROWS), "row").select("row", "n", "centre").distinct(), "members")
    passed = member.groupBy(F.col("row").alias("centre")).agg(F.min("centre").alias("group"))
    large = materialize(member.groupBy("centre").agg(F.count("*").alias("c")).where(F.col("c") >= HOT_ROWS), "hot-centres")
    member = materialize(hot_join(member, passed, ["centre"], large, "row").select("row", "n", "group").distinct(), "groups")

    n_blocks = member.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int").alias("n_blocks"))
    of_row = member.groupBy("row").agg(F.collect_set("group").alias("groups"))  # as many as there are bands at most
    wanted = of_row.join(copies.select(F.col("rep").alias("row"), "ka", "kb", F.col("copy_id").alias("id")), "row")
    wanted = materialize(wanted, "wanted")
    likely = flag_possible(docs, wanted, "ka").where("__maybe").drop("__maybe")  # most texts have no candidate and are not shuffled
    same_id = likely["id"].eqNullSafe(wanted["id"])
    texts = likely.join(wanted.hint("merge"), (likely["ka"] == wanted["ka"]) & (likely["kb"] == wanted["kb"]) & same_id).select("row", "text")
    sets = _shingle_sets(texts, words)
    stars = None
    if links:
        blocks = _pairs_of_all(member, of_row, sets, n_blocks)
    else:
        blocks, stars = _pairs_with_open(member, of_row, sets, materialize(n_blocks, "blocks"), threshold)
    found = _verified(blocks.repartition("group", "low", "high").sortWithinPartitions("group", "low", "high"), threshold)
    found = materialize(found if stars is None else found.unionAll(stars), "links")

    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n_links"))
    parts = components(found.where("b is not null")).select(F.col("node").alias("rep"), "label")
    classes = copies.join(parts, "rep", "left").join(counts, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    least = classes.groupBy("label").agg(F.min("copy_id").alias("class_id"), F.min_by("rep", F.struct(F.col("copy_id").isNull(), "copy_id", "rep")).alias("first_rep"), F.count("*").alias("c"))
    least, classes = materialize(least, "classes"), materialize(classes, "labelled")
    classes = hot_join(classes, least.drop("c"), ["label"], least.where(F.col("c") >= HOT_ROWS), "rep").select("ka", "kb", "class_id", "copy_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("first_rep") == F.col("rep")).alias("__leads"), F.col("rep").alias("__rep"))
    n_links = F.col("n_links") if links else F.lit(None).cast("long")
    joined = hot_join(signed.select("row", "id", "ka", "kb"), classes, ["ka", "kb"], often, "row")
    return joined.select("id", "class_id", "copy_id", "n_copies", n_links.alias("n_links"), (F.col("__leads") & (F.col("row") == F.col("__rep"))).alias("first"), *(["ka", "kb"] if keys else []))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """df with one row of each class of near duplicates, all columns as they are; see near_duplicates for the classes and which row is first."""
    found = near_duplicates(df, id_col, text_col, words, threshold, recall, keys=True, links=False)
    by_key = materialize(found.groupBy("id", "ka", "kb").agg(F.max("first").alias("stays"), F.count("*").alias("n")).where("n > 1 or not stays"), "dropped")
    keyed = df.withColumns({"__ka": F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), "__kb": F.xxhash64(F.lit(7), F.coalesce(F.col(text_col).cast("string"), F.lit("")))})

    def same(keys: DataFrame):  # of keyed as it is when called
        return (keyed["__ka"] == keys["ka"]) & (keyed["__kb"] == keys["kb"]) & keyed[id_col].eqNullSafe(keys["id"])

    # rows whose hash is not among the dropped ones stay where they are; only the others are shuffled
    flagged = flag_possible(keyed, by_key.withColumnRenamed("ka", "__ka"), "__ka")
    kept, keyed = flagged.where("not __maybe").drop("__maybe"), flagged.where("__maybe").drop("__maybe")
    repeated = by_key.where("stays")
    kept = kept.unionAll(keyed.join(by_key, same(by_key), "left_anti"))
    if not repeated.isEmpty():  # rows that repeat id and text: one of them stays
        kept = kept.unionAll(keyed.join(repeated, same(repeated), "left_semi").dropDuplicates([id_col, "__ka", "__kb"]))
    return kept.select(*df.columns)
