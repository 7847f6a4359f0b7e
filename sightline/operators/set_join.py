"""Pairs of sets that are alike, by exact filters: a common element never pairs all sets that hold it.

The elements of each set are put in the order of their frequency, rarest
first. Two sets that share enough must share one of their rarest elements (the
prefix), so only these become keys of the join; the sizes of the two and the place
of the common element then bound what they can share at all, and what is left is
verified on the whole sets. A key that very many prefixes hold is dealt out
over several tasks, as many as its own frequency asks for.

Sets of few elements meet at what they have to share instead: each goes with
its subsets of the number asked for, so that only pairs that count come up at all.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import materialize
from .block_pairs import common_elements, count_common

#: Sets of a key that meet in one task.
KEY_ROWS = 512
#: Elements that a large set takes along with its keys.
FEW = 8
#: Elements up to which a whole set goes with each of its keys.
SMALL_SET = 64
#: Elements up to which a set goes with its subsets; it has a thousand at most.
SUBSETS_OF = 10


def by_frequency(own: DataFrame) -> DataFrame:
    """(id, n, items): size of each set and its elements that stand in other sets too, rarest first, from distinct rows (id, item) or (id, n, item).

    Elements of one set only are the rarest of all and can be no key; they are counted, but not carried.
    An element is shuffled once: its sets are counted where they meet.
    """
    df = F.count("*").over(W.partitionBy("item"))
    if "n" in own.columns:
        return own.withColumn("df", df).where("df > 1").groupBy("id").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "item"))).alias("items"))
    own = materialize(own, "members")  # read twice
    common = own.withColumn("df", df).where("df > 1").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("items"))
    return own.groupBy("id").agg(F.count("*").cast("int").alias("n")).join(common, "id")


def members(df: DataFrame, id_col: str, hashes: Column) -> DataFrame:
    """(id, n, item) of a column of distinct hashes."""
    return df.select(F.col(id_col).alias("id"), hashes.alias("h")).select("id", F.size("h").alias("n"), F.explode("h").alias("item"))


def alike(sets: DataFrame, prefix: Callable[[Column], Column], least: Callable[[Column, Column], Column], ratio: float | None = None, small: bool = False, above: int = 0) -> DataFrame:
    """(a, b, shared, na, nb) of pairs a < b of sets that share at least ``least`` (of both sizes) elements.

    sets is what by_frequency gives, written before; ``prefix`` tells how many of a set's rarest
    elements are keys. With ``ratio`` the smaller of two sets has at least that share
    of the larger one's size, and sets of sizes too far apart do not meet. Sets that are ``small``
    go with their keys, and a pair is told where its rarest common element meets. Large ones take their FEW rarest
    elements along: sets that share one of these are told there only, so that near copies do not come up at each of their keys;
    the whole sets are fetched for the pairs that are left. Pairs are told whose larger set has more than ``above`` elements.
    """
    own = F.col("n") - F.size("items")  # elements of this set only come first
    keys = F.posexplode(F.slice("items", F.lit(1), F.greatest(prefix(F.col("n")) - own, F.lit(0)))).alias("at", "x")
    whole = F.transform("items" if small else F.slice("items", 1, FEW), lambda i: i["item"])
    rows = sets.select("id", "n", own.alias("own"), whole.alias("of"), keys).select("id", "n", "of", (F.col("own") + F.col("at") + 1).alias("at"), F.col("x.item").alias("item"), F.ceil(F.col("x.df") / KEY_ROWS).cast("int").alias("parts"))
    # classes of sizes a little wider than the ratio, so that rounding never puts a pair two classes apart
    size = F.floor(F.log(F.col("n").cast("double")) / (1e-9 - math.log(ratio) * (1 + 1e-6))).cast("long") if ratio else F.lit(0).cast("long")
    # the smaller set goes to its own class of sizes and to the next one, the larger to its own
    low = rows.select(F.col("id").alias("x"), F.col("n").alias("nx"), F.col("of").alias("of_x"), F.col("at").alias("ax"), "item", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.explode(F.array(size, size + 1) if ratio else F.array(size)).alias("size"))
    high = rows.select(F.col("id").alias("y"), F.col("n").alias("ny"), F.col("of").alias("of_y"), F.col("at").alias("ay"), "item", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), size.alias("size"))
    if above:
        high = high.where(F.col("ny") > above)
        low = low.where(F.lit(not sets.where(F.col("n") > above).isEmpty()))  # nothing is dealt out for no larger set
    both = low.join(high.hint("merge"), ["item", "part", "size"]).where((F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y"))))
    room = F.least(F.col("nx") - F.col("ax"), F.col("ny") - F.col("ay")) + 1
    likely = both.where(room >= least(F.col("nx"), F.col("ny")))
    likely = likely.withColumn("common", F.array_intersect("of_x", "of_y")).where(F.coalesce(F.get("common", F.lit(0)), F.col("item")) == F.col("item"))
    if small:
        found = likely.where(F.size("common") >= least(F.col("nx"), F.col("ny")))
        found = found.select("x", "y", "nx", "ny", F.size("common").alias("shared"))
    else:
        of = lambda name: sets.select(F.col("id").alias(name), F.col("n").alias(f"n{name}"), F.transform("items", lambda i: i["item"]).alias(f"of_{name}"))
        shared = F.size(F.array_intersect("of_x", "of_y"))
        found = likely.select("x", "y").distinct().join(of("x"), "x").join(of("y"), "y").select("x", "y", "nx", "ny", shared.alias("shared")).where(F.col("shared") >= least(F.col("nx"), F.col("ny")))
    swap = F.col("x") > F.col("y")
    pick = lambda p, q: F.when(swap, F.col(q)).otherwise(F.col(p))
    return found.select(pick("x", "y").alias("a"), pick("y", "x").alias("b"), F.col("shared").cast("long").alias("shared"), pick("nx", "ny").alias("na"), pick("ny", "nx").alias("nb"))


def alike_by_overlap(own: DataFrame, overlap: int) -> DataFrame:
    """(a, b, shared, similarity) of sets, of any size, that share ``overlap`` elements or more, with their Jaccard similarity; own has (id, n, item)."""
    sets = sharing(own, overlap).select("id", F.array("n").alias("sizes"), F.transform("items", lambda i: F.shiftleft(i["item"], 2)).alias("items"))
    found = count_common(sets, 1, lambda counts, na, nb: counts[0] >= overlap)
    each = found.select("a", "b", F.col("shared")[0].cast("long").alias("shared"), F.col("na")[0].alias("na"), F.col("nb")[0].alias("nb"))
    return each.select("a", "b", "shared", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 4).alias("similarity"))


def alike_by_share(own: DataFrame, threshold: float) -> DataFrame:
    """(a, b, shared, similarity) of sets whose Jaccard similarity is ``threshold`` (over 0) or more, from distinct rows (id, item)."""
    sets = materialize(by_frequency(own), "sets")
    found = alike(
        sets,
        lambda n: n - F.ceil(n * threshold - 1e-9).cast("int") + 1,
        lambda a, b: F.ceil((a + b) * (threshold / (1 + threshold)) - 1e-9).cast("int"),
        threshold,
    )
    return found.select("a", "b", "shared", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 4).alias("similarity"))


def alike_by_count(own: DataFrame, overlap: int) -> DataFrame:
    """(a, b, shared) of sets that share ``overlap`` elements or more, from distinct rows (id, item).

    Sets of up to SUBSETS_OF elements meet by common subsets, so the work grows with the pairs that are found.
    """
    sets = sharing(own, overlap)
    return _by_subsets(sets, overlap).unionAll(_with_larger(sets, overlap))


def sharing(own: DataFrame, overlap: int) -> DataFrame:
    """Sets, as by_frequency gives them, of at least ``overlap`` elements that stand in others too; written."""
    return materialize(by_frequency(own).where(F.size("items") >= overlap), "sets")


def _with_larger(sets: DataFrame, overlap: int) -> DataFrame:
    """(a, b, shared) of the pairs that hold a set of over SUBSETS_OF elements.

    A set of over SMALL_SET elements would go with nearly all of them as keys, the square of its size;
    what it shares with the others is counted from its single elements instead.
    """
    small = alike(sets.where(F.col("n") <= SMALL_SET), lambda n: n - overlap + 1, lambda a, b: F.lit(overlap), small=True, above=SUBSETS_OF).select("a", "b", "shared")
    return small.unionAll(_counted(sets, overlap))


def _subsets(sets: DataFrame, least: int, most: int) -> DataFrame:
    """(id, size, sub, key) of the subsets of ``least`` to ``most`` elements of the sets of up to SUBSETS_OF; key is a hash of the subset."""
    picks = F.filter(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.size("of")) - 1), lambda m: F.bit_count(m).between(least, most))
    each = sets.where(F.col("n") <= SUBSETS_OF).select("id", F.transform("items", lambda i: i["item"]).alias("of")).select("id", "of", F.explode(picks).alias("m"))
    sub = F.filter("of", lambda x, i: F.getbit("m", i) == 1)
    return each.select("id", F.bit_count("m").alias("size"), sub.alias("sub")).withColumn("key", F.xxhash64("sub"))


def _by_subsets(sets: DataFrame, overlap: int) -> DataFrame:
    """(a, b, shared) of the pairs of sets of up to SUBSETS_OF elements. A pair is told at its rarest common subset, which also tells hashes that are equal by chance."""
    df = F.count("*").over(W.partitionBy("key"))
    common = _subsets(sets, overlap, overlap).drop("size").withColumn("df", df).where("df > 1")
    rows = materialize(common.join(sets.select("id", F.transform("items", lambda i: i["item"]).alias("of")), "id").withColumn("parts", F.ceil(F.col("df") / KEY_ROWS).cast("int")), "subsets")  # read twice
    low = rows.select(F.col("id").alias("a"), F.col("of").alias("of_a"), "sub", "key", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    high = rows.select(F.col("id").alias("b"), F.col("of").alias("of_b"), "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    both = low.join(high.hint("merge"), ["key", "part"]).where("a < b").withColumn("common", F.array_intersect("of_a", "of_b"))
    return both.where(F.slice("common", 1, overlap) == F.col("sub")).select("a", "b", F.size("common").cast("long").alias("shared"))


def linked(own: DataFrame, overlap: int) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) that connect just the sets that chains of pairs sharing ``overlap`` elements connect, and (id, degree), the number of each set's pairs, of sets in pairs.

    Both come without the pairs of sets of up to SUBSETS_OF elements. All sets
    with one subset are pairs, so an edge of each to the least of them connects
    as much. Of the sets that share k elements with one, its subsets of j
    elements count each as often as k has subsets of j; of these sums over j
    (inclusion and exclusion) is left the number of sets with ``overlap`` or more.
    """
    sets = sharing(own, overlap)
    same = W.partitionBy("key")
    counted = _subsets(sets, overlap, SUBSETS_OF).select("id", "size", F.count("*").over(same).alias("df"), F.min("id").over(same).alias("least")).where("df > 1")
    counted = materialize(counted, "subsets")  # read for the edges and for the degrees
    times = F.element_at(F.array(*[F.lit((-1) ** (j - overlap) * math.comb(j - 1, overlap - 1)).cast("long") for j in range(overlap, max(overlap, SUBSETS_OF) + 1)]), F.col("size") - overlap + 1)
    rest = materialize(_with_larger(sets, overlap).select("a", "b"), "pairs")
    few = counted.groupBy("id").agg(F.sum(times * (F.col("df") - 1)).alias("degree"))
    more = rest.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    stars = counted.where((F.col("size") == overlap) & (F.col("id") != F.col("least"))).select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    return stars.unionAll(rest), few.unionAll(more).groupBy("id").agg(F.sum("degree").alias("degree"))


def _counted(sets: DataFrame, overlap: int) -> DataFrame:
    """(a, b, shared) of the pairs that hold a set of over SMALL_SET elements; an element's sets are dealt out by its frequency."""
    is_large = F.col("n") > SMALL_SET
    each = sets.select("id", is_large.alias("large"), F.explode("items").alias("i")).select("id", "large", F.col("i.item").alias("item"), F.ceil(F.col("i.df") / KEY_ROWS).cast("int").alias("parts"))
    large = each.where("large").select(F.col("id").alias("x"), "item", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    others = each.select(F.col("id").alias("y"), "large", "item", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    both = large.join(others.hint("merge"), ["item", "part"]).where((~F.col("large") & (F.col("x") != F.col("y"))) | (F.col("x") < F.col("y")))
    found = both.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("shared"))
    return found.where(F.col("shared") >= overlap)


def weighted_pairs(df: DataFrame, id_col: str, weights: dict[str, float], threshold: float) -> DataFrame:
    """(a, b, score) of rows whose weighted mean of the Jaccard similarities of their list columns is ``threshold`` (over 0) or more.

    Common elements are counted by hashes, for all pairs of rows. Weights add up to one; there are up to four columns.
    """
    hashes = df.select(id_col, *[F.coalesce(F.array_distinct(F.transform(c, lambda x: F.xxhash64(x))), F.array().cast("array<bigint>")).alias(c) for c in weights])
    share = list(weights.values())

    def keep(counts, na, nb):
        mean = np.zeros(counts[0].shape)
        for k, w in enumerate(share):
            mean += w * counts[k] / np.maximum(na[..., k] + nb[..., k] - counts[k], 1)
        return mean >= threshold - 1e-4  # scores have four digits and are made below

    found = count_common(common_elements(hashes, id_col, list(weights)), len(share), keep)
    each = lambda k: F.coalesce(F.try_divide(F.col("shared")[k], F.col("na")[k] + F.col("nb")[k] - F.col("shared")[k]), F.lit(0.0))
    score = sum((w * each(k) for k, w in enumerate(share)), F.lit(0.0))
    return found.select("a", "b", F.round(score, 4).alias("score")).where(F.col("score") >= threshold)
