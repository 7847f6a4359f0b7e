"""Difference of two snapshots of a keyed table, with rows that only changed their key.

Each row becomes its key and the SHA-256 of each compared column, once for each
snapshot; long columns do not move after that. Each snapshot has a Merkle tree:
rows fall into leaves by a hash of their key, a leaf's digest is the exclusive or
of short digests of (key, row) and their number, and a node's digest is made
of its children's in the same way. The trees are compared from the root down, and only
children of differing nodes are looked at. Leaves of equal digests are verified
exactly, on the keys and SHA-256 of all their rows, which are then emitted as the same.
The rows of all other leaves are compared one by one: equal keys pair, then what
is left pairs by content.

Nothing is gathered: nodes, rows and pairs are joined by shuffle, and rows of a
repeated key or content are numbered by sorted ranges, so that a key or content
that holds most rows is dealt out over tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize

#: Mean rows of a leaf, and bits of a child's place under its node.
LEAF_ROWS, FANOUT_BITS = 2, 4


def _row_digests(df: DataFrame, key: str, columns: list[str], side: int, leaf: Column) -> DataFrame:
    """A narrow row for each row of df: key, a digest of each compared column (null stays null), leaf, digest of (key, row)."""
    digests = [F.sha2(df[c].cast("string"), 256).alias(f"d{i}") for i, c in enumerate(columns)]
    line = F.concat_ws("\n", *[F.coalesce(df[c].cast("string"), F.lit("~")) for c in columns])
    rows = df.select(F.lit(side).alias("side"), df[key].alias("key"), leaf.alias("leaf"), *digests, (F.sha2(line, 256) if side else F.lit(None).cast("string")).alias("row_sha256"))
    parts = [F.col(x) for x in ("key", *[f"d{i}" for i in range(len(columns))])]
    known = [p.isNull() for p in parts]  # a hash passes over nulls
    return rows.withColumns({"h": F.xxhash64(*parts, *known), "g": F.xxhash64(F.lit(1), *parts, *known)})


def tree_levels(rows: DataFrame, levels: int) -> list[DataFrame]:
    """Digests (side, node, h, g, n) of the nodes of each level of both trees, the root's level first."""
    made = [materialize(rows.groupBy("side", F.col("leaf").alias("node")).agg(F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g"), F.count("*").alias("n")), "leaves")]
    for _ in range(levels):
        below = made[0]
        up = below.select("side", F.shiftright("node", FANOUT_BITS).alias("up"), "n", F.xxhash64("node", "h", "g", "n").alias("h"), F.xxhash64(F.lit(1), "node", "h", "g", "n").alias("g"))
        made.insert(0, materialize(up.groupBy("side", F.col("up").alias("node")).agg(F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g"), F.sum("n").alias("n")), "nodes"))
    return made


def differing(levels: list[DataFrame]) -> DataFrame:
    """(node): the leaves whose digests differ, found from the root down."""
    found = None
    for level in levels:
        seen = level
        if found is not None:
            seen = level.withColumn("up", F.shiftright("node", FANOUT_BITS)).join(found.select(F.col("node").alias("up")).hint("merge"), "up", "left_semi")
        of = lambda side: F.max(F.when(F.col("side") == side, F.struct("h", "g", "n")))
        # cut here: each level's plan would else hold those of all levels above
        found = materialize(seen.groupBy("node").agg(of(0).alias("a"), of(1).alias("b")).where(~F.col("a").eqNullSafe(F.col("b"))).select("node"), "differing")
    return found


def unequal_leaves(rows: DataFrame, equal: DataFrame, digests: list[str]) -> DataFrame:
    """(node): those of the leaves ``equal`` whose rows, with their repetitions, are not the same in both snapshots."""
    own = rows.join(equal.hint("merge"), rows["leaf"] == equal["node"], "left_semi")
    return own.groupBy("leaf", "key", *digests).agg(F.sum(F.lit(1) - 2 * F.col("side")).alias("excess")).where("excess <> 0").select(F.col("leaf").alias("node")).distinct()


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """rows with a column ``name``: the place, from 1, of each row within its group, in the order (nulls first).

    The rows are dealt out in sorted ranges, written once with the places
    within their range; a range's places then go up by what the ranges before
    it hold of the same group. Only groups that cross ranges have such a part, at
    most one a range, so these parts are broadcast. The order must be total
    for a group to be cut: a further column of unique values comes last. Ranges are
    cut by a hash of the group, as the driver gets a sample of what they are cut by.
    """
    nulls = [F.col(c).isNull() for c in group]
    low = lambda names: [F.col(c).asc_nulls_first() for c in names]
    dealt = rows.withColumn("__hash", F.xxhash64(*group, *nulls)).repartitionByRange("__hash", *low(order)).sortWithinPartitions("__hash", *low(group), *low(order))
    dealt = dealt.drop("__hash").withColumns({"__range": F.spark_partition_id(), "__place": F.lit(0).cast("long")})
    place, at = dealt.columns.index("__place"), [dealt.columns.index(c) for c in group]

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            change = np.zeros(batch.num_rows, bool)
            for column in (batch.column(i) for i in at):
                codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                change[1:] |= codes[1:] != codes[:-1]
            head = [batch.column(i)[0].as_py() for i in at]
            change[0] = head != last
            starts = np.flatnonzero(change)
            number = np.arange(batch.num_rows)
            before = np.zeros(batch.num_rows, np.int64)
            before[starts] = np.diff(np.append(0, starts))
            number = number - np.cumsum(before) + 1
            if not change[0]:
                number[: starts[0] if len(starts) else None] += held
            last, held = [batch.column(i)[batch.num_rows - 1].as_py() for i in at], int(number[-1])
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()) if i == place else batch.column(i) for i in range(batch.num_columns)], schema=batch.schema)

    placed = materialize(dealt.mapInArrow(count, dealt.schema), "ranges")
    ends = placed.groupBy(*group, "__range").agg(F.count("*").alias("__c"))
    earlier = W.partitionBy(*group).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # as many rows as ranges that the group reaches into
    moved = ends.withColumn("__before", F.sum("__c").over(earlier)).where("__before > 0").select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)], F.col("__range").alias("__r"), "__before")
    same = F.col("__range") == F.col("__r")
    for i, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"__g{i}"))
    joined = placed.join(F.broadcast(moved), same, "left")
    return joined.select(*rows.columns, (F.col("__place") + F.coalesce(F.col("__before"), F.lit(0))).alias(name))


def _slots(rows: DataFrame, digests: list[str]) -> DataFrame:
    """rows with ``exact`` and ``slot``: rows of one key pair by these, equal rows first, then the others in the order of their digests."""
    repeated = materialize(rows.groupBy("key", "side").agg(F.count("*").alias("n")).where("n > 1").select("key").distinct(), "repeated")
    plain = rows.withColumns({"exact": F.lit(None).cast("string"), "slot": F.lit(1).cast("long")})
    if repeated.isEmpty():
        return plain
    same = rows["key"].eqNullSafe(repeated["key"])
    many = numbered(rows.join(repeated.hint("merge"), same, "left_semi"), ["side", "key", *digests], ["rid"], "copy")
    content = F.sha2(F.to_json(F.struct(*digests)), 256)
    least = many.groupBy("key", content.alias("content")).agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b")).select(F.col("key").alias("k"), "content", F.least("a", "b").alias("both"))
    keyed = many.withColumn("content", content)
    joined = keyed.join(least.hint("merge"), (keyed["key"].eqNullSafe(least["k"])) & (keyed["content"] == least["content"]), "left").select(*many.columns, keyed["content"].alias("content"), F.coalesce("both", F.lit(0)).alias("both"))
    joined = materialize(joined, "copies")
    exact = joined.where("copy <= both").select(*rows.columns, F.col("content").alias("exact"), F.col("copy").alias("slot"))
    rest = numbered(joined.where("copy > both").select(*rows.columns), ["side", "key"], [*digests, "rid"], "slot")
    return plain.join(repeated.hint("merge"), same, "left_anti").unionByName(exact).unionByName(rest.withColumn("exact", F.lit(None).cast("string")))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str], leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """One row for each pair or unpaired row: key, old_key, op, changed, row_sha256.

    ``op`` is same, update (equal keys, other content), rekey (content as
    before under another key), insert or delete; ``changed`` names the columns of
    a pair that differ. Nulls equal nulls only, in keys as in columns. Among rows of
    one key equal rows pair first, then the i-th with the i-th in the order of their
    digests; among rows of one content the i-th smallest keys pair, null keys
    first. Columns are compared as strings; other columns of either snapshot are
    not read. An empty snapshot gives inserts or deletes only, two empty ones an
    empty table. ``row_sha256`` is of the later row's columns, one a line, null as ``~``.
    """
    leaves = max(1, -(-max(df.count() for df in (old, new)) // leaf_rows))
    levels = -(-(leaves - 1).bit_length() // FANOUT_BITS)
    leaf = lambda df: F.pmod(F.xxhash64(df[key], df[key].isNull()), F.lit(leaves))
    digests = [f"d{i}" for i in range(len(columns))]
    sides = [_row_digests(df, key, columns, side, leaf(df)) for side, df in enumerate((old, new))]
    rows = materialize(sides[0].unionAll(sides[1]).withColumn("rid", F.monotonically_increasing_id()), "digests")

    tree = tree_levels(rows, levels)
    apart = differing(tree)
    alike = materialize(tree[-1].where("side = 1").select("node").join(apart.hint("merge"), "node", "left_anti"), "alike")
    verified = materialize(alike.join(unequal_leaves(rows, alike, digests).hint("merge"), "node", "left_anti"), "verified").hint("merge")

    of_leaf = rows["leaf"] == verified["node"]
    kept = rows.where("side = 1").join(verified, of_leaf, "left_semi").select("key", F.col("key").alias("old_key"), F.lit("same").alias("op"), F.lit("").alias("changed"), "row_sha256")

    rest = materialize(_slots(rows.join(verified, of_leaf, "left_anti").drop("h", "g", "leaf"), digests), "rest")
    a = rest.where("side = 0").select(*[F.col(c).alias(f"old_{c}") for c in ("key", "exact", "slot", "rid", *digests)])
    b = rest.where("side = 1").drop("side")
    paired = a.join(b.hint("merge"), a["old_key"].eqNullSafe(b["key"]) & a["old_exact"].eqNullSafe(b["exact"]) & (a["old_slot"] == b["slot"]), "full")
    paired = materialize(paired, "paired")
    changed = F.array_join(F.filter(F.array(*[F.when(~F.col(d).eqNullSafe(F.col(f"old_{d}")), F.lit(c)) for d, c in zip(digests, columns, strict=True)]), lambda x: x.isNotNull()), ",")
    both = paired.where("rid IS NOT NULL AND old_rid IS NOT NULL").withColumn("changed", changed)
    by_key = both.select("key", "old_key", F.when(F.col("changed") == "", "same").otherwise("update").alias("op"), "changed", "row_sha256")

    gone = paired.where("rid IS NULL").select(F.lit(0).alias("side"), F.col("old_key").alias("key"), *[F.col(f"old_{d}").alias(d) for d in digests], F.lit(None).cast("string").alias("row_sha256"), F.col("old_rid").alias("rid"))
    come = paired.where("old_rid IS NULL").select(F.lit(1).alias("side"), "key", *digests, "row_sha256", "rid")
    placed = numbered(gone.unionByName(come), ["side", *digests], ["key", "rid"], "place")
    x = placed.where("side = 0").select(F.col("key").alias("old_key"), F.col("rid").alias("old_rid"), F.col("place").alias("old_place"), *[F.col(d).alias(f"old_{d}") for d in digests])
    y = placed.where("side = 1").select("key", "rid", "place", "row_sha256", *digests)
    same = x["old_place"] == y["place"]
    for d in digests:
        same &= x[f"old_{d}"].eqNullSafe(y[d])
    moved = x.join(y.hint("merge"), same, "full")
    op = F.when(F.col("rid").isNull(), "delete").when(F.col("old_rid").isNull(), "insert").otherwise("rekey")
    by_content = moved.select(F.when(F.col("rid").isNull(), F.col("old_key")).otherwise(F.col("key")).alias("key"), "old_key", op.alias("op"), F.lit("").alias("changed"), "row_sha256")
    return kept.unionByName(by_key).unionByName(by_content)
