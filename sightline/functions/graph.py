"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize


def _roots(parents: DataFrame) -> DataFrame:
    """(node, label): the end of each node's path of parents (node, label), by pointer jumping; ends are their own parents or no node."""
    state = parents
    while True:
        far = state.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = materialize(state.join(far, "label", "left").select("node", F.coalesce("far", "label").alias("label"), F.coalesce(F.col("far") != F.col("label"), F.lit(False)).alias("moved")), "labels")
        state = step.select("node", "label")
        if step.where("moved").isEmpty():
            return state


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of edges (a, b); the label is the least node that can be reached.

    Each round hangs every node on its least neighbour that is less than itself,
    follows these to their ends, and goes on with the edges between different ends only, each once. So all edges are
    read in the first round, and few are left for the next. No edges give no rows.
    """
    left = edges.where("a <> b").select("a", "b")
    rounds = []
    while True:
        ways = left.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near")))).alias("w")).select("w.*")
        parents = materialize(ways.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("label")), "parents")
        rounds.append(_roots(parents))
        end = lambda name: rounds[-1].select(F.col("node").alias(name), F.col("label").alias(f"{name}_end"))
        ends = left.join(end("a"), "a").join(end("b"), "b").where("a_end <> b_end")
        left = materialize(ends.select(F.least("a_end", "b_end").alias("a"), F.greatest("a_end", "b_end").alias("b")).distinct(), "edges")
        if left.isEmpty():
            break
    # the ends of a round are nodes of the next, as far as they have edges left
    found = rounds.pop()
    while rounds:
        later = found.select(F.col("node").alias("label"), F.col("label").alias("least"))
        found = rounds.pop().join(later, "label", "left").select("node", F.coalesce("least", "label").alias("label"))
    return found
