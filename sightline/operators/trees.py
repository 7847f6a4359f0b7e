"""JSON trees of any depth, level by level as variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize

#: Levels after which a tree is taken for broken.
MOST_LEVELS = 64


def _below(frontier: DataFrame, keep: list[str], node: str = "node") -> DataFrame:
    """(keep, name, pos, node): the children of the objects and arrays of a frontier; a child's name is null in an array."""
    spark = frontier.sparkSession
    children = spark.tvf.variant_explode(F.col(node).outer()).toDF("pos", "name", "child")
    return frontier.lateralJoin(children).select(*keep, "name", "pos", F.col("child").alias("node"))


def node_types(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, type): one row for each node of each tree, as ``key.list[].key``; a text that is not JSON has one row of type 'malformed', a null one none.

    The frontier of objects and arrays is opened level by level until nothing is nested any more.
    """
    parsed = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.try_parse_json(text).alias("node"), F.lit("$").alias("path"))
    parsed = materialize(parsed, "trees")
    out = parsed.where("node IS NULL").select("key", "path", F.lit("malformed").alias("type"))
    frontier = parsed.where("node IS NOT NULL")
    kind = F.regexp_extract(F.schema_of_variant("node"), r"^\w+", 0)
    for _ in range(MOST_LEVELS):
        told = materialize(frontier.withColumn("type", kind), "level")
        out = out.unionAll(told.select("key", "path", "type"))
        nested = told.where("type IN ('OBJECT', 'ARRAY')")
        if nested.isEmpty():
            return out
        below = _below(nested, ["key", "path"])
        frontier = below.select("key", "node", F.when(F.col("name").isNull(), F.concat("path", F.lit("[]"))).otherwise(F.concat_ws(".", "path", "name")).alias("path"))
    raise ValueError(f"a tree has more than {MOST_LEVELS} levels")


def count_types(trees: DataFrame, key: str, tree: str) -> DataFrame:
    """(key, type, n) over recursive validator trees (JSON): every type of every node, nested ones too.

    A node's types are its ``types[].value``, else its ``typeGroup``; its children
    the objects in ``nodeProperties[].value[]``. A text that is not JSON counts as one
    'malformed'; a null one has no rows.
    """
    parsed = materialize(trees.where(F.col(tree).isNotNull()).select(key, F.try_parse_json(tree).alias("node")), "trees")
    found = [parsed.where("node IS NULL").select(key, F.lit("malformed").alias("type"))]
    # a tree is a list of nodes, or one
    is_list = F.schema_of_variant("node").startswith("ARRAY")
    frontier = parsed.where(~is_list).select(key, "node").unionAll(_below(parsed.where(is_list), [key]).select(key, "node"))
    text = lambda v, p: F.try_variant_get(v, p, "string")
    part = lambda p: F.try_variant_get("node", p, "variant")
    for _ in range(MOST_LEVELS):
        nodes = materialize(frontier.where(F.schema_of_variant("node").startswith("OBJECT")), "nodes")
        if nodes.isEmpty():
            every = found[0]
            for more in found[1:]:
                every = every.unionAll(more)
            return every.groupBy(key, "type").agg(F.count("*").alias("n"))
        types = _below(nodes.select(key, text("node", "$.typeGroup").alias("grp"), part("$.types").alias("node")).where("node IS NOT NULL"), [key, "grp"])
        found.append(types.where("name IS NULL AND node IS NOT NULL").select(key, F.coalesce(F.nullif(text("node", "$.value"), F.lit("")), "grp").alias("type")).where("type IS NOT NULL AND type <> ''"))
        properties = _below(nodes.select(key, part("$.nodeProperties").alias("node")).where("node IS NOT NULL"), [key]).select(key, F.try_variant_get("node", "$.value", "variant").alias("node")).where("node IS NOT NULL")
        frontier = _below(properties, [key]).select(key, "node").where("node IS NOT NULL")
    raise ValueError(f"a tree has more than {MOST_LEVELS} levels")
