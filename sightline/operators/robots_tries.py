"""Robots rules resolved for many paths: the rules of a group become a trie, and the paths of its host pass through it.

Hosts with very many paths are dealt out over several tasks, each of which has
the host's rules: a robots file is small, its host's paths are not.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize

#: Paths of a host that meet its rules in one task.
HOST_PATHS = 50_000


class RuleTrie:
    """Patterns by character; ``*`` is a node that any characters stay at, a closing ``$`` asks for the end of the path."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, pattern: str, allow: bool) -> None:
        if not pattern:
            return  # an empty pattern never matches
        body, ends = (pattern[:-1], "$") if pattern.endswith("$") else (pattern, "")
        node = self.root
        for c in body:
            node = node.setdefault(c, {})
        rank = (len(pattern), allow)
        node["end" + ends] = max(node.get("end" + ends, rank), rank)

    def best(self, path: str) -> tuple[int, bool] | None:
        """(length, whether it allows) of the longest pattern that the path matches; of equals one that allows."""

        def entered(nodes: list[dict]) -> list[dict]:
            for node in nodes:  # a star may stand for nothing
                if "*" in node and not any(node["*"] is x for x in nodes):
                    nodes.append(node["*"])
            return nodes

        stars = {id(x) for x in self._stars(self.root)}
        nodes, found = entered([self.root]), None
        for c in [*path, None]:
            for node in nodes:
                for mark in ("end",) if c is not None else ("end", "end$"):
                    if mark in node:
                        found = max(found or node[mark], node[mark])
            if c is None:
                break
            after = [node[c] for node in nodes if c != "*" and c in node] + [node for node in nodes if id(node) in stars]
            nodes = entered(after)
            if not nodes:
                break
        return found

    def _stars(self, node: dict) -> Iterator[dict]:
        todo = [node]
        while todo:
            at = todo.pop()
            for c, below in at.items():
                if len(c) == 1:
                    todo.append(below)
                    if c == "*":
                        yield below


def resolve_paths(rules: DataFrame, paths: DataFrame, host: str, path: str) -> DataFrame:
    """paths with (grp, allowed) for each group of its host's rules (host, grp, field, pattern), by the longest matching pattern.

    Without a match a path is allowed; a host without rules has no rows. Null paths are empty ones.
    """
    sizes = paths.groupBy(host).agg(F.ceil(F.count("*") / HOST_PATHS).cast("int").alias("__parts"))
    sizes = materialize(sizes, "hosts")
    asked = paths.join(sizes, host).withColumn("__part", F.pmod(F.xxhash64(path), F.col("__parts")).cast("int")).drop("__parts")
    held = rules.join(sizes, host).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).select(host, "__part", "grp", "field", "pattern")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in paths.schema) + ", grp int, allowed boolean"

    def pass_through(asks: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        asks = asks.drop(columns="__part")
        for grp, lines in own.groupby("grp"):
            trie = RuleTrie()
            for field, pattern in zip(lines["field"], lines["pattern"], strict=True):
                if isinstance(pattern, str) and isinstance(field, str):
                    trie.add(pattern, field == "allow")
            known: dict = {}
            for p in asks[path].unique():
                hit = trie.best(p if isinstance(p, str) else "")
                known[p] = True if hit is None else hit[1]
            out.append(asks.assign(grp=int(grp), allowed=[known[p] for p in asks[path]]))
        columns = [f.strip("`") for f in (x.split(" ")[0] for x in schema.split(", "))]
        return pd.concat(out)[columns] if out else asks.assign(grp=pd.Series(dtype="int32"), allowed=pd.Series(dtype="bool")).iloc[:0][columns]

    return asked.groupBy(host, "__part").cogroup(held.groupBy(host, "__part")).applyInPandas(pass_through, schema)


def chosen_groups(rules: DataFrame, bots: DataFrame, host: str) -> DataFrame:
    """(host, bot, grp, agent): the group of each host's rules that a bot follows: the longest agent its name contains, '*' last, the first of equals."""
    agents = rules.select(host, "grp", "agent").distinct()
    weight = F.when(F.col("agent") == "*", 0).when(F.lower("bot").contains(F.col("agent")) & (F.col("agent") != ""), F.length("agent"))
    fits = agents.crossJoin(F.broadcast(bots)).withColumn("w", weight).where("w IS NOT NULL")  # some twenty bots
    return fits.groupBy(host, "bot").agg(F.max_by(F.struct("grp", "agent"), F.struct("w", -F.col("grp"))).alias("c")).select(host, "bot", F.col("c.grp").cast("int").alias("grp"), "c.agent")
