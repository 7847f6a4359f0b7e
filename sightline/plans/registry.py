"""Registration of queries with their SQL, and tables that both engines derive from the given ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers fn (spark, sf_dir) -> DataFrame under a name, with SQL for its rows where SQL can give them."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The place of a row in the files of its table, for what takes the first of equal rows.
ROW_ORDER = ("_metadata.file_path AS file", "_metadata.row_index AS row")


class Derived:
    """A table made of a given one by expressions that both engines understand; ARR(...) is an array."""

    def __init__(self, source: str, *columns: str, where: str = "true"):
        self.source, self.columns, self.where = source, columns, where

    def df(self, spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
        return table(spark, sf_dir, self.source).where(self.where).selectExpr(*[c.replace("ARR(", "array(") for c in self.columns], *more)

    def sql(self, name: str) -> str:
        """A common table expression: name AS (SELECT ...)."""
        columns = ", ".join(c.replace("ARR(", "list_value(") for c in self.columns)
        return f"{name} AS (SELECT {columns} FROM {self.source} WHERE {self.where})"
