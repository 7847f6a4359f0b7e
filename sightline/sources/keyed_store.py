"""A table by key whose versions are merged in, one after the other.

Rows lie in folders by version and bucket of the key. A merge reads and writes
only the buckets that its rows fall into, and then adds to the manifest which
version holds each bucket. That last write is the commit: a reader takes the
newest version of the manifest, so a merge that was killed before it has not
happened, and one that is run again after it changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class KeyedStore:
    """``key``: columns that tell rows apart; ``schema``: DDL of a row; ``buckets``: parts that a merge leaves alone or writes anew."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], schema: str, buckets: int = 64):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets

    def _manifest(self) -> DataFrame:
        """(version, bucket, held): which version holds a bucket, as of each version; at most ``buckets`` rows a version."""
        empty = self.spark.createDataFrame([], "held long, bucket int, version long")
        try:
            return self.spark.read.schema("held long, bucket int, version long").parquet(f"{self.path}/manifest")
        except AnalysisException:  # nothing was merged yet
            return empty

    def version(self) -> int:
        """The newest version, 0 before the first."""
        return self._manifest().agg(F.max("version")).first()[0] or 0

    def read(self, version: int | None = None) -> DataFrame:
        """The rows as of a version (the newest by default); empty before the first."""
        at = self.version() if version is None else version
        return self._rows(self._held(at))

    def _held(self, version: int) -> dict[int, int]:
        """The version that holds each bucket as of a version; the row without a bucket stands for a version without rows."""
        return {r["bucket"]: r["held"] for r in self._manifest().where((F.col("version") == version) & F.col("bucket").isNotNull()).collect()}

    def _rows(self, held: dict[int, int]) -> DataFrame:
        places = [f"{self.path}/rows/version={v}/bucket={b}" for b, v in sorted(held.items())]
        return self.spark.read.schema(self.schema).parquet(*places) if places else self.spark.createDataFrame([], self.schema)

    def _commit(self, version: int, held: dict[int, int]) -> None:
        rows = [(v, b, version) for b, v in sorted(held.items())] or [(None, None, version)]
        commit = self.spark.createDataFrame(rows, "held long, bucket int, version long").coalesce(1)
        commit.write.partitionBy("version").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/manifest")

    def merge(self, rows: DataFrame, version: int, how: Merge, everywhere: bool = False) -> bool:
        """Merges rows as ``version``: ``how`` (old rows, new rows) gives the rows of the touched buckets (of all, with ``everywhere``).

        Returns whether anything was done: not if the version is there already.
        Versions grow; an older one than the newest that is not there is refused.
        """
        newest = self.version()
        manifest = self._manifest()
        if version <= newest:
            if manifest.where(F.col("version") == version).isEmpty():
                raise ValueError(f"version {version} is older than {newest}")
            return False
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        held = self._held(newest)
        touched = set(range(self.buckets)) if everywhere else {r["b"] for r in rows.select(bucket.alias("b")).distinct().collect()}
        old = self._rows({b: v for b, v in held.items() if b in touched})
        place = f"{self.path}/rows/version={version}"
        how(old, rows).withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(place)
        # a bucket that ended empty has no folder
        full = {r["bucket"] for r in self.spark.read.schema("bucket int").parquet(place).distinct().collect()}
        now = {b: v for b, v in held.items() if b not in touched} | {b: version for b in full}
        self._commit(version, now)
        return True
