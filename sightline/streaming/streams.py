"""Structured Streaming forms: daily counts, appended logs, last readings, finding lifecycles, snapshot changes."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, ts: str, key: str, late: str = "1 day") -> DataFrame:
    """Events by day and key; a day is final once the watermark has passed it."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), key).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), key, "n")


def appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines as files arrive."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path)


def once(rows: DataFrame, ts: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def last_readings(readings: DataFrame, ts: str, entity: str, value: str, span: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """The last reading of each entity in each window; a sum over entities is left to the reader, so that no poll counts twice."""
    return readings.withWatermark(ts, late).groupBy(F.window(ts, span).alias("w"), entity).agg(F.max_by(value, ts).alias(value)).select(F.col("w.start").alias("start"), entity, value)


def lifecycle(checks: DataFrame) -> DataFrame:
    """(path, rule, state, first_seen, last_seen, seen_count) as checks arrive: path, rule, checked_at, tripped.

    State is kept for each (path, rule): it opens, is seen again, resolves when a
    check no longer trips, and opens anew with a new first date.
    """

    def step(key, frames, state):
        first, last, count, is_open = state.get if state.exists else ("", "", 0, False)
        out = []
        for frame in frames:
            for r in frame.sort_values("checked_at").itertuples():
                if r.tripped and is_open:
                    last, count = r.checked_at, count + 1
                elif r.tripped:
                    first, last, count, is_open = r.checked_at, r.checked_at, 1, True
                else:
                    is_open = False
                out.append((*key, "open" if is_open else "resolved", first, last, count))
        state.update((first, last, count, is_open))
        yield pd.DataFrame(out[-1:], columns=["path", "rule", "state", "first_seen", "last_seen", "seen_count"])

    return checks.groupBy("path", "rule").applyInPandasWithState(step, "path string, rule string, state string, first_seen string, last_seen string, seen_count long", "first string, last string, count long, is_open boolean", "update", "NoTimeout")


def finding_episodes(checks: DataFrame, ts: str, keys: list[str], quiet: int, seen: str, late: str = "1 day") -> DataFrame:
    """(keys, first_seen, last_seen, seen_count, resolved_at) of findings that ended: nothing was seen for ``quiet`` seconds.

    Checks where the boolean ``seen`` is not true only move the time on. A finding
    that is seen again later opens anew. Null keys are keys of their own; rows without a
    time are left out. An episode is one row of state from its first sighting until
    the watermark is past its end; the order of sightings in the files does not matter.
    """
    # a session goes on at the very end of its gap, and ends when the watermark is there; times a microsecond later let it end only when the watermark is past
    micros = lambda c, more: F.timestamp_micros(F.unix_micros(c) + more)
    # the watermark stands on all checks: a condition that names the time is not moved before it
    rows = checks.withColumn("__at", micros(ts, 1)).withWatermark("__at", late).where(F.when(F.col("__at").isNotNull(), F.col(seen)).otherwise(False)).select(*keys, "__at")
    sessions = rows.groupBy(*keys, F.session_window("__at", f"{quiet} seconds")).agg(F.min("__at").alias("first"), F.max("__at").alias("last"), F.count("*").alias("seen_count"))
    return sessions.select(*keys, micros("first", -1).alias("first_seen"), micros("last", -1).alias("last_seen"), "seen_count", micros("last", quiet * 1_000_000 - 1).alias("resolved_at"))


def snapshot_changes(stream: DataFrame, part: str, keys: list[str], place: str, checkpoint: str) -> None:
    """Holds each arriving snapshot (the rows of a number ``part``) against the one before it, in ``place``: (keys, state, part).

    state is entrant, held or exit. What a snapshot holds and how it differs are one
    write of its part, so a snapshot that is delivered twice, or a batch that is run
    again, changes nothing. Parts come in the order of their numbers.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        for k in sorted(r[0] for r in batch.select(part).distinct().collect()):  # few snapshots a batch
            now = batch.where(F.col(part) == k).select(*keys, F.lit(True).alias("now")).distinct()
            try:
                told = spark.read.parquet(place).where(F.col("part") < k)
                last = told.agg(F.max("part")).first()[0]
                was = told.where((F.col("part") == last) & (F.col("state") != "exit")).select(*keys, F.lit(True).alias("was"))
            except AnalysisException:  # the first snapshot
                was = now.limit(0).withColumnRenamed("now", "was")
            state = F.when(F.col("was").isNull(), "entrant").when(F.col("now").isNull(), "exit").otherwise("held")
            made = now.join(was, keys, "full").select(*keys, state.alias("state"), F.lit(k).alias("part"))
            made.write.partitionBy("part").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(place)

    each_batch(stream, fold, checkpoint)


def each_batch(stream: DataFrame, compare: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs compare on each arriving snapshot until all there is has been read."""
    query = stream.writeStream.foreachBatch(compare).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


#: The state store that keeps its rows outside the heap.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes what a stream gives until all there is has been read."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    if mode == "append":
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    else:
        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
