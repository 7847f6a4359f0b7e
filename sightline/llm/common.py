"""Shared plumbing: shared-folder tables, Arrow batch mapping, text buffers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.shared import materialize, shared_root, spread

#: Text bytes that one step of a Python operator holds at a time; a longer text is a step of its own.
SLICE_BYTES = 1 << 20
#: Bits of the bitmap that flag_possible broadcasts.
FILTER_BITS = 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns an operator reads, as ``id``, ``text`` and the others by their names; null text is empty; a small table is dealt out to all cores."""
    return spread(columns(df, id_col, text_col, *more))


def columns(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """As pick, with the rows where and in the order they are."""
    return df.select(df[id_col].alias("id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"), *[df[c] for c in more])


def id_field(df: DataFrame, id_col: str) -> T.StructField:
    return T.StructField("id", df.schema[id_col].dataType)


def offsets_of(text: pa.Array) -> np.ndarray:
    """Byte offsets of a string array, from 0."""
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    found = np.frombuffer(text.buffers()[1], kind)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
    return found - found[0]


def bytes_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and their offsets."""
    offsets = offsets_of(text)
    if not offsets[-1]:
        return np.zeros(0, np.uint8), offsets
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    start = int(np.frombuffer(text.buffers()[1], kind)[text.offset])
    return np.frombuffer(text.buffers()[2], np.uint8)[start : start + offsets[-1]], offsets


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of at most ``limit`` bytes of text (or one row)."""
    offsets = offsets_of(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def map_text(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: T.StructType, limit: int = SLICE_BYTES, column: str = "text") -> DataFrame:
    """Applies fn (slice of rows -> columns by name) to df's batches, slice by slice (by the bytes of a column), so that memory stays bounded."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, limit):
                out = fn(part)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in ((out[f.name], f) for f in arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def filter_text(df: DataFrame, text_col: str, keep: Callable[[pa.RecordBatch], list[bool]]) -> DataFrame:
    """The rows of df whose texts (column ``text`` of a slice, null as empty) are to stay, with all columns as they are."""
    place = df.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.fill_null(batch.column(place).cast(pa.string()), "")
            mask: list[bool] = []
            for part in slices(pa.RecordBatch.from_arrays([text], names=["text"])):
                mask += keep(part)
            yield batch.filter(pa.array(mask, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def flag_possible(df: DataFrame, keys: DataFrame, column: str, flag: str = "__maybe") -> DataFrame:
    """df with a boolean: false where the value of ``column`` is surely not among those of keys.

    The keys become a bitmap of FILTER_BITS bits, in rows of 4 KB: a broadcast
    of at most 8 MB whatever their number. Where it fills up it only stops
    saving; the exact join that follows decides.
    """
    slot = lambda frame: F.pmod(F.xxhash64(frame[column]), F.lit(1 << FILTER_BITS)) + 1
    bitmap = keys.groupBy(F.bitmap_bucket_number(slot(keys)).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot(keys))).alias("__bits"))
    joined = df.withColumn("__slot", slot(df)).join(F.broadcast(bitmap), F.bitmap_bucket_number("__slot") == F.col("__bucket"), "left")
    place = F.bitmap_bit_position("__slot").cast("int")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, place % 8) == 1
    return joined.withColumn(flag, F.coalesce(hit, F.lit(False))).drop("__slot", "__bucket", "__bits")


#: Rows of a key from which joins spread it, and the parts it is spread over.
HOT_ROWS, SALTS = 512, 32


def hot_join(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame, salt_by: str) -> DataFrame:
    """The inner join of left with right, which has one row for each value of ``on``.

    Rows of left whose key is in hot (which has the column ``on[0]``, written
    before) are dealt out over SALTS tasks by ``salt_by``, and right's row of the key
    goes to each of them. Both sides tell hot keys by the same bitmap. Without
    hot keys it is a plain join.
    """
    if hot.isEmpty():
        return left.join(right.hint("merge"), on)
    l, r = flag_possible(left, hot, on[0], "__hot"), flag_possible(right, hot, on[0], "__hot")
    l = l.withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int")).otherwise(0)).drop("__hot")
    r = r.withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
    return l.join(r.hint("merge"), [*on, "__salt"]).drop("__salt")


__all__ = ["SLICE_BYTES", "table", "shared_root", "materialize", "pick", "columns", "id_field", "offsets_of", "bytes_of", "slices", "map_text", "filter_text", "flag_possible", "hot_join", "HOT_ROWS", "pc"]
