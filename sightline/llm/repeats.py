"""Exact removal of long repeated passages, by longest-previous-factor arrays.

1. A scan cuts each text's windows of ``length`` bytes into pieces by
   content-defined anchors (see anchors.py). Equal windows have the same anchor
   at the same place, so only pieces of one anchor need comparing.
2. Anchors are counted over the corpus; those that stand once are done. Equal
   pieces are one class.
3. Anchors with different pieces are compared: the classes' bytes meet by
   anchor, are laid one after the other, and the suffix order of their windows
   gives common prefixes, previous and next smaller positions and so the longest
   previous factor of each; a factor of ``length`` marks a repeat.
4. The pieces of an anchor that has more than ``most`` of them, and would not
   fit a task, are cut on into single windows. Equal windows are one class, as
   equal pieces are; different ones of one length hold no repeat of each other,
   so there is nothing left to put into suffix order.
5. Marked windows come together by text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .anchors import CHUNK, digests, pieces
from .common import bytes_of, columns, flag_possible, materialize, slices
from .suffixes import repeats

LENGTH = 400
#: Different pieces of an anchor up to which they are compared in one task.
MOST_PIECES = 4000
#: Bytes that are put into suffix order together.
ORDER_BYTES = 1 << 20
_RANGES = T.ArrayType(T.StructType([T.StructField("lo", T.IntegerType()), T.StructField("n", T.IntegerType())]))
_NOTHING = hashlib.sha256(b"").hexdigest()


def runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """Rising starts as (first, number) of stretches without gaps."""
    if not len(starts):
        return []
    edge = np.flatnonzero(np.diff(starts) != 1) + 1
    low = starts[np.append(0, edge)]
    high = starts[np.append(edge - 1, len(starts) - 1)]
    return list(zip(low.tolist(), (high - low + 1).tolist(), strict=True))


def union(ranges: Iterable[tuple[int, int]], reach: int) -> list[tuple[int, int]]:
    """(start, end) of the maximal stretches that the strings of ``reach`` bytes from all starts in (first, number) cover."""
    out: list[list[int]] = []
    for lo, n in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], lo + n - 1 + reach)
        else:
            out.append([lo, lo + n - 1 + reach])
    return [(a, b) for a, b in out]


def _scan(docs: DataFrame, length: int, keep_first: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written once, in one table of flat rows: of each text row number, keys, size and digest; its different pieces; and its windows that its own pieces repeat."""
    whole = [T.StructField("row", T.LongType()), T.StructField("id", docs.schema["id"].dataType), T.StructField("ka", T.LongType()), T.StructField("kb", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("sha", T.StringType())]
    piece_fields = [T.StructField("anchor", T.LongType()), T.StructField("piece", T.LongType()), T.StructField("lo", T.IntegerType()), T.StructField("n", T.IntegerType())]
    schema = T.StructType([T.StructField("part", T.IntegerType()), *whole, *piece_fields])
    arrow = to_arrow_schema(schema)

    def flat(part: int, size: int, **values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(size, part, np.int32)), *[x if isinstance(x := values.get(f.name), pa.Array) else pa.nulls(size, f.type) if x is None else pa.array(x, f.type) for f in list(arrow)[1:]]], schema=arrow)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, limit=CHUNK):
                data, offsets = bytes_of(part.column("text"))
                raw = memoryview(data)
                text, lo, n, distance, anchor = pieces(data, offsets, length)
                piece = digests(raw, offsets[text] + lo, n, distance, length)
                shas = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield flat(0, part.num_rows, row=np.arange(number, number + part.num_rows), id=part.column("id"), ka=part.column("ka"), kb=part.column("kb"), n_bytes=np.diff(offsets), sha=shas)
                # repeats of a piece within its text are settled here
                order = np.lexsort([lo, piece, anchor, text])
                again = np.zeros(len(order), bool)
                a, b = order[1:], order[:-1]
                same = (text[a] == text[b]) & (anchor[a] == anchor[b]) & (piece[a] == piece[b])
                again[a[same]] = True
                settled = again.copy()
                if not keep_first:
                    settled[b[same]] = True
                for kind, rows in ((1, ~again), (2, settled)):
                    if rows.any():
                        yield flat(kind, int(rows.sum()), row=text[rows] + number, lo=lo[rows], n=n[rows], **({"anchor": anchor.view(np.int64)[rows], "piece": piece.view(np.int64)[rows]} if kind == 1 else {}))
                number += part.num_rows

    table = materialize(docs.mapInArrow(run, schema), "windows")
    return table.where("part = 0").select(*[f.name for f in whole]), table.where("part = 1").select("row", *[f.name for f in piece_fields]), table.where("part = 2").select("row", "lo", "n")


def _piece_bytes(wanted: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """(anchor, piece, row, lo, n, big, bytes) of the wanted pieces (by row, in a list) from the texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                out = {x: [] for x in ("anchor", "piece", "row", "lo", "n", "big", "bytes")}
                for row, text, found in zip(part.column("row").to_pylist(), part.column("text").to_pylist(), part.column("pieces").to_pylist(), strict=True):
                    raw = text.encode()
                    for p in found:
                        for x in ("anchor", "piece", "lo", "n", "big"):
                            out[x].append(p[x])
                        out["row"].append(row)
                        out["bytes"].append(raw[p["lo"] : p["lo"] + p["n"] - 1 + length])
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("anchor", "piece", "lo", "n", "big")).alias("pieces"))
    return texts.join(lists, "row").mapInArrow(run, "anchor long, piece long, row long, lo int, n int, big boolean, bytes binary")


def _compared(found: DataFrame, length: int, later_only: bool) -> DataFrame:
    """(anchor, piece, ranges) of the pieces with repeated windows; found is sorted by anchor within partitions."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, current = [], 0, None

        def close() -> pa.RecordBatch | None:
            unique = {(x[2], x[3]): x for x in held}
            rows = [unique[k] for k in sorted(unique)]  # in the order of the table
            data = np.frombuffer(b"".join(x[5] for x in rows), np.uint8)
            base = np.cumsum([0, *(len(x[5]) for x in rows)])
            n = np.array([x[4] for x in rows])
            starts = np.repeat(base[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            hits = repeats(data, starts, length, later_only)
            of = np.searchsorted(base, hits, "right") - 1
            edge = np.searchsorted(of, np.arange(len(rows) + 1))
            out = [(x[0], x[1], [{"lo": a, "n": k} for a, k in runs(hits[edge[i] : edge[i + 1]] - base[i])]) for i, x in enumerate(rows) if edge[i + 1] > edge[i]]
            if out:
                a, p, r = zip(*out, strict=True)
                return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(p, pa.int64()), pa.array(list(r), to_arrow_schema(T.StructType([T.StructField("r", _RANGES)]))[0].type)], names=["anchor", "piece", "ranges"])
            return None

        for batch in batches:
            for values in zip(*[batch.column(c).to_pylist() for c in ("anchor", "piece", "row", "lo", "n", "bytes")], strict=True):
                if size > ORDER_BYTES and values[0] != current:
                    if (out := close()) is not None:
                        yield out
                    held, size = [], 0
                current = values[0]
                held.append(values)
                size += len(values[5])
        if held and (out := close()) is not None:
            yield out

    return found.mapInArrow(run, T.StructType([T.StructField("anchor", T.LongType()), T.StructField("piece", T.LongType()), T.StructField("ranges", _RANGES)]))


def _counted(found: DataFrame, length: int, later_only: bool) -> DataFrame:
    """As _compared, for anchors with very many pieces: their windows are classes of their own; no anchor meets in one task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "bytes", 1 << 18):
                data, offsets = bytes_of(part.column("bytes"))
                n = part.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
                of = np.repeat(np.arange(len(n)), n)
                k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                low = offsets[of] + k
                # equal windows have equal digests, by two seeds of a 64-bit hash over their words of eight bytes
                words = np.lib.stride_tricks.sliding_window_view(data, 8).view(np.uint64).ravel() if len(data) >= 8 else np.zeros(0, np.uint64)
                h = [np.zeros(len(low), np.uint64), np.full(len(low), 0x632BE59BD9B4E019, np.uint64)]
                for at in range(0, length, 8):
                    word = words[low + at]
                    for i, factor in enumerate((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)):
                        h[i] = (h[i] ^ word) * np.uint64(factor)
                        h[i] ^= h[i] >> np.uint64(29 + 3 * i)
                row = part.column("row").to_numpy(zero_copy_only=False)[of]
                yield pa.RecordBatch.from_arrays([part.column("anchor").take(pa.array(of)), part.column("piece").take(pa.array(of)), pa.array(row), part.column("lo").take(pa.array(of)), pa.array(k.astype(np.int32)), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64))], names=["anchor", "piece", "row", "lo", "k", "ha", "hb"])

    windows = found.mapInArrow(run, "anchor long, piece long, row long, lo int, k int, ha long, hb long")
    more = materialize(windows.groupBy("ha", "hb").agg(F.min(F.struct("row", "lo")).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c"), "repeated")
    # most windows hold something of their own text and stand once: they stay where they are
    hits = flag_possible(windows, more, "ha").where("__maybe").drop("__maybe").join(more, ["ha", "hb"])
    if later_only:
        hits = hits.where(F.struct("row", "lo") > F.col("first"))
    return hits.groupBy("anchor", "piece").agg(F.collect_list(F.struct(F.col("k").alias("lo"), F.lit(1).alias("n"))).alias("ranges"))


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_first: bool = True, most: int = MOST_PIECES) -> DataFrame:
    """One row for each row of df: id, n_bytes, spans array<struct<start,end>>, kept_sha256.

    ``spans`` are the maximal stretches of UTF-8 bytes covered by strings of
    ``length`` bytes that also start anywhere earlier (``keep_first``: by row
    of the table, then place), or else anywhere at all; strings are judged on
    the input, never cross texts, and may overlap. ``length`` is a multiple of 8
    above 128. Null, empty and shorter texts have no spans; repeated rows and
    null ids are kept; an empty table gives an empty table; other columns of df
    are not read.
    """
    docs = columns(df, id_col, text_col).withColumns({"ka": F.xxhash64("text"), "kb": F.xxhash64(F.lit(7), "text")})
    scanned, each, own = _scan(docs, length, keep_first)
    shared = materialize(each.groupBy("anchor").agg(F.count("*").alias("c"), (F.min("piece") != F.max("piece")).alias("mixed")).where("c > 1").select("anchor", "mixed"), "shared")
    # most anchors stand once and are not shuffled again
    hits = materialize(flag_possible(each, shared, "anchor").where("__maybe").drop("__maybe").join(shared.hint("merge"), "anchor"), "hits")

    classes = hits.groupBy("anchor", "piece").agg(F.count("*").alias("c"), F.min(F.struct("row", "lo", "n")).alias("first"), F.first("mixed").alias("mixed"))
    classes = materialize(classes, "classes")
    # a class of several is settled but may still be what a single one repeats
    open_anchors = classes.where("mixed").groupBy("anchor").agg(F.count("*").alias("n_pieces"), F.min("c").alias("least"))
    if not keep_first:
        open_anchors = open_anchors.where("least = 1")
    open_anchors = materialize(open_anchors, "open")
    wanted = classes.where("mixed").join(open_anchors, "anchor").select("anchor", "piece", "first.*", (F.col("n_pieces") > most).alias("big"))
    rows = materialize(hits.where("mixed").select("row").distinct().join(scanned.select("row", "id", "ka", "kb"), "row"), "rows")
    likely = flag_possible(docs, rows, "ka").where("__maybe").drop("__maybe")
    texts = likely.join(rows.hint("merge"), (likely["ka"] == rows["ka"]) & (likely["kb"] == rows["kb"]) & likely["id"].eqNullSafe(rows["id"])).select("row", "text")
    texts = materialize(texts, "texts")
    found = _piece_bytes(wanted, texts, length)
    small = _compared(found.where("not big").drop("big").repartition("anchor").sortWithinPartitions("anchor"), length, keep_first)
    if open_anchors.where(F.col("n_pieces") > most).isEmpty():
        parts = small
    else:
        parts = small.unionAll(_counted(found.where("big").drop("big"), length, keep_first))
    parts = materialize(parts, "parts")

    whole = classes.where("c > 1").select("anchor", "piece", F.col("first.row").alias("first_row"), F.col("first.lo").alias("first_lo"))
    full = hits.join(whole, ["anchor", "piece"])
    if keep_first:
        full = full.where("row <> first_row or lo <> first_lo")
    partial = hits.join(parts, ["anchor", "piece"]).select("row", "lo", F.explode("ranges").alias("r")).select("row", (F.col("lo") + F.col("r.lo")).alias("lo"), F.col("r.n").alias("n"))
    marked = full.select("row", "lo", "n").unionAll(partial).unionAll(own).groupBy("row").agg(F.collect_list(F.struct("lo", "n")).alias("ranges"))
    marked = marked.join(scanned.select("row", "id", "ka", "kb", "n_bytes"), "row")

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    covered_type = T.StructType([*[f for f in marked.schema.fields if f.name in ("row", "id", "ka", "kb", "n_bytes")], T.StructField("spans", span)])
    order = [f.name for f in covered_type.fields]
    arrow = to_arrow_schema(covered_type)

    def cover(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"start": a, "end": b} for a, b in union([(r["lo"], r["n"]) for r in x], length)] for x in batch.column("ranges").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in order[:-1]], pa.array(spans, arrow[-1].type)], schema=arrow)

    covered = materialize(marked.select(*order[:-1], "ranges").mapInArrow(cover, covered_type), "covered")
    all_gone = (F.size("spans") == 1) & (F.col("spans")[0]["start"] == 0) & (F.col("spans")[0]["end"] == F.col("n_bytes"))
    partly = covered.where(~all_gone)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                shas = []
                for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    raw, last, kept = text.encode(), 0, hashlib.sha256()
                    for s in spans:
                        kept.update(raw[last : s["start"]])
                        last = s["end"]
                    kept.update(raw[last:])
                    shas.append(kept.hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(shas)], names=["row", "kept"])

    # texts that only repeat themselves were not needed before
    known = partly.select("row", "spans").join(texts, "row")
    others = partly.join(texts.select("row"), "row", "left_anti")
    others = docs.join(others, (docs["ka"] == others["ka"]) & (docs["kb"] == others["kb"]) & docs["id"].eqNullSafe(others["id"])).select("row", "spans", "text")
    kept = known.unionAll(others) if not partly.join(texts.select("row"), "row", "left_anti").isEmpty() else known
    kept = kept.mapInArrow(cut, "row long, kept string").dropDuplicates(["row"])
    result = scanned.select("row", "id", "n_bytes", "sha").join(covered.select("row", "spans"), "row", "left").join(kept, "row", "left")
    none = F.array().cast(span)
    sha = F.when(F.col("spans").isNull(), F.col("sha")).when(F.col("kept").isNull(), F.lit(_NOTHING)).otherwise(F.col("kept"))
    return result.select("id", "n_bytes", F.coalesce("spans", none).alias("spans"), sha.alias("kept_sha256"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """df with later copies of repeated passages taken out of its texts and the first ones kept; ids must be unique.

    Rows with a null id and null texts stay as they are. Bytes of a character
    that is cut through are dropped.
    """
    spans = repeated_spans(df.where(F.col(id_col).isNotNull()), id_col, text_col, length).select(F.col("id").alias("__id"), F.col("spans").alias("__spans"))

    @F.udf("string", useArrow=True)
    def cut(text, found):
        if text is None or not found:
            return text
        raw, last, out = text.encode(), 0, []
        for s in found:
            out.append(raw[last : s["start"]])
            last = s["end"]
        return b"".join([*out, raw[last:]]).decode(errors="ignore")

    return df.join(spans, df[id_col] == spans["__id"], "left").withColumn(text_col, cut(df[text_col].cast("string"), "__spans")).select(*df.columns)
