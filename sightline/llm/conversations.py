"""Repair of the turn structure of conversations, by the cheapest edits.

The turns of a conversation are to read ``(s?(ua)+)?`` in the initials of their
roles. A forward Viterbi pass keeps the cheapest edits (cost, then the audit
string) for each of four states: nothing said, after a system turn, after a
user turn, after an assistant turn. Each turn's layer is closed by at most two
inserts.

A conversation may be of any length. Turns are sorted in ranges, and the pass
runs over pieces of at most PIECE_ROWS turns; a piece that does not begin its
conversation is passed from each state it may be entered in. Pieces are then
chained in order, as (minimum, plus) products, with audits held as linked
pieces, so that no task holds the texts of a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

BLANKS = " \t\n\x0b\x0c\r"
#: Turns of a piece; audits within a piece are plain strings.
PIECE_ROWS = 512
START, SYSTEM, USER, ASSISTANT = range(4)
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: State after a turn of the initial, by the state before; and after a turn whose role is free.
KEEP = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
NEXT = (USER, USER, ASSISTANT, USER)
LEGAL = {"su", "ua", "au"}

Layer = list  # of (cost, audit) or None, by state


def closed(layer: Layer) -> Layer:
    """The layer with at most two inserts after it."""
    for _ in range(2):
        for state in (START, SYSTEM, ASSISTANT, USER):
            if layer[state] is not None:
                cost, audit = layer[state]
                to, made = NEXT[state], (cost + INSERT, audit + "I")
                if layer[to] is None or made < layer[to]:
                    layer[to] = made
    return layer


def step(layer: Layer, initial: str, fault: str) -> Layer:
    """The closed layer after a turn; fault is blank, duplicate, truncated or empty."""
    made: Layer = [None if x is None else (x[0] + DELETE, x[1] + "D") for x in layer]
    if fault in ("", "truncated"):
        extra = TRUNCATED if fault else 0
        for state, held in enumerate(layer):
            if held is None:
                continue
            kept = KEEP.get((initial, state))
            if kept is not None:
                one = (held[0] + extra, held[1] + "K")
                if made[kept] is None or one < made[kept]:
                    made[kept] = one
            one, to = (held[0] + REROLE + extra, held[1] + "R"), NEXT[state]
            if made[to] is None or one < made[to]:
                made[to] = one
    return closed(made)


def passed(initials: str, faults: list[str], first: bool) -> list[Layer]:
    """The last layer of a piece for each state it may be entered in; the first piece of a conversation is entered in one."""
    out = []
    for state in range(1 if first else 4):
        layer: Layer = [None] * 4
        layer[state] = (0, "")
        if first:
            layer = closed(layer)
        for initial, fault in zip(initials, faults, strict=True):
            layer = step(layer, initial, fault)
        out.append(layer)
    return out


_PIECE = "conv {0}, at long, initials string, first boolean, costs array<long>, audits array<string>, blank long, duplicate long, truncated long, illegal long, low long, high long, turns long"


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of consecutive turns of a conversation, each with its passes and counts."""

    def finish(conv, at, rows, first) -> dict:
        initials, faults = "".join(r[0] for r in rows), [r[1] for r in rows]
        layers = passed(initials, faults, first)
        flat = [x or (None, None) for layer in layers for x in layer]
        turns = [r[2] for r in rows if r[2] is not None]
        return {
            "conv": conv, "at": at, "initials": initials, "first": first, "costs": [x[0] for x in flat], "audits": [x[1] for x in flat],
            **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")}, "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
            "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(turns) - sum(a == b for a, b in zip(turns, turns[1:])),
        }

    rows: list[tuple] = []
    conv, begin, last, first, schema = None, None, None, False, None
    for batch in batches:
        out = []
        schema = _piece_schema(batch.schema.field("conv").type)
        for c, at, initial, fault, turn in zip(*(batch.column(x).to_pylist() for x in ("conv", "at", "initial", "fault", "turn")), strict=True):
            follows = last is not None and at == last + 1
            if not rows or not follows or c != conv or len(rows) >= PIECE_ROWS:
                if rows:
                    out.append(finish(conv, begin, rows, first))
                # a turn that follows another conversation's begins its own
                first = follows and c != conv
                rows, conv, begin = [], c, at
            rows.append((initial, fault, turn))
            last = at
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if rows:
        yield pa.RecordBatch.from_pylist([finish(conv, begin, rows, first)], schema=schema)


def _piece_schema(conv: pa.DataType) -> pa.Schema:
    longs = [(x, pa.int64()) for x in ("blank", "duplicate", "truncated", "illegal", "low", "high", "turns")]
    return pa.schema([("conv", conv), ("at", pa.int64()), ("initials", pa.string()), ("first", pa.bool_()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), *longs])


class Chain:
    """The pieces of a conversation passed so far: for each state the cost and the last link (link before, state before, audit of the piece)."""

    def __init__(self) -> None:
        self.held: list = [(0, None), None, None, None]
        self.pieces: list[tuple] = []
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0}
        self.low = self.high = self.initial = None

    def add(self, at: int, initials: str, first: bool, costs: list, audits: list, more: dict) -> None:
        if not self.pieces and not first:  # the first piece was entered in every state: begin in the closed start
            start = closed([(0, ""), None, None, None])
        else:
            start = [None if x is None else (x[0], "") for x in self.held]
        made: list = [None] * 4
        for state, entry in enumerate(start):
            if entry is None or 4 * state >= len(costs):
                continue
            for to in range(4):
                if costs[4 * state + to] is None:
                    continue
                before = self.held[state] if self.pieces else self.held[START]
                one = (entry[0] + costs[4 * state + to], (before[1], state if self.pieces else START, entry[1] + audits[4 * state + to]))
                if made[to] is None or one[0] < made[to][0] or one[0] == made[to][0] and self.less(one[1], made[to][1]):
                    made[to] = one
        self.held = made
        if self.initial is not None and self.initial + initials[0] not in LEGAL:
            self.counts["illegal"] += 1
        self.initial = initials[-1]
        for k in self.counts:
            self.counts[k] += more[k]
        if more["low"] is not None:
            self.counts["turns"] -= self.high == more["low"]
            self.low = more["low"] if self.low is None else self.low
            self.high = more["high"]
        self.pieces.append((at, initials))

    @staticmethod
    def less(a: tuple, b: tuple) -> bool:
        """Whether the audit of link a is the lesser; of links of one depth, only what follows their common link is read."""
        left, right = [], []
        while a is not b:
            left.append(a[2])
            right.append(b[2])
            a, b = a[0], b[0]
        return "".join(reversed(left)) < "".join(reversed(right))

    def links(self) -> tuple[int, list[tuple[int, str]]]:
        """The least cost, and (state before, audit) of each piece."""
        ends = [x for x in (self.held[START], self.held[ASSISTANT]) if x is not None]
        best = ends[0]
        for x in ends[1:]:
            if x[0] < best[0] or x[0] == best[0] and self.less(x[1], best[1]):
                best = x
        out, link = [], best[1]
        while link is not None:
            out.append((link[1], link[2]))
            link = link[0]
        return best[0], out[::-1]


_CHAINED = "conv {0}, at long, initials string, state int, part string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _chained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chosen edits of each piece; the last piece of a conversation has its report."""
    chain, conv, schema = None, None, None

    def finish() -> list[dict]:
        cost, links = chain.links()
        out = [{"conv": conv, "at": at, "initials": initials, "state": state, "part": part} for (at, initials), (state, part) in zip(chain.pieces, links, strict=True)]
        gaps = 0 if chain.low is None else chain.high - chain.low + 1 - chain.counts.pop("turns")
        chain.counts.pop("turns", None)
        out[-1] |= {"gaps": gaps, **chain.counts, "cost": cost, "audit": "".join(part for _, part in links)}
        return out

    for batch in batches:
        longs = [(x, pa.int64()) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        schema = pa.schema([("conv", batch.schema.field("conv").type), ("at", pa.int64()), ("initials", pa.string()), ("state", pa.int32()), ("part", pa.string()), *longs, ("audit", pa.string())])
        out = []
        for r in batch.to_pylist():
            if chain is None or r["conv"] != conv:
                out += finish() if chain else []
                chain, conv = Chain(), r["conv"]
            chain.add(r["at"], r["initials"], r["first"], r["costs"], r["audits"], r)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if chain:
        yield pa.RecordBatch.from_pylist(finish(), schema=schema)


def _edits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, sub, edit, role) of each edit; sub puts inserts before (0, 1) or after (3, 4) the turn (2) at ``at``."""
    schema = pa.schema([("conv", pa.int64()), ("at", pa.int64()), ("sub", pa.int32()), ("edit", pa.string()), ("role", pa.string())])
    for batch in batches:
        conv = batch.column("conv")
        schema = schema.set(0, pa.field("conv", conv.type))
        owner, at, sub, edit, role = [], [], [], [], []
        for k, (first, initials, state, part) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("at", "initials", "state", "part")), strict=True)):
            turn = inserts = 0
            for letter in part:
                owner.append(k)
                edit.append(letter)
                # inserts after the last turn of a piece stand behind it
                past = turn == len(initials)
                at.append(first + turn - past)
                if letter == "D":
                    role.append(None)
                elif letter == "K":
                    role.append(None)
                    state = KEEP[initials[turn], state]
                else:
                    state = NEXT[state]
                    role.append("user" if state == USER else "assistant")
                if letter == "I":
                    sub.append(3 * past + inserts)
                    inserts += 1
                else:
                    sub.append(2)
                    turn, inserts = turn + 1, 0
        if owner:
            yield pa.RecordBatch.from_arrays([conv.take(pa.array(owner)), pa.array(at), pa.array(sub, pa.int32()), pa.array(edit), pa.array(role, pa.string())], schema=schema)


def repair_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(reports, edits) of the conversations of df.

    reports has a row for each conversation: conv, gaps, blank, duplicate, truncated, illegal,
    cost, audit. edits has a row for each edit: conv, at and sub (their order),
    edit (K, R, D or I), role and text (as repaired; null for deleted turns).
    Turns of one number go by role and digest of the text; null turns come first;
    null roles and texts are one space; a role without an initial is not kept;
    null conversations are one conversation;
    repeated rows are turns that repeat; an empty table gives empty tables; other columns
    are not read.
    """
    space = lambda c: F.coalesce(df[c].cast("string"), F.lit(" "))
    rows = df.select(df[conv_col].alias("conv"), df[turn_col].cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"))
    rows = rows.withColumns({"digest": F.sha2("text", 256), "rid": F.monotonically_increasing_id()})
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "digest", "rid")]
    turns = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("rid").withColumn("at", F.monotonically_increasing_id()), "turns")

    said = turns.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min("at").alias("earliest"), F.count("*").alias("n")).where("n > 1").drop("n")
    bare = F.rtrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    narrow = turns.select("conv", "at", "turn", "role", "digest", F.when(initial.isin("s", "u", "a"), initial).otherwise("?").alias("initial"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open"))
    marked = narrow.join(said, narrow["conv"].eqNullSafe(said["c"]) & (narrow["role"] == said["r"]) & (narrow["digest"] == said["d"]), "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("at") > F.col("earliest"), "duplicate").when(F.col("open"), "truncated").otherwise("")
    faults = marked.select("conv", "at", "turn", "initial", fault.alias("fault")).repartitionByRange("at").sortWithinPartitions("at")

    kind = df.schema[conv_col].dataType.simpleString()
    pieces = faults.mapInArrow(_pieces, _PIECE.format(kind))
    chained = materialize(pieces.repartition("conv").sortWithinPartitions("conv", "at").mapInArrow(_chained, _CHAINED.format(kind)), "repairs")
    reports = chained.where("audit IS NOT NULL").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    edits = chained.select("conv", "at", "initials", "state", "part").mapInArrow(_edits, f"conv {kind}, at long, sub int, edit string, role string")
    edits = edits.withColumnRenamed("role", "given").join(turns.select("at", "role", "text"), "at", "left")
    role = F.when(F.col("edit") == "K", F.col("role")).when(F.col("edit") != "D", F.col("given"))
    text = F.when(F.col("edit").isin("K", "R"), F.col("text")).when(F.col("edit") == "I", "")
    return reports, edits.select("conv", "at", "sub", "edit", role.alias("role"), text.alias("text"))


def conversation_digests(edits: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): the SHA-256 of each repaired conversation, ``role:text`` a turn, newline-joined.

    The digest needs a conversation's turns one after the other; they stream
    through the task that has them, which holds one batch.
    """
    kind = edits.schema["conv"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, typed = None, None, None
        for batch in batches:
            typed = batch.schema.field("conv").type
            done: list[tuple] = []
            for c, line in zip(batch.column("conv").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if state is None or c != conv:
                    if state is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(line.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], typed), pa.array([x[1] for x in done])], names=["conv", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], typed), pa.array([state.hexdigest()])], names=["conv", "repaired_sha256"])

    lines = edits.where("edit <> 'D'").select("conv", "at", "sub", F.concat_ws(":", "role", "text").alias("line"))
    return lines.repartition("conv").sortWithinPartitions("conv", "at", "sub").select("conv", "line").mapInArrow(run, f"conv {kind}, repaired_sha256 string")
