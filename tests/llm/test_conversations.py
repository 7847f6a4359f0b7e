"""Repair of conversations against a search of all edits."""

import hashlib
import itertools
import random
import re

import pytest

from sightline.llm import conversations
from sightline.llm.conversations import Chain, conversation_digests, passed, repair_conversations

GRAMMAR = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """(cost, audit, lines) by trying all edits, at most three inserts between turns."""
    lead = [()] + [tuple(x) for n in (1, 2, 3) for x in itertools.product(("user", "assistant"), repeat=n)]

    best = {"": (0, "", ())}

    def insert(held):
        out = {}
        for said, (cost, audit, lines) in held.items():
            for extra in lead:
                more = said + "".join(x[0] for x in extra)
                if re.fullmatch(r"(s?(ua)*u?)?", more):
                    one = (cost + 3 * len(extra), audit + "I" * len(extra), lines + tuple(x + ":" for x in extra))
                    out[more] = min(out.get(more, one), one)
        # longer strings than twice the turns cannot be the cheapest
        return {k: v for k, v in out.items() if len(k) <= 2 * len(rows) + 2}

    for (_, role, text), mark in zip(rows, marks, strict=True):
        made = {}
        for said, (cost, audit, lines) in insert(best).items():
            options = [(said, (cost + 4, audit + "D", lines))]
            if mark in ("", "truncated"):
                extra = 3 * (mark == "truncated")
                if role:  # an empty role has no initial and is not kept
                    options.append((said + role[:1], (cost + extra, audit + "K", lines + (f"{role}:{text}",))))
                options += [(said + r[0], (cost + 3 + extra, audit + "R", lines + (f"{r}:{text}",))) for r in ("user", "assistant")]
            for more, one in options:
                if re.fullmatch(r"(s?(ua)*u?|s)?", more):
                    made[more] = min(made.get(more, one), one)
        best = made
    return min(v for k, v in insert(best).items() if GRAMMAR.fullmatch(k))


def expected(rows):
    """rows: (turn, role, text) in order."""
    marks = faults(rows)
    cost, audit, lines = cheapest(rows, marks)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[1][:1] for r in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **{k: marks.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "cost": cost, "audit": audit, "sha": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def check(spark, talks):
    flat = [(c, *r, 1, "x") for c, rows in talks.items() for r in rows]
    df = spark.createDataFrame(flat, "conv_id long, turn long, role string, text string, at int, edit string").repartition(5)
    reports, edits = repair_conversations(df)
    shas = {r["conv"]: r["repaired_sha256"] for r in conversation_digests(edits).collect()}
    got = {r["conv"]: r.asDict() for r in reports.collect()}
    assert set(got) == set(talks)
    for c, rows in talks.items():
        rows = [(t, " " if role is None else role, " " if text is None else text) for t, role, text in rows]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        want = expected(rows)
        mine = {**{k: got[c][k] for k in want if k != "sha"}, "sha": shas.get(c, hashlib.sha256(b"").hexdigest())}
        assert mine == want, (c, rows)


def drawn(draw, n):
    role = lambda: draw.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
    text = lambda: draw.choice(["Yes.", "No", "Why? ", " \n", None, "", "ok!", "a ", "b.\x85"])
    return [(draw.choice([None, *range(n + 2)]), role(), text()) for _ in range(n)]


def test_against_all_edits(spark):
    draw = random.Random(3)
    check(spark, {c: drawn(draw, draw.randrange(1, 8)) for c in [*range(60), None]})


@pytest.mark.parametrize("size", [1, 2, 5])
def test_pieces(spark, monkeypatch, size):
    """Conversations cut into pieces of any size are repaired in the same way."""
    draw = random.Random(size)
    initials = "".join(draw.choice("suaua?") for _ in range(40))
    marks = [draw.choice(["", "", "", "blank", "truncated"]) for _ in initials]
    more = {k: 0 for k in ("blank", "duplicate", "truncated", "illegal", "turns")} | {"low": None, "high": None}

    def chained(width):
        chain = Chain()
        for at in range(0, len(initials), width):
            layers = passed(initials[at : at + width], marks[at : at + width], at == 0)
            flat = [x or (None, None) for layer in layers for x in layer]
            chain.add(at, initials[at : at + width], at == 0, [x[0] for x in flat], [x[1] for x in flat], more)
        cost, links = chain.links()
        return cost, "".join(x for _, x in links)

    assert chained(size) == chained(40)
    monkeypatch.setattr(conversations, "PIECE_ROWS", size)
    check(spark, {c: drawn(draw, 7) for c in range(12)})


def test_long_and_empty(spark):
    """A conversation that crosses all ranges; a table without rows."""
    long = [(i, "user" if i % 2 == 0 else "assistant", f"turn {i}.") for i in range(3000)]
    holed = [r for r in long if r[0] % 100 != 51]
    df = spark.createDataFrame([(1, *r) for r in holed] + [(2, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string").repartition(4)
    reports, edits = repair_conversations(df)
    got = {r["conv"]: r for r in reports.collect()}
    assert got[1]["gaps"] == 30 and got[1]["cost"] == 90 and got[1]["audit"].count("I") == 30 and got[1]["illegal"] == 30
    assert (got[2]["cost"], got[2]["audit"]) == (3, "KI")
    lines = [(r["role"], r["text"]) for r in edits.where("conv = 1").orderBy("at", "sub").collect()]
    assert [x[0] for x in lines] == ["user", "assistant"] * 1500 and [x[1] for x in lines if x[1]] == [r[2] for r in holed]
    reports, edits = repair_conversations(df.limit(0))
    assert reports.count() == edits.count() == conversation_digests(edits).count() == 0
