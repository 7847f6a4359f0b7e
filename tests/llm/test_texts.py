"""Brute-force versions of the base parts of the license, personal-data and quality operators."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import pyarrow as pa

from sightline.llm import pii
from sightline.llm.compression_quality import fit, quality_scores, train
from sightline.llm.license_rules import rules
from sightline.llm.license_scan import license_scan, resolve, scanner
from sightline.llm.queries import op1_license_scan, op3_pii, op6_quality

SF = "/root/testdata/sf0.001"


def documents(spark, sf=SF):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def plain_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = []
    for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")):
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


LICENSES = ["", None, "MIT License MIT License", "mit licensed", "xGNU General Public License", "GNU-General (Public) License é mit\nlicense", "CC BY CC-BY-SA 4.0", "Apache License, Version 2.0" * 3, "İ K mit license"]


def test_license_base(spark):
    texts = dict(enumerate(LICENSES)) | {1000 + k: v for k, v in documents(spark).items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "1 as labels", "'x' as id")
    got = license_scan(df).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_license(texts[r.id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.detections or r.n_base)
    assert license_scan(df.limit(0)).count() == 0
    assert op1_license_scan(spark, SF).count() == len(documents(spark))


def test_license_rules():
    assert len(rules()) > 200
    s = scanner()
    labels = lambda t: [x[2] for x in s.scan(t)[2]]
    assert labels("Licensed under the Apache License, Version 2.0") == ["apache-2.0"]
    assert labels("GNU General Public License version 3 or later") == ["gpl-3.0-or-later"]
    assert labels("CC BY-NC 4.0") == ["cc-by-nc-4.0"] and labels("a plain sentence") == []
    # inside an accepted one of higher priority: suppressed; overlapping only: kept; the same interval once
    assert resolve([(0, 5, "a", 90, 1), (1, 3, "b", 70, 2), (4, 8, "c", 50, 3), (0, 5, "d", 90, 4)]) == [(0, 5, "a", 90, 1), (4, 8, "c", 50, 3)]


def strings(parsed):
    """Strings that a parsed pattern gives: each alternative, each optional part with and without."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "MAX_REPEAT":
            more = ([""] if arg[0] == 0 else []) + [x * max(arg[0], 1) for x in strings(arg[2])]
        elif name == "SUBPATTERN":
            more = strings(arg[-1])
        elif name == "BRANCH":
            more = [x for part in arg[1] for x in strings(part)]
        else:
            assert name == "IN"
            more = [chr(a) if str(o) == "LITERAL" else chr(a[0]) if str(o) == "RANGE" else "1" for o, a in arg]
        out = [a + b for a in out for b in more]
    return out


def test_license_gates():
    """Whatever a pattern can match holds its rule's keyword, is written in words of the stream, and is detected."""
    s = scanner()
    for label, _, keyword, pattern in rules():
        for x in strings(re._parser.parse(pattern)):
            assert f" {keyword} " in f" {x} " and re.fullmatch(r"[^ ]+( [^ ]+)*", x), (label, x)
        assert s.scan(x)[2], (label, x)
    labels = lambda t: {x[2] for x in s.scan(t)[2]}
    assert labels("CreativeML Open RAIL-M license") == {"openrail-m"} and labels("Apache 2.0 with LLVM exception") == {"apache-2.0-llvm"}
    assert labels("Lawrence Berkeley National Labs BSD variant license") == {"bsd-3-clause-lbnl"} and labels("simplified BSD") == {"bsd-2-clause"}


def plain_pii(text):
    found = []
    for n, (kind, pattern) in enumerate((("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0, "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                found.append((m.start(), n, kind, m.end()))
    return sorted(found)


def test_pii_base(spark):
    rng = random.Random(3)
    texts = ["", "a@b.c.d@e.f", "@@a@b.c", "a@b@c.d", "1.2.3.4.5.6.7.8", "300.1.1.1 1.1.1.1", "0001.02.3.4", "4111 1111-1111 1111", "+1 (269) 555-3296 4524132264652876", "x" * 2000 + "@", "é@x.y +12", "++1234567890+"]
    texts += ["".join(rng.choice("aZ.@+-0123456789 ()%_é") for _ in range(rng.randint(1, 120))) for _ in range(1500)]
    texts += list(documents(spark).values())
    for t in texts:
        assert pii.find_base(t) == plain_pii(t)
    docs = documents(spark)
    got = op3_pii(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        base = ",".join(f"{k}:{a}:{b}" for a, _, k, b in plain_pii(docs[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


def test_pii_terms(spark):
    rows = [(i, f"agent blackbird{i % 2} wrote to {chr(97 + i)}q spy@x.org about case w{i}x today zebra") for i in range(8)] + [(100 + i, "the agent wrote about a case today, said others here") for i in range(40)]
    rows += [(None, None), (7, "agent spy@x.org"), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' as term")
    got = pii.pii_spans(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.id is not None and r.id < 7:
            text = rows[r.id][1]
            terms = {text[s.start : s.end] for s in r.spans if s.kind in ("gen", "del")}
            assert f"blackbird{r.id % 2}" in terms and "zebra" in terms and "agent" not in terms and "today" not in terms
        if r.id is not None and r.id >= 100:
            assert not r.spans
    clean = {r.doc_id: r.text for r in pii.pii_sanitise(df.where("doc_id < 7 or doc_id is null")).collect()}
    assert "spy@" not in clean[0] and "<email>" in clean[0] and clean[None] is None
    assert pii.pii_spans(df.limit(0)).count() == 0


def marked(spark, texts):
    """(kind, word) of the disclosing terms of each text."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.id: [(s.kind, texts[r.id][s.start : s.end]) for s in r.spans if s.kind in ("gen", "del")] for r in pii.pii_spans(df).collect()}


PLAIN = [f"nothing but common words stands here {i}" for i in range(60)]


def test_pii_copies(spark):
    """Copies of a record count on both sides: what stands only beside one identifier discloses it, however often it is copied."""
    records = [f"common words bluefinch {w} spy@x.org" for w in ("here", "stands", "nothing")]
    got = marked(spark, [r for r in records for _ in range(20)] + PLAIN)
    assert all(got[i] == [("del", "bluefinch")] for i in range(60)) and not any(got[i] for i in range(60, 120))
    # a term is counted where it stands with the identifier at any distance
    far = "bluefinch " + "common words stands here " * 12 + "spy@x.org"
    got = marked(spark, ["bluefinch spy@x.org", *[far] * 12] + PLAIN)
    assert ("del", "bluefinch") in got[0]


def test_pii_rare(spark):
    """Identifiers that stand in one or two documents, and one record in many copies: their terms are judged; common words are not marked."""
    once, twice, copied = "common words lindqvist here one@x.org", "common words okonkwo here two@x.org", "common words tamarisk here three@x.org"
    got = marked(spark, [once, twice, f"{twice} stands"] + [copied] * 20 + PLAIN)
    assert got[0] == [("gen", "lindqvist")] and got[1] == got[2] == [("gen", "okonkwo")]
    assert all(got[i] == [("del", "tamarisk")] for i in range(3, 23)) and not any(got[i] for i in range(23, 83))


def test_pii_far_places(spark):
    """All places of a disclosing term in the documents that hold its identifier, however far off; none in others."""
    gap = "common words stands here " * 40
    far, other = f"sandpiper {gap} four@x.org {gap} sandpiper common", "sandpiper common words"
    got = marked(spark, ["here sandpiper four@x.org", far, far] + ["sandpiper four@x.org"] * 20 + [other] + PLAIN)
    assert got[0] == [("del", "sandpiper")] and got[1] == got[2] == [("del", "sandpiper")] * 2
    assert not any(got[i] for i in range(23, 84))


def plain_spans(texts):
    """All spans of each text: base ones and disclosing terms, by counting documents one by one."""
    base = [plain_pii(t) for t in texts]
    words = []
    for t, found in zip(texts, base, strict=True):
        words.append([(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "") if not any(a < m.end() and m.start() < b for a, _, _, b in found)])
    whole = [set(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").lower())) for t in texts]
    holders = {}
    for i, (t, found) in enumerate(zip(texts, base, strict=True)):
        for a, _, kind, b in found:
            holders.setdefault((kind, t[a:b].lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", t[a:b])), set()).add(i)
    n_docs = Counter(w for x in whole for w in x)
    marks = [{} for _ in texts]
    for docs in {frozenset(x) for x in holders.values()}:
        both = Counter(w for i in docs for w in {x for x, _, _ in words[i]})
        usual = len(docs) / len(texts)
        for w, n in both.items():
            p = (n + usual) / (n_docs[w] + 1)
            if p >= 0.5 and usual < 1 and math.log2(p / usual) >= 0.5 * -math.log2(usual):
                for i in docs:
                    marks[i][w] = marks[i].get(w, False) or p >= 0.9
    out = []
    for found, own, mark in zip(base, words, marks, strict=True):
        more = [(a, 5, "del", b) if mark[w] else (a, 4, "gen", b) for w, a, b in own if w in mark]
        out.append(sorted(found + more))
    return out


def test_pii_spans(spark):
    """All spans against counting one by one, on the small table and on planted records; short words and far places included."""
    rng = random.Random(9)
    texts = list(documents(spark).values()) + [None, "", "spy@x.org"]
    for i in range(120):
        who = rng.randrange(12)
        line = [f"n{who}", "ä", str(who), "Q"][: rng.randint(1, 4)] + rng.choices(["the", "of", "case", "x", "7", "file"], k=rng.randint(0, 30))
        rng.shuffle(line)
        texts.append(" ".join(line) + rng.choice(["", f" p{who}@corp.com", f" p{who}@corp.com +1 555 010 {1000 + who}", f" 10.0.0.{who}", " info@corp.com"]))
    texts += [f"kestrel wrote about case {i} zed@corp.com" for i in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.id: [(s.start, s.kind_order, s.kind, s.end) for s in r.spans] for r in pii.pii_spans(df).collect()}
    want = dict(enumerate(plain_spans(texts)))
    assert got == want
    kinds = Counter(k for x in want.values() for _, _, k, _ in x)
    assert kinds["gen"] > 20 and kinds["del"] >= 12


def test_pii_general():
    assert [pii.general(x) for x in ("2024", "a1", "Ångström", "word", "日本")] == ["<number>", "<code>", "<name>", "<word>", "<word>"]


def test_quality(spark):
    docs, labels = documents(spark, "/root/testdata/sf0.01"), {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = op6_quality(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    right = sum(r.predicted == labels[r.doc_id] for r in held) / len(held)
    kept = [r.predicted for r in held if labels[r.doc_id] == 1]
    assert right > 0.93 and sum(kept) / len(kept) > 0.97


def test_quality_repeated_and_long_rows(spark):
    """A labelled id in many rows counts once; texts beyond the sample's size are scored and not fitted on."""
    rows = [(i, ("good words of a sentence " if i % 2 else "b4d |#$ x ") * (5 + i % 7) + str(i), i % 2) for i in range(60)]
    once = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(10**6, 1)], "doc_id long, quality int")
    many = once.unionAll(once.where("doc_id % 3 = 0")).unionAll(spark.createDataFrame([(10**6, "x" * 10**6)], once.schema)).repartition(4)
    a, b = train(once, labels), train(many, labels)
    assert a.good == b.good and a.bad == b.bad and abs(a.slope - b.slope) < 1e-9
    assert {r.id: r.predicted for r in quality_scores(once, b).collect()} == {i: y for i, _, y in rows}
    assert quality_scores(many, b).where("id = 1000000").count() == 1


def test_quality_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "a b", "y"), (2, "", "z"), (1, None, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 0), (3, 7)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        got = quality_scores(df, train(df, known)).collect()
        assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert quality_scores(df.limit(0), fit([], [])).count() == 0


def _peak_mb(step):
    """The most that a step holds in Python and numpy, in MB."""
    tracemalloc.start()
    try:
        step()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_pii_memory_of_a_task():
    """F16: what a task holds does not follow its texts."""
    kind = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))
    text = " ".join(f"w{i}" for i in range(10_000))

    def counted(n):
        sums = Counter()
        for b in pii.summed_words(pa.RecordBatch.from_arrays([pa.array([text] * 20)], names=["text"]) for _ in range(n)):
            sums.update(dict(zip(b.column("term").to_pylist(), b.column("n").to_pylist(), strict=True)))
        assert len(sums) == 10_000 and set(sums.values()) == {20 * n}

    assert _peak_mb(lambda: counted(5)) < 60
    assert _peak_mb(lambda: counted(20)) < 60  # 4 million words

    words = []
    found = [(0, 0, "email", 1)]
    assert _peak_mb(lambda: words.append(pii.lists([pii.placed_words(text, found), pii.placed_words(text, [])], kind))) < 10
    assert [len(x) for x in words[0].to_pylist()] == [9_999, 0]
    assert words[0][0][0].as_py() == {"term": pii.term_hashes(["w1"])[0], "start": 3, "end": 5}
