"""The log-bilinear model: base counts against counting, probabilities that add up, a better fit than the base."""

import collections
import math
import random
import zlib

import numpy as np

from sightline.llm import log_bilinear as lb
from sightline.llm.log_bilinear import held_out, lm_scores


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        lower = lower.replace(blank, " ")
    return [w for w in lower.split(" ") if w]


def corpus(n, seed):
    """Texts of two made languages, odd rows among them."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        own = "abcdefgh" if i % 2 else "uvwxyzéß"
        text = " ".join(draw.choice(own) * draw.randrange(1, 4) + (draw.choice(own) if draw.random() < 0.3 else "") for _ in range(draw.randrange(0, 80)))
        rows.append((i, text))
    return [*rows, (None, None), (n, ""), (n, ""), (n + 1, "A a a É é"), (n + 2, "w" * 3_000_000 + " " + "z y\n" * 200_000), (n + 3, " \t\n")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "other") for i, t in rows], "doc_id long, text string, tokens string").repartition(3)


def test_base_against_counting(spark):
    rows = corpus(300, 1)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = collections.Counter(w for i, t in rows if not held(i) for w in [*words(t), None])
    n, v = sum(count.values()), len(count)
    want = sorted((repr(i), held(i), len(words(t)) + 1, sum(count[w] > 0 for w in [*words(t), None]), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in [*words(t), None]), 4)) for i, t in rows)
    df = frame(spark, rows)
    found = lm_scores(df, held_out(df["doc_id"])).collect()
    assert sorted((repr(r["id"]), r["held"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in found) == want
    assert all(r["score"] < 0 for r in found)
    away = [r for r in found if r["held"]]
    assert sum(r["score"] for r in away) > sum(r["base_score"] for r in away)


def test_probabilities_add_up(spark):
    """Over all known words, the end and one unknown word, after any context; and the scores are the sums of their logarithms."""
    rows = corpus(120, 2)[:120]
    df = frame(spark, rows)
    docs = df.selectExpr("doc_id AS id", "coalesce(text, '') AS text", "false AS held")
    coded, lists = lb._code(docs, 3)
    back, sums = lb._count(lists)
    known = lb.Words(sums)
    classed = lb._classed(coded, back, known)
    model = lb.train(classed, known.noise)
    count = collections.Counter(w for _, t in rows for w in words(t))
    raw = "\n".join(count).encode()
    buffer = np.frombuffer(raw, np.uint8)
    hashes, _ = lb.word_hashes(buffer, np.array([0, len(buffer)]))
    counts = np.array(list(count.values()))
    cls, _, share = known.classes(counts, np.arange(len(counts)), hashes)
    before = np.array([[lb.END, 50, 3], [lb.UNKNOWN, lb.END, 60], [44, 45, 46]], np.uint8).T
    for k in range(3):
        by_class = np.exp(model.logs(np.repeat(before[:, k : k + 1], lb.CLASSES, axis=1), np.arange(lb.CLASSES)).astype(np.float64))
        assert abs(by_class.sum() - 1) < 1e-4
        used = {*cls.tolist(), lb.END, lb.UNKNOWN}
        rest = sum(p for c, p in enumerate(by_class) if c not in used)
        assert abs((by_class[cls] * np.exp(share)).sum() + by_class[lb.END] + by_class[lb.UNKNOWN] + rest - 1) < 1e-4
    place = {w: k for k, w in enumerate(count)}
    scores = {r["id"]: r["score"] for r in lb.scored(classed, model, known).collect()}
    for i, t in rows[:20]:
        own = [place[w] for w in words(t)]
        said = [lb.END] * lb.CONTEXT + [int(cls[k]) for k in own] + [lb.END]
        total = sum(float(share[k]) for k in own)
        for at in range(lb.CONTEXT, len(said)):
            expected = sum(model.context[said[at - d]] @ model.matrices[d - 1] for d in range(1, lb.CONTEXT + 1))
            scored = model.target @ expected + model.bias
            total += float(scored[said[at]]) - math.log(np.exp(scored.astype(np.float64)).sum())
        assert abs(total / math.log(10) - scores[i]) < 1e-3 * max(1, abs(scores[i]))


def test_hashes_tell_words_apart():
    texts = ["Ab aB\tab", "", "é É", "x" * 2_500_000 + " y", "ab"]
    raw = "".join(texts).encode()
    ends = np.cumsum([len(t.encode()) for t in texts])
    hashes, sizes = lb.word_hashes(np.frombuffer(raw, np.uint8), np.append(0, ends))
    assert sizes.tolist() == [3, 0, 2, 2, 1]
    assert hashes[0] == hashes[1] == hashes[2] == hashes[-1] and len(set(hashes.tolist())) == 5


def test_empty(spark):
    df = frame(spark, [(1, "a")])
    assert lm_scores(df.limit(0), held_out(df["doc_id"])).count() == 0
    only = lm_scores(df, df["doc_id"] == 1).collect()  # nothing to learn from
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in only] == [(2, 0, 0, 0.0)]


def plain_step(trainer, before, targets):
    """A step of noise-contrastive estimation, token by token."""
    m, drawn = trainer.model, trainer.random.choice(lb.CLASSES, lb.NOISE, p=trainer.noise)
    grad = lb.Model(np.zeros(len(m.flat)))
    likely = lambda x: 1 / (1 + math.exp(-min(30, max(-30, x))))
    for i, target in enumerate(targets):
        expected = sum(m.context[c[i]] @ m.matrices[k] for k, c in enumerate(before))
        back = np.zeros(lb.WIDTH)
        for c, data in [(target, 1), *((d, 0) for d in drawn)]:
            miss = (likely(expected @ m.target[c] + m.bias[c] - trainer.log_noise[c]) - data) / len(targets)
            grad.target[c] += miss * expected
            grad.bias[c] += miss
            back += miss * m.target[c]
        for k, c in enumerate(before):
            grad.context[c[i]] += m.matrices[k] @ back
            grad.matrices[k] += np.outer(m.context[c[i]], back)
    return m.flat - lb.RATE * grad.flat / np.sqrt(trainer.seen + grad.flat**2), grad.flat


def test_step_token_by_token():
    draw = np.random.default_rng(5)
    noise = np.append(np.full(200, 3.0), np.full(lb.CLASSES - 200, 1.0))
    noise /= noise.sum()
    before, targets = draw.integers(0, 12, (lb.CONTEXT, 300)).astype(np.uint8), draw.integers(0, lb.CLASSES, 300).astype(np.uint8)
    plain, fast = (lb.Trainer(lb.Model.begin(noise), noise, 3) for _ in range(2))
    want, grad = plain_step(plain, before, targets)
    fast.step(before, targets)
    sure = np.abs(grad) > 1e-4  # the step divides by the gradient, so where it is nothing but rounding it says nothing
    assert sure.sum() > 2000 and np.abs(fast.model.flat - want)[sure].max() < 1e-3
    assert np.abs(fast.seen - 1e-6 - grad**2).max() < 1e-6


def test_contexts_are_worked_out_once(monkeypatch):
    """a context that stands often is compared with all classes once."""
    draw = np.random.default_rng(6)
    before, targets = draw.integers(0, 5, (lb.CONTEXT, 40_000)).astype(np.uint8), draw.integers(0, lb.CLASSES, 40_000).astype(np.uint8)
    model = lb.Model(draw.normal(0, 0.3, sum(lb.Model.SIZES)))
    rows, whole = [], lb.Model.predicted
    monkeypatch.setattr(lb.Model, "predicted", lambda self, b: rows.append(b.shape[1]) or whole(self, b))
    found = model.logs(before, targets)
    assert sum(rows) == 125
    scores = (whole(model, before) @ model.target.T + model.bias).astype(np.float64)
    want = scores[np.arange(len(targets)), targets] - np.log(np.exp(scores).sum(axis=1))
    assert np.abs(found - want).max() < 1e-4
    assert len(model.logs(before[:, :0], targets[:0])) == 0
