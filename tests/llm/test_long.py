"""A very long text, beside null and empty ones, through every operator that works on single texts."""

import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from sightline.llm import pii
from sightline.llm.bpe import bpe_encode
from sightline.llm.compression_quality import fit, quality_scores
from sightline.llm.decontaminate import find_leaks
from sightline.llm.license_scan import license_scan
from sightline.llm.near_duplicates import near_duplicates
from sightline.llm.perplexity import perplexity_quality
from sightline.llm.secrets import secret_spans
from sightline.llm.token_counts import token_counts

from .test_rules import plain_all_secrets, plain_rules
from .test_texts import plain_license, plain_pii

ITEM = "which of the seven rivers in the northern valley freezes first in a cold december"


@pytest.fixture(scope="module")
def text():
    rng = random.Random(77)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    special = ["MIT license", "someone@mail.org", "+1 (269) 555-3296", "password=hunter2hunter2", "9fK3xQ7LmZ2pR8vT5wYb1N", "été", "🙂", "GNU General Public License version 3"]
    parts = [rng.choice(words) if rng.random() < 0.999 else rng.choice(special) for _ in range(220_000)]
    return " ".join(parts) + "\n" + ITEM.replace("northern", "sunlit") + " end"


@pytest.fixture(scope="module")
def docs(spark, text):
    assert len(text) > 1 << 20
    return spark.createDataFrame([(1, text, "en"), (2, None, "en"), (3, "", None), (None, "short text", "en")], "doc_id long, text string, lang string")


def of(df):
    return {r.id: r for r in df.collect()}


def test_license(docs, text):
    r = of(license_scan(docs))
    assert (r[1].n_words, r[1].n_base, r[1].first_word, r[1].last_word, r[1].base_labels) == plain_license(text) and len(r) == 4 and len(r[1].detections) > 20


def test_personal_data(docs, text):
    r = of(pii.pii_spans(docs))
    assert [(s.start, s.kind_order, s.kind, s.end) for s in r[1].base] == plain_pii(text) and len(r[1].base) > 20 and not r[2].spans


def test_secrets(docs, text):
    r = {x.doc_id: x for x in secret_spans(docs).collect()}
    assert [(s.start, s.kind_order, s.kind, s.end) for s in r[1].spans] == plain_all_secrets(text) and len(r) == 4


def test_quality(docs):
    r = of(quality_scores(docs, fit([b"good words of text " * 9, b"bad |# text $ " * 9, b"other good words " * 8, b"%% bad |# " * 9], [1, 0, 1, 0])))
    assert len(r) == 4 and all(0 <= x.score <= 1 for x in r.values()) and r[2].score == r[3].score


def test_perplexity(docs, text):
    r = of(perplexity_quality(docs))
    assert (r[1].n_words, r[1].word_chars, r[1].n_symbols, r[1].n_dup_lines, r[1].n_repeat_words) == plain_rules(text)
    assert r[2].perplexity == r[3].perplexity == 1 and not r[2].kept


def test_tokens(docs, text):
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert of(token_counts(docs, P.path("byte_bpe_50k.json")))[1].n_tokens == len(own.encode(text, add_special_tokens=False).ids)
    r = of(bpe_encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN))
    assert bytes(r[1].decoded).decode() == text and not r[2].token_ids


def test_leaks_and_copies(spark, docs):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert [(r.id, r.item_id) for r in find_leaks(docs, items).collect()] == [(1, 1)]
    both = docs.unionAll(docs.where("doc_id = 1").selectExpr("9L", "text || ' more'", "lang"))
    r = of(near_duplicates(both))
    assert r[9].class_id == r[1].class_id == 1 and r[1].n_links == 1 and r[2].class_id == 2
