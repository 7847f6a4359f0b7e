import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from sightline.llm.bpe import TreeCodec, bpe_encode, codec
from sightline.llm.queries import op5_bpe, op7_token_counts
from sightline.llm.token_counts import NO_RANK, PairTable, merger, token_counts

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def hard_texts():
    rng = random.Random(5)
    pools = ["the and of tion ", "éèê ß ñ", "  \n\t\r\x0b\x1c\x85\xa0　", "'s't're'll !?,.;:", "0123456789", "漢字かな交じり文、。", "🙂👩‍👩‍👧", "a", "|#$%", "<|endoftext|>"]
    out = ["", " ", "a", "<|endoftext|>", "x<|endoftext|> y<|endoftext|>", "a" * 5000, "!" * 3001, " " * 700 + "x", "\n\n  \n x", "it's we'll 'S o'clock"]
    for n in (3, 30, 300, 3000, 9000):
        for _ in range(12):
            out.append("".join(rng.choice(rng.choice(pools)) for _ in range(n)))
    out.append("".join(rng.choice("abcdefghij") for _ in range(6000)))
    out.append("the cat's 3 hats, " * 900)
    return out


def test_tree_encoding_equals_library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for leaf in (1, 7, 64, 2048):
        code = codec(RANKS, P.PATTERN, leaf)
        for text in hard_texts():
            if leaf == 1 and len(text) > 400:
                continue
            ids = code.encode(text)
            assert ids == own.encode_ordinary(text)
            assert code.decode(ids) == text.encode()


def test_counts_equal_library():
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = hard_texts()
    want = [len(x.ids) for x in own.encode_batch(texts, add_special_tokens=False)]
    assert merger(P.path("byte_bpe_50k.json")).count(texts) == want


def odd_words(rng, n):
    pools = ["abc", "etaoinshrdlu", "0123456789", "aA", "的是不éß", "==--__", "ab", "a", "abcdefghijklmnopqrstuvwxyz"]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(1, 400))) for pool in (rng.choice(pools) for _ in range(n))]


def test_joins_within_words():
    """Words cut at every few bytes and joined again, by the library's ids."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codes = [TreeCodec(ranks, P.PATTERN, leaf, word_leaf) for leaf, word_leaf in ((1, 1), (7, 3), (64, 16))]
    for text in odd_words(random.Random(3), 300):
        want = own.encode_ordinary(text)
        assert all(code.encode(text) == want for code in codes)


def test_other_patterns():
    """Stable cuts are those of one pattern; any other is encoded rightly without them."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    for pattern in (r"\w+|\W+", r"[a-z .,]+|[^a-z .,]+", r"(?s:.)", r"\S+\s*|\s+"):
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        code = TreeCodec(ranks, pattern, 16, 8)
        for text in hard_texts()[:40]:
            assert code.encode(text[:800]) == own.encode_ordinary(text[:800])


def test_very_long_words():
    """Words of a megabyte: by round trip and, for their beginnings, by the libraries."""
    rng = random.Random(4)
    own, ranks = Tokenizer.from_file(P.path("byte_bpe_50k.json")), {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    code, count = codec(RANKS, P.PATTERN), merger(P.path("byte_bpe_50k.json")).count
    for pool in ("abcdefghijklmnopqrstuvwxyz", "a", "!"):
        word = "".join(rng.choice(pool) for _ in range(1 << 20))
        ids = code.encode(word)
        begin = library.encode_ordinary(word[:20000])
        assert code.decode(ids) == word.encode() and ids[: len(begin) // 2] == begin[: len(begin) // 2]
        assert count([word])[0] > 0 and count([word[:20000]]) == [len(own.encode(word[:20000], add_special_tokens=False).ids)]


def test_counts_of_joined_words():
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    words, count = odd_words(random.Random(5), 600), merger(P.path("byte_bpe_50k.json"))
    want = [len(x.ids) for x in own.encode_batch(words, add_special_tokens=False)]
    assert count.count(words) == want and [count.count_long(w.encode()) for w in words] == want


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "a b", "y"), (2, "", "z"), (1, None, "x")], "doc_id long, text string, n_tokens string")
    got = token_counts(df, P.path("byte_bpe_50k.json")).collect()
    assert sorted((r.id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == [(0, 3, 2, False), (1, 0, 0, False), (1, 0, 0, False), (2, 0, 0, False)]
    coded = bpe_encode(df, RANKS, P.PATTERN).collect()
    assert sorted((r.id or 0, len(r.token_ids), bytes(r.decoded)) for r in coded) == [(0, 2, b"a b"), (1, 0, b""), (1, 0, b""), (2, 0, b"")]
    assert token_counts(df.limit(0), P.path("byte_bpe_50k.json")).count() == bpe_encode(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_queries(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = op5_bpe(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = own.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())
    other = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for r in op7_token_counts(spark, sf).collect():
        assert r.n_tokens == len(other.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert r.n_bytes == len(docs[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 1024)


def test_pairs_of_large_vocabularies():
    """Tables grow with the merges: every pair is found, others are not."""
    rng = np.random.default_rng(4)
    for n in (1, 60_000, 300_000):
        pairs = np.unique(rng.integers(0, 400_000, (n + n // 10 + 2, 2)), axis=0)[:n]
        rng.shuffle(pairs)
        table = PairTable(pairs[:, 0].astype(np.int32), pairs[:, 1].astype(np.int32), np.arange(n, dtype=np.int32), 400_000)
        assert table.ranks(pairs[:, 0].astype(np.int32), pairs[:, 1].astype(np.int32)).tolist() == list(range(n))
        other = np.full(5, 400_001, np.int32)
        assert (table.ranks(other, other) == NO_RANK).all()
