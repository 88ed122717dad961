import base64
import hashlib
import unicodedata
from random import Random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from listwatch.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = Random(2)
    known = [c for c in map(chr, [*range(32, 0x3000), *range(0x4E00, 0x5000), *range(0x1F600, 0x1F640)]) if unicodedata.category(c) != "Cn"]
    mixed = ["".join(rng.choice(rng.choice([known[:95], known[:600], known])) for _ in range(200)) for _ in range(20)]
    return ["", "\x1c a  b \n\n x", "a" * 3000 + "bcbcbc" * 50, "日本語テスト　です", "I'LL don't 'S 123४५ ²", " \t 　x\x85y", "<|endoftext|>",
            "x" * 127 + " " + "y" * 128 + " " + "z" * 129, "ab" * 64, "é" * 65, *mixed]


def test_matches_the_library_and_round_trips(spark, docs, reference):
    some = [r["text"] for r in docs.limit(60).collect()] + texts()
    rows = [(i, t, "x", "y") for i, t in enumerate(some)] + [(None, None, "x", "y"), (3, "dup", None, None), (3, "dup", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string")
    want = []
    for d, t, _, _ in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = bpe.digest(df, PATH, P.PATTERN).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    apart = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN, keep=("ids",)).collect()
    once = bpe.encode_decode(df, PATH, P.PATTERN).collect()
    assert sorted(map(tuple, apart), key=str) == sorted(map(tuple, once), key=str)


def test_long_words_by_the_same_rule():
    tok = bpe.tokenizer(PATH, P.PATTERN)
    for word in ("entreprise", "Donaudampfschifffahrt", "aaaa" * 8, "aab" * 20, "étéété"):
        tok.cache.clear()
        tok._encode_words([word])
        raw = word.encode()
        if raw not in tok.ranks:
            assert np.frombuffer(tok.cache[word], "<u4").tolist() == tok._contract_long(raw)


def test_cache_generations(reference):
    tok = bpe.Tokenizer(PATH, P.PATTERN)
    for t in texts() * 2:
        tok.cache, tok.older = {}, tok.cache
        assert np.frombuffer(tok.encode([t])[0], "<u4").tolist() == reference.encode_ordinary(t)


def test_largest_queries_fit_in_memory(reference):
    """Nothing spills: many words of the greatest length, of a middle one, and a list of ids of several queries."""
    tok, rng = bpe.Tokenizer(PATH, P.PATTERN), Random(4)
    for n, length in ((600, 128), (6000, 40), (25_000, 14)):
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=length)) for _ in range(n)]
        ids = tok.encode([" ".join(words)])[0]
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(" ".join(words))
    some = np.array(rng.choices(range(50_000), k=5000), "<u4")
    assert tok.decode([b"", np.tile(some, 500).tobytes(), some.tobytes()]) == \
        [b"", reference.decode_bytes(some.tolist()) * 500, reference.decode_bytes(some.tolist())]


def test_decode_rejects_unknown_ids():
    with pytest.raises(ValueError):
        bpe.tokenizer(PATH, P.PATTERN).decode([np.array([60000], "<u4").tobytes()])


def test_empty_table(spark):
    assert bpe.digest(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).collect() == []
