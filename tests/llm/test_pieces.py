import hashlib
from random import Random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece

from listwatch.llm import pieces

MODEL = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts():
    rng = Random(3)
    mixed = ["".join(chr(rng.choice([32, 32, rng.randrange(33, 127), rng.randrange(0xC0, 0x250), rng.randrange(0x3040, 0x30FF)]))
                     for _ in range(150)) for _ in range(20)]
    return ["", " ", "  a", "a  b   ", "\n\t x", "日本語 テスト", "▁a ▁▁ b", "<0xFC> </s> <unk> <s>", "a" * 5000, "ab" * 200 + "c" * 60,
            "😀é\x00z", "x" * 300 + " " * 70 + "y", "́a", " \n", "word " * 30000, *mixed]


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def test_matches_the_library(spark, docs, library):
    some = [r["text"] for r in docs.limit(60).collect()] + texts()
    rows = [(i, t, "x") for i, t in enumerate(some)] + [(None, None, "x"), (3, "dup", None), (3, "dup", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    want = []
    for d, t, _ in rows:
        ids = library.encode(t or "", add_eos=True)
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    got = pieces.digest(df, MODEL)
    assert got.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == sorted(want, key=str)
    apart = pieces.decode(pieces.encode(df, MODEL), MODEL).collect()
    assert sorted(map(tuple, apart), key=str) == sorted(((d, library.decode(library.encode(t or ""))) for d, t, _ in rows), key=str)


def test_spans_are_those_of_the_library(library):
    p = pieces.processor(MODEL)
    for t in texts():
        spans = np.frombuffer(p.encode([t])[0][1], "<u4").reshape(-1, 2).tolist()
        assert spans[:-1] == [[x.begin, x.end] for x in library.encode(t, return_type="proto").pieces]
        assert spans[-1] == [len(t.encode())] * 2
        assert b"".join(t.encode()[a:b] for a, b in spans) == t.encode()


def test_both_contractions_agree():
    p = pieces.processor(MODEL)
    some = ["entreprise", "▁Donaudampfschiff", "a" * 40, "▁" * 33, "▁" * 17 + "aab" * 8, "éñß" * 9, "x", "\x00", "a😀b"]
    for t, got in zip(some, p._contract_block(some)):
        assert got == p._spell(t, p._contract_long(p._symbols(t).tolist()))


def test_cache_generations(library):
    p = pieces.Processor(MODEL)
    for t in texts() * 2:
        p.cache, p.older = {}, p.cache
        assert np.frombuffer(p.encode([t])[0][0], "<u4").tolist() == library.encode(t, add_eos=True)


def test_decodes_any_ids(library):
    p, rng = pieces.processor(MODEL), Random(5)
    for _ in range(200):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(4)]) for _ in range(rng.randrange(40))]
        assert p.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids)
    with pytest.raises(ValueError):
        p.decode(np.array([32000], "<u4").tobytes())


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("options", [{}, {"add_dummy_prefix": True, "escape_whitespaces": True},
                                     {"add_dummy_prefix": True, "remove_extra_whitespaces": True, "escape_whitespaces": True}])
def test_normalises_by_compiled_maps(rule, options):
    """The given model's map is empty; these maps are those that the library compiles."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, **options)
    model = pb.ModelProto()
    model.ParseFromString(library.serialized_model_proto())
    ours = pieces.Normaliser(model.normalizer_spec)
    assert bool(ours.map) == (rule != "identity")
    for t in [*texts()[:-21], "ｱｲｳ ﾊﾞ ① ﬁ Å Å  x　y ", "   ", "​ a", "Ǆ İ ß ﷺ", *texts()[-20:]]:
        want, offsets = library.normalize(t, with_offsets=True)
        shown, source = ours(t)
        starts = np.cumsum([0, *(len(c.encode()) for c in shown.decode())])
        assert (shown.decode(), source[starts].tolist()) == (want, [len(t[:o].encode()) for o in offsets])


def test_malformed_text_and_empty_table(spark, library):
    df = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text")
    row = pieces.digest(df, MODEL).first()
    assert row["decoded_sha256"] == sha("a�b")
    assert pieces.digest(spark.createDataFrame([], "doc_id long, text string"), MODEL).collect() == []
