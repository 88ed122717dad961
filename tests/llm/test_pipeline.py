"""The whole pipeline on a small fixture against a plain Python version of its stages."""

import base64
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from listwatch.llm import langid, mixing, simhash
from tests.llm.test_simhash import brute_components

PLANTED = re.compile(r'AKIA[0-9A-Z]{16}|(?<=password=)[0-9a-f]{16,}|(?<=token = ")[0-9a-f]{40}')
NAMES = [n for n, _ in corpus_pipeline.STAGES]


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    rows = [(*r, "extra", 0.25) for r in docs.where("doc_id < 300").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rows += [(4000 + i, f"the thing and of that with the {'reading on ' * (i + 3)} AKIA{i:016d}"[:400 + i], "en", "src0", 9, None, None) for i in range(30)]
    rows += [(5000, None, "en", "src1", None, None, None), (5001, "", "en", "src1", 0, None, None), (5002, "12 34", None, None, 5, None, None),
             (None, "the of and thing that with a null id here", "en", "src2", 41, None, None), (5003, rows[5][1], "en", "src3", 1, None, None),
             rows[7], rows[7], (5004, "é la les des une " * 20_000, "fr", "src4", 340_000, None, None)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, row double").write.parquet(
        f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("stages")
    tables = [spark.read.parquet(f"{folder}/documents.parquet")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], folder).write.parquet(f"{out}/{i}")
        tables.append(spark.read.parquet(f"{out}/{i}"))
    return [(t.columns, [tuple(r) for r in t.collect()]) for t in tables]


def test_names_and_columns(stages):
    assert NAMES == ["language_id", "near_duplicates", "secrets", "mix", "tokenize"]
    assert all(columns == stages[0][0] for columns, _ in stages[:-1])


def test_language_stage(spark, folder, stages):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = langid.Predictor(langid.fit(docs))
    rows = stages[0][1]
    lang, score = model.predict([r[1] for r in rows])
    want = [r for r, a, s in zip(rows, lang, score) if a != "und" and s >= corpus_pipeline.LEAST_SCORE]
    assert sorted(stages[1][1], key=str) == sorted(want, key=str)
    assert {5000, 5001, 5002} == {r[0] for r in rows} - {r[0] for r in want}  # clean documents stay


def test_near_duplicates_broadcast_no_index(spark, folder, monkeypatch):
    plans, links = [], simhash.links

    def seen(*args):
        plans.append((out := links(*args))._jdf.queryExecution().sparkPlan().toString())
        return out

    monkeypatch.setattr(simhash, "links", seen)
    corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert plans and "SortMergeJoin" in plans[0]
    assert not [x for x in plans[0].split("\n") if "BroadcastHashJoin" in x and ", Inner" in x]


def test_near_duplicates_stage(stages):
    rows = stages[1][1]
    groups = {}
    for r, (_, fp, c) in zip(rows, brute_components([r[:2] for r in rows])):
        groups.setdefault(fp if c is None else c, []).append(r)
    kept = stages[2][1]
    assert len(kept) == len(groups) and set(kept) <= set(rows)
    for members in groups.values():
        ids = [r[0] for r in members if r[0] is not None]
        assert len([r for r in kept if r in members and (not ids or r[0] == min(ids))]) == 1


def test_secrets_stage(stages):
    want = [(r[0], PLANTED.sub("[SECRET]", r[1]), *r[2:4], len(PLANTED.sub("[SECRET]", r[1])) if PLANTED.search(r[1]) else r[4], *r[5:])
            for r in stages[2][1]]
    assert sorted(stages[3][1], key=str) == sorted(want, key=str)


def test_mix_stage(spark, stages, scratch):
    columns, rows = stages[3]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, row double")
    decided = mixing.mix(df, corpus_pipeline.MIX, scratch)
    kept = sorted((r["doc_id"] for r in decided.where("kept = 1").collect()), key=str)
    assert sorted((r[0] for r in stages[4][1]), key=str) == kept and 0.3 * len(rows) < len(kept) <= len(rows)
    assert set(stages[4][1]) <= set(rows)


def test_tokenize_stage(stages):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {r[0]: r for r in stages[4][1]}
    assert len(stages[5][1]) == len(stages[4][1])
    for d, lang, source, n, ids, text in stages[5][1]:
        assert (lang, source, text) == (want[d][2], want[d][3], want[d][1])
        ids = np.frombuffer(bytes(ids), "<u4").tolist()
        assert ids == reference.encode_ordinary(text) and n == len(ids)


def test_run_gives_the_last_stages_rows(spark, folder, stages):
    got = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.run(spark, folder).collect() if r["doc_id"] is not None)
    assert got == sorted((r[0], r[5]) for r in stages[5][1] if r[0] is not None)
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_documents(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_names_that_clash(spark, folder):
    """Extra columns may be called anything that the stages use themselves, or hold dots and backticks."""
    some = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").where("doc_id < 60 OR doc_id >= 4000")
    extra = ["a.b", "x`y", "_nth", "_key", "_id", "row", "fp", "topic", "nth", "key1", "kept", "ids", "lang_pred", "tokens", "root", "u"]
    docs = some.select("*", *[F.lit(i).alias(c) for i, c in enumerate(extra)])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "tokenize":
            assert out.columns == docs.columns, name
            for r in out.limit(3).collect():
                assert list(r)[5:] == list(range(len(extra))), name
        assert out.count() > 0, name


def test_least_score_falls_with_more_languages():
    assert [corpus_pipeline.least_score(n) for n in (0, 1, 4)] == [0.35] * 3 and round(corpus_pipeline.least_score(100), 6) == 0.014
