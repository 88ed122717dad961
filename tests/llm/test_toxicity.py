import binascii

import numpy as np
from pyspark.sql import functions as F

from listwatch.llm import langid, toxicity

SF = "/root/testdata/sf0.01"


def test_held_out_labels(spark, docs, scratch):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    fold = langid.held_out("doc_id", 3, 1)
    extra = spark.createDataFrame([(None, 1), (5, None), (10**9, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels.select("doc_id", "toxic").unionByName(extra), ~fold, scratch)
    rows = [(9001, None), (9002, ""), (None, "the thing"), (9003, "word " * 60_000), (9004, "!!! ??? ***")]
    more = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, score string")
    out = toxicity.score(docs.select("doc_id", "text", F.lit("s").alias("score")).unionByName(more), model).collect()
    score = {r["doc_id"]: r["score"] for r in out}
    assert len(out) == docs.count() + 5 and all(0 <= s <= 1 for s in score.values())
    held = [(r["doc_id"], r["toxic"]) for r in labels.collect() if binascii.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert np.mean([(score[d] >= 0.7) == y for d, y in held]) > 0.95
    assert max(score[d] for d in (9001, 9002, 9003, 9004)) < 0.7


def test_features_see_obfuscation_and_proximity():
    f = toxicity.Featurizer({"=blorp": 5.0, "zukk": 4.0})
    x = f.features(["you blorp", "8l0rp bl0rp", "b.l.o.r.p", "blooorp", "zukkers", "BLORP!!!", "word", None, "", "you moron", "m0ron"])
    col = {n: x[:, i] for i, n in enumerate(toxicity.FEATURES)}
    assert col["near_second_person"][0] == 1 and col["word_density"][0] == 50
    assert all(col["hidden_density"][1:4] > 0) and col["stem_density"][4] == 100
    assert col["capital_rate"][5] == 1 and col["exclaim_rate"][5] == 3 and not x[7:9].any()
    assert col["insult_density"][9] == 50 and col["near_second_person"][9] == 1 and col["hidden_density"][10] == 100


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(0)
    raw, y = rng.integers(0, 12, 200).astype(float), rng.integers(0, 2, 200).astype(float)
    points, fitted = toxicity.isotonic(raw, y)
    sums = [(y[raw == p].sum(), (raw == p).sum()) for p in points]

    def mean(i, j):
        return sum(s for s, _ in sums[i:j + 1]) / sum(n for _, n in sums[i:j + 1])

    want = [max(min(mean(i, j) for j in range(k, len(points))) for i in range(k + 1)) for k in range(len(points))]
    assert np.allclose(fitted, want)


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    model = toxicity.boost(x, y)
    assert np.mean((model.margin(x) > 0) == (y > 0)) > 0.97


def test_without_labels_of_both_kinds(spark, scratch):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(6)], "doc_id long, toxic int")
    for lab in (labels, labels.where("false")):
        model = toxicity.fit(docs, lab, F.lit(True), type(scratch)(spark, "t"))
        assert {r["score"] for r in toxicity.score(docs, model).collect()} == {0.0}
    assert toxicity.score(docs.where("false"), model).collect() == []
