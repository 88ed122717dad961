import binascii

import numpy as np

from listwatch.llm import langid


def test_held_out_accuracy_and_edges(spark, docs):
    train = docs.where(~langid.held_out())
    net = langid.fit(train, per_lang=100)
    assert net.langs == ["de", "en", "es", "fr"]
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    rows += [(None, "the of and thing with that", "en"), (9001, None, "en"), (9002, "", None), (9003, "12 34 !!", "de"), (9004, "é" * 70_000, "fr")]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    out = langid.predict(df, net, keep=("doc_id",)).collect()
    assert len(out) == len(rows)
    got = {r["doc_id"]: r for r in out}
    held = [(d, lang) for d, _, lang in rows if d is not None and d < 9000 and binascii.crc32(str(d).encode()) % 5 == 0]
    assert np.mean([got[d]["lang_pred"] == lang for d, lang in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out)
    assert [got[d]["lang_pred"] for d in (9001, 9002, 9003)] == ["und"] * 3 and got[9004]["lang_pred"] in net.langs
    flags = {r["doc_id"]: r["h"] for r in df.select("doc_id", langid.held_out().alias("h")).collect()}
    assert flags[None] is False and all(flags[d] == (binascii.crc32(str(d).encode()) % 5 == 0) for d in flags if d is not None)


def test_tables_give_the_networks_responses():
    net = langid.train(["the cat and the dog", "der hund und die katze"], ["en", "de"])
    x = np.concatenate([langid.windows(langid.prepare(t)) for t in ("Der Hund! " * 60, "a cat", "é" * 300)])
    want = np.concatenate([net.responses(x, w).max(axis=1) for w in langid.WIDTHS], axis=1)
    assert np.abs(langid.Predictor(net).pooled(x) - want).max() < 0.01


def test_all_windows_count():
    net = langid.train(["the cat and the dog with that"] * 3, ["en"] * 3)
    net2 = langid.train(["the cat and the dog with that", "der hund und die katze nicht"], ["en", "de"])
    text = "the cat and the dog with that " * 40
    mixed = text + "der hund und die katze nicht " * 400
    assert langid.Predictor(net).predict([text]) == (["en"], [1.0])
    assert langid.Predictor(net2).predict([text, mixed])[0] == ["en", "de"]


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    net = langid.fit(df)
    assert [(r["lang_pred"], r["score"]) for r in langid.predict(df, net).collect()] == [("und", 0.0)]
    assert langid.predict(df.where("false"), net).collect() == []
