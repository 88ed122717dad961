import duckdb
import pytest
from pyspark.sql import functions as F

from listwatch.llm import mixing

POWERS = {"source": 0.8, "lang": 0.6, "topic": 0.9}


def fixture(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    return rows + [(None, "some words", "en", "src1"), (9001, None, None, None), (9002, "", "en", None), (9003, "w " * 30_000, None, "src2"),
                   (9004, "rare source", "xx", "new"), (9004, "rare source", "xx", "new"), (9005, " \n\t", "zz", "blank")]


def make(spark, rows):
    return spark.createDataFrame([(*r, 0.5, "r", 1.0) for r in rows],
                                 "doc_id long, text string, lang string, source string, probability double, row string, weight double")


def test_against_sql(spark, docs, scratch):
    rows = fixture(docs)
    df = make(spark, rows)
    out = mixing.mix(df, POWERS, scratch)
    got = [(r["doc_id"], r["source"], r["lang"], r["topic"], r["n_tokens"], r["probability"], r["kept"]) for r in out.collect()]
    con = duckdb.connect()
    documents = df.select("doc_id", "text", "lang", "source").toPandas()  # noqa: F841
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    want = con.execute(mixing.oracle(POWERS)).fetchall()
    key = lambda r: str((*r[:5], r[6]))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [(*r[:5], r[6]) for r in got] == [(*r[:5], r[6]) for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], abs=1e-6)


def test_margins_fit(spark, docs, scratch):
    df = make(spark, fixture(docs)[:1000])
    out = mixing.mix(df, POWERS, scratch).drop("row").cache()
    total = out.agg(F.sum(F.col("probability") * F.col("n_tokens"))).first()[0]
    for m, power in POWERS.items():
        actual = {r[0]: r[1] for r in out.groupBy(m).agg(F.sum("n_tokens")).collect() if r[1]}
        share = {r[0]: r[1] / total for r in out.groupBy(m).agg(F.sum(F.col("probability") * F.col("n_tokens"))).collect()}
        goal = {k: v ** power for k, v in actual.items()}
        for k, v in goal.items():
            assert share[k] == pytest.approx(v / sum(goal.values()), abs=1e-6)
    assert out.agg(F.max("probability")).first()[0] == pytest.approx(1.0)
    out.unpersist()


def test_given_targets_and_fraction(spark, docs, scratch):
    df = make(spark, fixture(docs))
    goal = spark.createDataFrame([("en", 0.5), ("de", 0.3), ("nobody", 0.2)], "lang string, target double")
    out = mixing.mix(df, {"lang": 1.0}, scratch, fraction=0.1, targets={"lang": goal}).drop("row").collect()
    total = sum(r["n_tokens"] for r in out)
    expected = sum(r["probability"] * r["n_tokens"] for r in out)
    assert expected == pytest.approx(0.1 * total, rel=1e-6)
    named = {k: sum(r["probability"] * r["n_tokens"] for r in out if r["lang"] == k) for k in ("en", "de")}
    assert named["en"] / named["de"] == pytest.approx(5 / 3)
    # languages without a target keep their share
    assert sum(r["probability"] * r["n_tokens"] for r in out if r["lang"] == "fr") / expected == pytest.approx(
        sum(r["n_tokens"] for r in out if r["lang"] == "fr") / total)


def test_native_plan_and_empty(spark, docs, scratch):
    out = mixing.mix(make(spark, fixture(docs)[:300]), {"lang": 0.5}, scratch)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian"))
    assert mixing.mix(make(spark, []), POWERS, type(scratch)(spark, "none")).collect() == []
