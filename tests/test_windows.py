"""Window operators (W4, W7, W8) and the split windows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from listwatch.operators import windows
from tests.conftest import rows


def test_interleave_w8(spark):
    a = [("A", r, windows.interleave_slot(F.lit(r), True, 3, 1)) for r in range(1, 5)]
    b = [("B", r, windows.interleave_slot(F.lit(r), False, 3, 1)) for r in range(1, 3)]
    df = spark.range(1)
    slots = df.select(*[c.alias(f"{q}{r}") for q, r, c in a + b]).collect()[0].asDict()
    assert [k for k, _ in sorted(slots.items(), key=lambda kv: kv[1])] == ["A1", "A2", "A3", "B1", "A4", "B2"]


def test_hysteresis_w7(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([3, 12, 9, 7, 6, 9])], "k long, i long, q long")
    out = windows.hysteresis(df, ["k"], ["i"], F.col("q"), 12, 6, F.floor(F.col("i") / 2))
    assert [r["flag"] for r in out.orderBy("i").collect()] == [False, True, True, True, False, False]


def test_skip_ranges_w4(spark):
    df = spark.createDataFrame([(1, i, i in (2, 3, 4, 7, 9, 10)) for i in range(1, 12)], "p long, idx long, s boolean")
    out = rows(windows.skip_ranges(df, ["p"], "idx", "s"), "start_idx", "end_idx", "n_skipped")
    assert out == [(2, 4, 3), (7, 7, 1), (9, 10, 2)]


def test_split_windows_equal_plain_windows(spark):
    rnd = random.Random(3)
    data = [(rnd.randrange(3), i, rnd.choice([None, rnd.randrange(100)]), rnd.randrange(50)) for i in range(400)]
    df = spark.createDataFrame(data, "k long, i long, v long, t long")
    plain = Window.partitionBy("k").orderBy("t", "i")
    want_prev = {r["i"]: r["p"] for r in df.select(
        "i", F.last("v", ignorenulls=True).over(plain.rowsBetween(Window.unboundedPreceding, -1)).alias("p")).collect()}
    got = windows.carry_last(df, ["k"], ["t", "i"], F.col("v"), F.floor(F.col("t") / 7), "p")
    assert {r["i"]: r["p"] for r in got.collect()} == want_prev
    want_next = {r["i"]: r["n"] for r in df.select(
        "i", F.first("v", ignorenulls=True).over(plain.rowsBetween(1, Window.unboundedFollowing)).alias("n")).collect()}
    got = windows.carry_last(df, ["k"], ["t", "i"], F.col("v"), F.floor(F.col("t") / 7), "n", reverse=True)
    assert {r["i"]: r["n"] for r in got.collect()} == want_next
    want_rn = {r["i"]: r["rn"] for r in df.select("i", F.row_number().over(plain).alias("rn")).collect()}
    got = windows.row_number_split(df, ["k"], ["t", "i"], F.floor(F.col("t") / 7))
    assert {r["i"]: r["rn"] for r in got.collect()} == want_rn


def test_null_keys_and_times_keep_every_row(spark):
    df = spark.createDataFrame([(1, "a", 1), (None, "b", 1), (None, "c", 2), (2, "d", None), (2, "e", 3)],
                               "k long, url string, t int")
    numbered = windows.row_number_split(df, ["k"], ["t", "url"], F.floor(F.col("t") / 2), "n")
    assert sorted(map(str, rows(numbered, "url", "n"))) == sorted(map(str, [("a", 1), ("b", 1), ("c", 2), ("d", 1), ("e", 2)]))
    carried = windows.carry_last(df, ["k"], ["t", "url"], F.col("url"), F.floor(F.col("t") / 2), "prev")
    assert {r["url"]: r["prev"] for r in carried.collect()} == {"a": None, "b": None, "c": "b", "d": None, "e": "d"}
    top = windows.top_k_per_group(df, ["k"], [F.col("url")], 1)
    assert sorted(map(str, rows(top, "url", "n_total"))) == sorted(map(str, [("a", 1), ("b", 2), ("d", 2)]))
