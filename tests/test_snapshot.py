"""Listing state folds (M1-M7, J3, J6, U1, U2) and prices."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from listwatch.operators import prices, snapshot
from tests.conftest import rows

OLD = "url string, first_seen_at timestamp, price_raw string, price bigint, seller_type string, last_seen_at timestamp"
BATCH = "url string, first_seen_at timestamp, price_raw string, price bigint, seller_type string, last_seen_at timestamp, seq int"


def ts(s):
    import datetime as dt
    return dt.datetime.fromisoformat(s)


def test_in_batch_duplicates_m1(spark):
    old = spark.createDataFrame([], OLD)
    batch = spark.createDataFrame([("u", ts("2024-01-01"), "a", 1, None, ts("2024-01-01"), 1),
                                   ("u", ts("2024-01-02"), "b", 2, None, ts("2024-01-02"), 2)], BATCH)
    out = snapshot.upsert(old, batch, F.col("seq")).collect()[0]
    assert out["price_raw"] == "b" and out["first_seen_at"] == ts("2024-01-01")


def test_stored_first_seen_kept_and_null_filled_q17(spark):
    old = spark.createDataFrame([("u", ts("2023-01-01"), "a", 1, None, ts("2023-01-01")),
                                 ("v", None, "a", 1, None, ts("2023-01-01"))], OLD)
    batch = spark.createDataFrame([("u", ts("2024-01-01"), "b", 2, "agency", ts("2024-01-01"), 1),
                                   ("v", ts("2024-01-05"), "c", 3, None, ts("2024-01-05"), 2)], BATCH)
    out = {r["url"]: r for r in snapshot.upsert(old, batch, F.col("seq")).collect()}
    assert out["u"]["first_seen_at"] == ts("2023-01-01") and out["u"]["seller_type"] == "agency"
    assert out["v"]["first_seen_at"] == ts("2024-01-05")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 9)), min_size=1, max_size=25), st.integers(0, 25))
def test_upsert_is_split_invariant(spark, events, cut):
    """Upserting a batch in two parts equals upserting it at once."""
    data = [(f"u{u}", ts(f"2024-01-{d + 1:02d}"), f"p{i}", i, None, ts(f"2024-01-{d + 1:02d}"), i)
            for i, (u, d) in enumerate(events)]
    empty = spark.createDataFrame([], OLD)
    full = snapshot.upsert(empty, spark.createDataFrame(data, BATCH), F.col("seq"))
    first = snapshot.upsert(empty, spark.createDataFrame(data[:cut], BATCH), F.col("seq"))
    second = snapshot.upsert(first, spark.createDataFrame(data[cut:], BATCH), F.col("seq"))
    assert rows(full) == rows(second)


def test_touch_keeps_good_brand_q11(spark):
    old = spark.createDataFrame([("u", "B", "m", "100", ts("2024-01-01"), ts("2024-01-01"))],
                                "url string, brand string, model string, price_raw string, first_seen_at timestamp, "
                                "last_seen_at timestamp")
    t = spark.createDataFrame([("u", "Unknown", "", "", ts("2024-02-01"), 1), ("n", "C", "x", "5", ts("2024-02-02"), 2)],
                              "url string, brand string, model string, price_raw string, seen_at timestamp, seq int")
    out = {r["url"]: r for r in snapshot.touch(old, t, F.col("seq")).collect()}
    assert (out["u"]["brand"], out["u"]["model"], out["u"]["price_raw"]) == ("B", "m", "100")
    assert out["u"]["last_seen_at"] == ts("2024-02-01")
    assert out["n"]["inserted"] and out["n"]["brand"] == "C"


def test_expiry_keeps_null_m6(spark):
    df = spark.createDataFrame([("a", ts("2024-01-01")), ("b", None), ("c", ts("2024-01-20"))],
                               "url string, last_seen_at timestamp")
    kept, removed = snapshot.expire_by_age(df, F.lit("2024-01-21").cast("timestamp"), 10)
    assert rows(kept, "url") == [("b",), ("c",)] and rows(removed, "url") == [("a",)]


def test_cohort_cleanup_j6(spark):
    snap = spark.createDataFrame([("1", "A", "x"), ("2", "A", "x"), ("3", "B", "y"), ("4", "Unknown", "")],
                                 "url string, brand string, model string")
    seen = spark.createDataFrame([("1", "A", "x"), ("9", "Unknown", "")], "url string, brand string, model string")
    out = snapshot.cohort_cleanup(snap, seen)
    kept = snap.join(out.select("url"), "url", "left_anti")
    assert rows(out, "url") == [("2",)]
    assert sorted(rows(out, "url") + rows(kept, "url")) == rows(snap, "url")


def test_first_and_last_wins_u1_u2(spark):
    items = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "a", "y"), (1, 2, "b", "z")],
                                  "page_id long, pos int, url string, v string")
    assert rows(snapshot.first_wins(items, ["page_id", "url"]), "url", "v") == [("a", "x"), ("b", "z")]
    lw = snapshot.last_wins(items.drop("page_id"), "url")
    assert rows(lw, "url", "pos", "v") == [("a", 0, "y"), ("b", 2, "z")]


def test_price_rules_q2_q12(spark):
    s = spark.createDataFrame([("u", ts("2024-01-01"), "₪ 1,234", 1), ("u", ts("2024-01-02"), "1234", 2),
                               ("u", ts("2024-01-03"), "", 3), ("u", ts("2024-01-04"), "1300", 4)],
                              "url string, seen_at timestamp, price_raw string, seq int")
    log = prices.price_change_log(s, ["seen_at", "seq"], F.date_trunc("day", "seen_at"))
    assert rows(log, "old_price", "new_price", "direction") == [("1234", "1300", "up")]


def test_diff_twice_is_empty_m12(spark):
    from listwatch.operators import diff
    m = spark.createDataFrame([(1, "a", "₪ 10", ts("2024-01-01")), (1, "b", "5", ts("2024-01-02")),
                               (2, "a", "₪ 10", ts("2024-01-01"))],
                              "user_id long, url string, price_raw string, last_seen_at timestamp")
    empty = spark.createDataFrame([], "user_id long, url string, last_price string, last_seen_at timestamp")
    first = diff.diff_items(m, empty)
    assert rows(first, "change_type") == [("new",)] * 3
    state = diff.next_state(m, empty)
    again = diff.diff_items(m, state).filter(F.col("change_type").isNotNull())
    assert again.count() == 0


def test_forget_items_q7(spark):
    from listwatch.operators import diff
    state = spark.createDataFrame([(1, "a", "1", None), (2, "b", "2", None)],
                                  "user_id long, url string, last_price string, last_seen_at timestamp")
    subs = spark.createDataFrame([(2, "B", "")], "user_id long, brand string, model string")
    assert rows(diff.forget_items(state, subs), "user_id") == [(2,)]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("u", ts("2023-01-01"), "a", 1, None, ts("2023-01-01"))], OLD)
    batch = spark.createDataFrame([("u", ts("2024-01-01"), "b", 2, None, ts("2024-01-01"), 1),
                                   ("v", ts("2024-01-02"), "c", 3, None, ts("2024-01-02"), 2)], BATCH)
    once = snapshot.upsert(old, batch, F.col("seq"))
    twice = snapshot.upsert(once, batch, F.col("seq"))
    assert rows(once) == rows(twice)


def test_diff_and_next_equals_separate_steps(spark):
    from listwatch.operators import diff
    m = spark.createDataFrame([(1, "a", "11", ts("2024-02-01")), (1, "b", "", ts("2024-02-02")),
                               (2, "c", "7", ts("2024-02-03"))],
                              "user_id long, url string, price_raw string, last_seen_at timestamp")
    st = spark.createDataFrame([(1, "a", "10", ts("2024-01-01")), (1, "b", "5", ts("2024-01-01")),
                                (3, "z", "1", ts("2024-01-01"))],
                               "user_id long, url string, last_price string, last_seen_at timestamp")
    both = diff.diff_and_next(m, st)
    changes = rows(both.filter(F.col("change_type").isNotNull()), "user_id", "url", "change_type")
    assert changes == rows(diff.diff_items(m, st).filter(F.col("change_type").isNotNull()),
                           "user_id", "url", "change_type")
    nxt = rows(both.select("user_id", "url", "next_price", "next_seen_at"))
    assert nxt == rows(diff.next_state(m, st))
