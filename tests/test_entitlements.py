"""Plans (M14-M22, J10, J14, P13, Q3, Q4, Q6, Q14) and subscription state."""

import datetime as dt
import json

from pyspark.sql import functions as F

from listwatch.operators import entitlements as E
from listwatch.operators import subs
from tests.conftest import rows


def test_month_end_q3(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 1, 31), 1), (dt.datetime(2026, 1, 31), 9999),
                                (dt.datetime(2026, 1, 31), None)], "ts timestamp, m int")
    out = df.select(E.months_expiry(F.col("ts"), F.col("m")).alias("c"),
                    E.months_expiry(F.col("ts"), F.col("m"), overflow=True).alias("o")).collect()
    assert (out[0]["c"], out[0]["o"]) == (dt.datetime(2026, 2, 28), dt.datetime(2026, 3, 3))
    assert out[1]["c"] is None and out[2]["c"] is None


def test_effective_plan(spark):
    as_of = dt.datetime(2026, 1, 5, 12)
    plans = spark.createDataFrame([
        (1, "pro", dt.datetime(2026, 1, 5, 23), None),              # Q6: still active on its last day
        (2, "pro", dt.datetime(2026, 1, 1), None),                  # lapsed, trial clock from expiry (Q14)
        (3, "free", None, as_of - dt.timedelta(days=10)),           # trial exactly 10 days old
        (4, "free", None, as_of - dt.timedelta(days=3)),
        (5, "mystery", None, None),                                 # unknown plan -> limit 2
    ], "user_id long, plan_name string, expires_at timestamp, free_started_at timestamp")
    users = spark.createDataFrame([(i,) for i in range(1, 7)], "user_id long")
    out = {r["user_id"]: (r["plan"], r["max_subs"]) for r in
           E.effective_plan(users, plans, F.lit(as_of), E.plan_limits(spark)).collect()}
    assert out == {1: ("pro", 20), 2: ("free", 2), 3: ("free_expired", 0), 4: ("free", 2), 5: ("mystery", 2),
                   6: ("free", 2)}


def test_resubscribe_clears_checked_q4(spark):
    t = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([
        (1, "B", "", "add", t, 1), (1, "B", "", "checked", t + dt.timedelta(1), 2),
        (1, "B", "", "add", t + dt.timedelta(2), 3),
        (1, "C", "", "add", t, 4), (1, "C", "", "remove", t + dt.timedelta(1), 5),
        (2, "D", "", "add", t, 6), (2, "X", "", "remove_all", t + dt.timedelta(1), 7),
        (2, "E", "", "add", t + dt.timedelta(2), 8)],
        "user_id long, brand string, model string, op string, ts timestamp, seq long")
    out = rows(subs.fold_subscription_events(ev), "user_id", "brand", "created_at", "last_checked_at")
    assert out == [(1, "B", t, None), (2, "E", t + dt.timedelta(2), None)]


def test_payment_sources_s6_s7(spark):
    raw = spark.createDataFrame([(json.dumps({
        "id": i, "object": "event", "type": f"checkout.session.{kind}", "created": 0,
        "data": {"object": {"id": "cs_1", "metadata": {"plan": plan, "telegram_id": user}}}}),) for i, kind, plan, user in (
            ("e1", "completed", "Pro", "7"), ("e2", "expired", "pro", "8"), ("e3", "completed", "pro", "x"),
            (None, "completed", "pro", "9"), (None, "completed", "starter", "10"))], "value string")
    pays = E.parse_payment_json(raw)
    assert rows(pays, "user_id", "plan_name") == [(7, "pro"), (9, "pro"), (10, "starter")]
    # payments without an id are payments of their own
    assert rows(E.activate_paid(pays), "user_id") == [(7,), (9,), (10,)]
    p = spark.createDataFrame([(1, "plan:dealer:42", dt.datetime(2024, 1, 1)), (2, "bad", dt.datetime(2024, 1, 1))],
                              "id long, payload string, ts timestamp")
    assert rows(E.parse_payment_payload(p, "payload", "ts", "id"), "user_id", "plan_name") == [(42, "dealer")]


def test_price_text_x26(spark):
    assert spark.range(1).select(E.price_text(F.lit(1799))).collect()[0][0] == "17.99"
