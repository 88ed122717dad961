"""Run suppression (W3, T3), scheduler ticks (T1, J7, J8), deny-list (J9),
quota admission (W2)."""

import datetime as dt
import random

from pyspark.sql import functions as F

from listwatch.operators import runs, toggles
from tests.conftest import rows

EPOCH = dt.datetime(2024, 1, 1)


def run_df(spark, data):
    return spark.createDataFrame(
        [(i, k, EPOCH + dt.timedelta(seconds=t)) for i, (k, t) in enumerate(data)],
        "event_id long, key string, started_at timestamp")


def brute_force(data, w):
    last, out = {}, []
    for i, (k, t) in sorted(enumerate(data), key=lambda x: (x[1][1], x[0])):
        if k not in last or t > last[k] + w:
            last[k] = t
            out.append(i)
    return sorted(out)


def test_accepted_runs_fixture_w3(spark):
    df = run_df(spark, [("a", t) for t in (0, 1800, 3600, 3601, 7000)])
    out = runs.accepted_runs(df, ["key"], "started_at", "event_id", 3600, bucket_s=1000)
    assert rows(out, "event_id") == [(0,), (3,)]


def test_accepted_runs_matches_brute_force(spark):
    rnd = random.Random(7)
    data = [(rnd.choice("ab"), rnd.randrange(0, 40000)) for _ in range(300)]
    out = runs.accepted_runs(run_df(spark, data), ["key"], "started_at", "event_id", 3600, bucket_s=2000)
    assert [r[0] for r in rows(out, "event_id")] == brute_force(data, 3600)


def test_requests_are_judged_against_the_log_k6(spark):
    log = run_df(spark, [("a", 0), ("a", 100), ("b", 50), (None, 10)])
    asked = run_df(spark, [("a", 3700), ("a", 3701), ("a", 4000), ("b", 200), ("c", 5), ("c", 6), (None, 20), (None, 4000)])
    assert rows(runs.accepted_after(log, asked, ["key"], "started_at", "event_id", 3600), "event_id") == [(1,), (4,), (7,)]


def test_accepted_runs_keep_null_keys_and_long_segments(spark):
    data = [(None, t) for t in (0, 5, 9, 20, 24)] + [(1, t) for t in range(0, 400, 3)] + [(2, 7)]
    df = spark.createDataFrame([(i, k, EPOCH + dt.timedelta(seconds=t)) for i, (k, t) in enumerate(data)],
                               "event_id long, key long, started_at timestamp")
    want, last = [], {}
    for i, (k, t) in enumerate(data):
        if k not in last or t > last[k] + 10:
            want.append((i,))
            last[k] = t
    for short in (256, 3):  # folded in a row, or by doubling
        assert rows(runs.accepted_runs(df, ["key"], "started_at", "event_id", 10, bucket_s=50, short=short), "event_id") == want


def test_throttle_t8(spark):
    data = [(0, "x"), (1, "x"), (5, "x"), (6, "y"), (7, "x"), (8, "x"), (12, "x")]
    df = spark.createDataFrame([(i, 1, EPOCH + dt.timedelta(seconds=t), v) for i, (t, v) in enumerate(data)],
                               "event_id long, user_id long, ts timestamp, v string")
    out = toggles.throttle(df, ["user_id"], "ts", "event_id", "v", 3)
    # changes always kept; equal snapshots kept only after more than 3 s
    assert [r[0] for r in rows(out, "event_id")] == [0, 2, 3, 4, 6]


def test_due_ticks_t1(spark):
    span = spark.createDataFrame([(1, "k", EPOCH, EPOCH + dt.timedelta(hours=4))],
                                 "user_id long, brand_key string, first_at timestamp, last_at timestamp")
    r = spark.createDataFrame([(1, "k", EPOCH + dt.timedelta(minutes=30))], "user_id long, brand_key string, started_at timestamp")
    pend = spark.createDataFrame([(1, "k", EPOCH + dt.timedelta(hours=3))], "user_id long, brand_key string, queued_at timestamp")
    def due(lo, hi):
        ticks = [F.lit(EPOCH + dt.timedelta(hours=h)) for h in (lo, hi)]
        out = runs.due_at_ticks(span, ["user_id", "brand_key"], r, pend, *ticks, 3600, 3600, 1800)
        return sorted(int((x[0] - EPOCH).total_seconds() // 3600) for x in out.select("tick").collect())

    # tick 1 h has a run within 60 min; tick 3 h has a pending job
    assert due(0, 4) == [0, 2, 4]
    assert due(-3, 0) == [0]  # nothing is due before the key exists
    assert due(2, 3) == [2]


def test_recent_flag_strict_ttl_j9(spark):
    a = spark.createDataFrame([(1, 1, EPOCH + dt.timedelta(seconds=s)) for s in (100, 86500, 86501)],
                              "event_id long, user_id long, ts timestamp")
    a = spark.createDataFrame([(i, 1, EPOCH + dt.timedelta(seconds=s)) for i, s in enumerate((100, 86500, 86501))],
                              "event_id long, user_id long, ts timestamp")
    f = spark.createDataFrame([(1, EPOCH + dt.timedelta(seconds=100))], "user_id long, ts timestamp")
    out = runs.drop_recently_flagged(a, f, "user_id", 86400)
    # flag at the same instant counts; exactly TTL later is free again (strict <)
    assert rows(out, "event_id") == [(1,), (2,)]


def test_quota_admission_w2(spark):
    sel = spark.createDataFrame([(1, "b", "", 1), (1, "c", "", 2), (1, "d", "", 3)],
                                "user_id long, brand string, model string, pos int")
    held = spark.createDataFrame([(1, "a", ""), (1, "b", "")], "user_id long, brand string, model string")
    lim = spark.createDataFrame([(1, 3)], "user_id long, max_subs int")
    out = rows(runs.quota_admission(sel, held, lim), "brand", "admitted")
    assert out == [("b", True), ("c", True), ("d", False)]
    # without a limit row the limit is that of an unknown plan: 2, and 2 are held
    out = rows(runs.quota_admission(sel, held, lim.where("false")), "brand", "admitted")
    assert out == [("b", False), ("c", False), ("d", False)]


def test_toggle_state_u6(spark):
    ev = spark.createDataFrame([(1, i, k) for i, k in enumerate(["private", "agency", "private", "private"])],
                               "user_id long, seq long, kind string")
    out = toggles.seller_state(ev, ["user_id"], "kind", ["seq"], F.floor(F.col("seq") / 2))
    # {p,a} -p-> {a} -a-> {a} (never empty) -p-> {p,a} -p-> {a}
    assert rows(out, "seller_filter") == [("agency",)]


def test_toggles_of_a_hot_key_by_levels_of_blocks(spark):
    import random
    rnd = random.Random(3)
    ev = [(u, i, rnd.choice(["private", "agency"])) for u, n in ((1, 1500), (2, 63), (3, 64), (4, 65), (5, 1), (None, 9)) for i in range(n)]
    want = {}
    for u, _, k in ev:
        state = want.get(u, toggles.INITIAL_SELLER_STATE)
        want[u] = (toggles.TOGGLE_PRIVATE if k == "private" else toggles.TOGGLE_AGENCY)[state]
    rnd.shuffle(ev)
    df = spark.createDataFrame(ev, "user_id long, seq long, kind string")
    for width, levels in ((8, 2), (4, 3), (1024, 2)):
        out = toggles.seller_state(df, ["user_id"], "kind", ["seq"], F.lit(0), width, levels)
        assert {r[0]: r[1] for r in out.collect()} == {u: toggles.SELLER_STATES[s] for u, s in want.items()}
    assert toggles.seller_state(df.limit(0), ["user_id"], "kind", ["seq"], F.lit(0)).count() == 0
