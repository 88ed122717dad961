"""Plan history, mergeable distinct counts and files of several schemas."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from listwatch.operators import distinct
from listwatch.operators import entitlements as E
from listwatch.sources.versions import merged_schema, read_versions
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1)


def day(n):
    return T0 + dt.timedelta(days=n)


def test_plan_at_each_job_equals_the_plan_of_that_day(spark):
    """Against effective_plan, once per job, over the events up to it."""
    rnd = random.Random(4)
    schema = "user_id long, plan_name string, ts timestamp, seq long, expires_at timestamp"
    events = []
    for seq in range(40):
        plan, d = rnd.choice(["free", "Pro", "starter", "dealer"]), rnd.randrange(0, 120)
        events.append((rnd.choice([1, 1, 2, 3]), plan, day(d), seq, None if plan == "free" else day(d + 30)))
    jobs = [(i, rnd.choice([1, 2, 3, 4]), rnd.choice([day(rnd.randrange(0, 160)), rnd.choice(events)[2]])) for i in range(25)]
    df = spark.createDataFrame(events, schema)
    history = E.plan_intervals(df, bucket_s=10 * 86400)
    got = E.plan_at(spark.createDataFrame(jobs, "job long, user_id long, at timestamp"), history, E.plan_limits(spark), bucket_s=7 * 86400)
    by_user = {}
    for u, p, ts, seq, ex in sorted(events, key=lambda e: (e[2], e[3])):
        by_user.setdefault(u, []).append((ts, p.lower(), ex))
    want = []
    for job, u, at in jobs:
        seen = [e for e in by_user.get(u, []) if e[0] <= at]
        plan, ex, start = ("free", None, at) if not seen else (seen[-1][1], seen[-1][2], seen[0][0] if seen[0][1] == "free" else None)
        if ex is not None and ex < at:
            plan, start, ex = "free", start or ex, None
        if plan == "free" and start is not None and at - start >= dt.timedelta(days=10):
            plan = "free_expired"
        want.append((job, plan, ex, E.PLAN_LIMITS[plan]))
    assert rows(got, "job", "plan", "expires_at", "max_subs") == sorted(want)
    open_ends = history.filter("valid_to IS NULL").groupBy("user_id").count()
    assert {r["count"] for r in open_ends.collect()} == {1}


def test_bitmaps_merge(spark):
    rnd = random.Random(2)
    data = [(rnd.randrange(4), rnd.choice([None, rnd.randrange(0, 50), rnd.randrange(0, 10 ** 12)])) for _ in range(500)]
    df = spark.createDataFrame(data, "run int, page long")
    bits = distinct.key_bitmaps(df, F.col("page"), [F.col("run")])
    assert rows(distinct.count_keys(bits, ["run"], "n")) == sorted((r, len({p for q, p in data if q == r and p is not None})) for r in range(4))
    pairs = bits.withColumn("half", F.col("run") % 2)
    assert rows(distinct.count_keys(pairs, ["half"], "n")) == [(h, len({p for q, p in data if q % 2 == h and p is not None})) for h in (0, 1)]


def test_files_of_several_schemas(spark, tmp_path):
    spark.sql("SELECT 1 AS id, 'a' AS name, CAST(1.5 AS FLOAT) AS x").write.parquet(f"{tmp_path}/1")
    spark.sql("SELECT 5000000000L AS id, 'b' AS name, 2.5D AS x, DATE'2024-01-01' AS since").write.parquet(f"{tmp_path}/2")
    out = read_versions(spark, [f"{tmp_path}/1", f"{tmp_path}/2"])
    assert out.dtypes == [("id", "bigint"), ("name", "string"), ("x", "double"), ("since", "date")]
    assert rows(out, "id", "name", "x") == [(1, "a", 1.5), (5000000000, "b", 2.5)]
    with pytest.raises(ValueError):
        merged_schema([spark.sql("SELECT 1 AS id").schema, spark.sql("SELECT 'x' AS id").schema])
