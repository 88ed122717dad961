"""Driver contract, plan properties and a sample of oracle comparisons."""

import duckdb
import pytest

import __spark_entry__ as entry_mod
from listwatch.plans.registry import all_queries
from tests.conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
STREAMING = {"stream_accepted_runs", "stream_diff", "stream_payments", "stream_throttle", "stream_unflagged"}


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert df.columns == ["user_id", "url", "last_seen_at", "rn", "n_total"]


def test_every_query_has_an_oracle():
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(o) <= set(q)
    assert set(all_queries()) - set(o) == set()


def test_batch_plans_have_no_python_and_no_nested_loops(spark):
    for name, query in all_queries().items():
        if name in STREAMING:
            continue
        plan = query.build(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        for bad in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert bad not in plan, (name, bad)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", ["subscription_topk", "listing_upsert", "diff_new_and_price", "accepted_runs",
                                  "effective_plan", "feed_links", "brand_resolution", "listing_cards",
                                  "throttle_snapshots", "recent_flag_antijoin"])
def test_oracle_sample(spark, duck, name):
    from tools.oracle_check import norm
    df = entry_mod.queries()[name](spark, SF_SMALL)
    res = duck.execute(entry_mod.oracle_sql()[name])
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(norm(r[cols.index(c)]) for c in order) for r in res.fetchall()), key=repr)
    assert got == want


def test_flagship_plan_limits_before_shuffle(spark):
    """The per-user top-k takes a partial group limit before its exchange."""
    df = entry_mod.queries()["subscription_topk"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
