"""The stored snapshot: versions, merges, and readers that leave its rows where they are."""

import datetime as dt
import glob
import re

import pytest
from pyspark.sql import functions as F

from listwatch.operators import snapshot
from listwatch.plans.registry import all_queries
from listwatch.sources import tables as T
from listwatch.sources.stored import StoredListings, buckets_for
from tests.conftest import SF_SMALL, rows

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "url string, title string, first_seen_at timestamp, price_raw string, price bigint, seller_type string, last_seen_at timestamp"
BATCH = "url string, first_seen_at timestamp, price_raw string, price bigint, seller_type string, last_seen_at timestamp, seq int"


def day(n):
    return T0 + dt.timedelta(days=n)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_versions_and_merge(spark, tmp_path):
    store = StoredListings(spark, str(tmp_path / "t"), 4)
    assert store.versions() == []
    store.write(spark.createDataFrame([("a", "A", day(0), "1", 1, None, day(0)), ("b", "B", None, None, None, None, None)], SCHEMA))
    batch = spark.createDataFrame([("a", day(3), "3", 3, "x", day(3), 2), ("a", day(2), "2", 2, "y", day(2), 1), ("b", day(5), "", 0, None, day(5), 3),
                                   ("c", None, "9", 9, None, day(6), 4), ("c", day(7), "8", 8, None, day(7), 5)], BATCH)
    assert store.upsert(batch, F.col("seq")) == 1 and store.versions() == [0, 1]
    assert rows(store.read()) == [("a", "A", day(0), "3", 3, "x", day(3)), ("b", "B", day(5), "", 0, None, day(5)),
                                  ("c", None, day(7), "8", 8, None, day(7))]
    assert rows(store.read(0), "url", "price_raw") == [("a", "1"), ("b", None)]
    # the join form agrees with the fold form
    cols = ["url", "first_seen_at", "price_raw", "price", "seller_type", "last_seen_at"]
    assert rows(snapshot.upsert(store.read(0), batch, F.col("seq")).select(*cols)) == rows(store.read().select(*cols))
    # a version without its success mark does not count; another handle finds the others
    (tmp_path / "t" / "v=7-b=4-dead").mkdir()
    again = StoredListings(spark, str(tmp_path / "t"))
    assert again.versions() == [0, 1] and again.read().count() == 3
    # a bucket is one file
    assert all(len(glob.glob(f"{f}/part-*")) <= 4 for f in glob.glob(f"{tmp_path}/t/v=*"))


def test_upsert_moves_only_the_batch(spark, tmp_path, no_broadcast):
    store = StoredListings(spark, str(tmp_path / "t"), 8)
    store.write(spark.range(1000).selectExpr("CAST(id AS STRING) AS url", "'t' AS title", "TIMESTAMP'2024-01-01' AS first_seen_at", "'1' AS price_raw",
                                             "1L AS price", "'x' AS seller_type", "TIMESTAMP'2024-01-01' AS last_seen_at"))
    batch = spark.createDataFrame([("5", day(3), "3", 3, "x", day(3), 2)], BATCH)
    text = plan(snapshot.merge(store.read(), batch, F.col("seq")))
    assert text.count("Exchange hashpartitioning(url") == 1 and "Bucketed: true" in text


def test_readers_leave_the_stored_rows_in_place(spark, no_broadcast):
    """Joins on url shuffle the other side alone; readers of current listings do not read the log."""
    q = all_queries()
    for name in ("known_new_split", "delete_keys", "listing_touch"):
        text = plan(q[name].build(spark, SF_SMALL))
        scans = [x for x in text.split("\n") if "FileScan" in x and "listings_" in x]
        assert any("Bucketed: true" in x for x in scans), name
        stored = re.search(r"FileScan parquet [^\n]*listings_[^\n]*Bucketed: true", text).start()
        above = text[:stored].split("\n")[-8:]
        assert not any("Exchange" in x for x in above[-4:]), name
    for name in ("listing_expire", "expiry_totals", "newest_export", "report_rows", "subscription_topk", "diff_new_and_price",
                 "items_next_state", "listing_upsert"):
        text = plan(q[name].build(spark, SF_SMALL))
        assert "lineitem" not in text and "hashpartitioning(url" not in text, name


def test_one_snapshot_per_state_of_the_input(spark):
    store = T.stored_listings(spark, SF_SMALL)
    assert T.stored_listings(spark, SF_SMALL + "/") is not None and T.stored_listings(spark, SF_SMALL) is store
    assert store.versions() == [T.LOADED, T.UPSERTED]
    assert buckets_for(0) == 8 and buckets_for(1 << 40) == 4096 and buckets_for(1 << 60) == 50_000
