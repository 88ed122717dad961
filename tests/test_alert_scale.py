"""The diff of two snapshots per pattern set, and alerts ranked once per choice of sets."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from listwatch.operators import diff, match, snapshot
from listwatch.plans.registry import all_queries
from listwatch.sources import tables as T
from tests.conftest import SF_SMALL

T0 = datetime(2024, 1, 1)
LISTING = "url string, brand string, model string, title string, price_raw string, last_seen_at timestamp"


def versions(spark):
    def made(*xs):
        return spark.createDataFrame([(u, b, m, t, p, T0 + timedelta(days=d)) for u, b, m, t, p, d in xs], LISTING)
    old = made(("same", "B", "red", "x", "10", 1), ("gone", "B", "red", "x", "20", 2), ("moved", "B", "red", "x", "30", 3),
               ("empty", "B", "red", None, "40", 4), ("twice", "B", "red", "x", "50", 5), ("twice", "B", "blue", "x", "51", 5),
               (None, "B", "red", "x", "60", 6))
    new = made(("same", "B", "red", "x", "11", 7), ("fresh", "B", "blue", "x", "70", 8), ("moved", "B", "blue", "x", "31", 9),
               ("empty", "B", "red", None, " ", 10), ("twice", "B", "red", "x", "52", 11), ("twice", "B", "blue", "x", "51", 11),
               (None, "B", "red", "x", "61", 12))
    subs = spark.createDataFrame([(1, "b", "red"), (2, "b", "blue"), (3, "b", ""), (4, "b", "red"), (4, "b", "blue"), (None, "b", "red")],
                                 "user_id long, brand string, model string")
    return old, new, match.user_pattern_sets(subs)


def test_pairs_of_versions_are_the_diff_per_set(spark):
    old, new, users = versions(spark)
    key = (*match.SET_KEY, "url")
    for o, n in ((old, new), (old.where("url IN ('same', 'gone')"), new.where("url IN ('same', 'fresh')"))):
        state = match.set_matches(o, users).select(*key, F.col("price_raw").alias("last_price"), "last_seen_at")
        cur = match.set_matches(n, users)
        pairs = diff.set_pairs(o, n, users)
        for got, want in ((diff.diff_pairs(pairs), diff.diff_items(cur, state, key)), (diff.next_of_pairs(pairs), diff.next_state(cur, state, key))):
            cols = sorted(want.columns)
            assert sorted(got.columns) == cols and sorted(map(repr, rows2(got, cols))) == sorted(map(repr, rows2(want, cols)))


def rows2(df, cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_alert_rows_are_each_users_newest(spark):
    old, new, users = versions(spark)
    d = diff.diff_pairs(diff.set_pairs(old, new, users)).where("url IS NOT NULL AND url <> 'twice'")
    each = [(r.user_id, r.change_type, r.url, r.last_seen_at) for r in match.fan_out(users, d).collect()]
    for mode in ("delta", "full"):
        for cap in (1, 2, 20):
            want = []
            for u, c in {(u, c if mode == "delta" else None) for u, c, _, _ in each if c or mode == "full"}:
                mine = sorted((x for x in each if x[0] == u and (mode == "full" or x[1] == c)), key=lambda x: (-x[3].timestamp(), x[2]))
                want += [(u, x[1], x[2], i + 1, x[2] + "!") for i, x in enumerate(mine[:cap])]
            got = diff.alert_rows(d, users, mode, cap, {"text": F.concat("url", F.lit("!"))})
            got = rows2(got, ["user_id", "change_type", "url", "rn", "text"])
            assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_diff_does_not_shuffle_listings_by_set(spark):
    """Every listing x set row was shuffled twice, once for either version; users' rows were shuffled to be ranked."""
    q = all_queries()
    for name in ("diff_new_and_price", "items_next_state", "alert_delta", "alert_cards", "alert_counts", "alert_full", "alert_manual"):
        text = q[name].build(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert not any("Exchange" in x and "_set#" in x and "url#" in x.split("hashpartitioning(")[-1] for x in text.split("\n")), name



def test_touch_stores_no_more_than_it_reads(spark, tmp_path):
    """The touch reads the snapshot before the crawl batch; merging that batch moved as much again, unread."""
    for t in ("lineitem", "part"):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").limit(300).write.parquet(str(tmp_path / f"{t}.parquet"))
    all_queries()["listing_touch"].build(spark, str(tmp_path))
    store = T.stored_listings(spark, str(tmp_path), T.LOADED)
    assert store.versions() == [T.LOADED]
    assert T.stored_listings(spark, str(tmp_path)) is store and store.versions() == [T.LOADED, T.UPSERTED]


def test_batch_folded_before_the_merge_gives_the_same_snapshot(spark, tmp_path):
    for t in ("lineitem", "part"):
        df = spark.read.parquet(f"{SF_SMALL}/{t}.parquet")
        df.unionByName(df.limit(50)).write.parquet(str(tmp_path / f"{t}.parquet"))
    d = str(tmp_path)
    store, s = T.stored_listings(spark, d), T.sightings(spark, d)
    batch = T.crawl_batch(spark, d).withColumn("first_seen_at", F.col("seen_at")).withColumn("last_seen_at", F.col("seen_at"))
    want = snapshot.merge(store.read(T.LOADED), batch, T.sighting_seq(s))
    cols = sorted(want.columns)
    assert sorted(map(repr, rows2(store.read(), cols))) == sorted(map(repr, rows2(want, cols)))
