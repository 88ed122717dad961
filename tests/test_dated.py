"""Listings by last-seen day: touches and expiry write the days they change, and only these."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from listwatch.sources.dated import DatedListings
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "url string, brand string, model string, title string, price_raw string, first_seen_at timestamp, last_seen_at timestamp"
TOUCH = "url string, brand string, model string, price_raw string, seen_at timestamp, seq int"


def at(day, hour=0):
    return T0 + dt.timedelta(days=day, hours=hour)


def files(root):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/rows/seen_day=*/v=*/part-*")}


@pytest.fixture
def table(spark, tmp_path):
    t = DatedListings(spark, str(tmp_path / "t"))
    data = [(f"u{d}{k}", "B", "m", f"T{d}", "1", at(0), at(d, 6 * k)) for d in range(8) for k in range(3)]
    t.write(spark.createDataFrame([*data, ("never", "B", "m", "T", "1", None, None)], SCHEMA))
    return t


def test_expiry_leaves_whole_days_out(spark, table):
    before = files(table.root)
    # the limit is day 3, 06:00: days 0 to 2 go, of day 3 the first row goes and the second, seen at the limit, stays
    assert table.expire(F.lit(at(13, 6)), 10) == 1
    want = sorted([f"u3{k}" for k in (1, 2)] + [f"u{d}{k}" for d in range(4, 8) for k in range(3)] + ["never"])
    assert [r[0] for r in rows(table.read(), "url")] == want
    assert table.read(0).count() == 25
    new = files(table.root)
    assert all(new[f] == t for f, t in before.items())
    assert {f.split("seen_day=")[1][:10] for f in new.keys() - before.keys()} == {"2024-01-04"}
    assert table.vacuum() == 4 and [r[0] for r in rows(table.read(), "url")] == want
    kept = files(table.root)
    assert all(kept[f] == before[f] for f in kept if "2024-01-04" not in f) and len({f.split("/v=")[0] for f in kept}) == 6


def test_expiry_at_midnight_writes_no_rows(spark, table):
    before = files(table.root)
    table.expire(F.lit(at(13)), 10)
    assert files(table.root) == before and table.read().count() == 16
    table.expire(F.lit(None).cast("timestamp"), 10)
    assert table.read().count() == 16


def test_touch_writes_days_of_touched_urls(spark, table):
    before = files(table.root)
    touches = spark.createDataFrame([("u10", "Kia", "Unknown", "9", at(9), 1), ("u21", None, "", "", at(4, 1), 2), ("new", "A", "x", "5", at(9), 3),
                                     ("u10", "", "rio", None, at(9, 2), 4)], TOUCH)
    table.touch(touches, F.col("seq"))
    got = {r["url"]: r for r in table.read().collect()}
    assert len(got) == 26 == table.read().count()
    assert (got["u10"]["brand"], got["u10"]["model"], got["u10"]["price_raw"], got["u10"]["title"], got["u10"]["last_seen_at"]) == ("Kia", "rio", "9", "T1", at(9, 2))
    assert (got["u21"]["brand"], got["u21"]["price_raw"], str(got["u21"]["seen_day"])) == ("B", "1", "2024-01-05")
    assert (got["new"]["first_seen_at"], got["new"]["title"]) == (at(9), None)
    assert got["never"]["last_seen_at"] is None
    new = files(table.root)
    assert all(new[f] == t for f, t in before.items())
    # days 1 and 2 lose rows and are written again; days 4 and 9 get a file beside those they have
    assert {f.split("seen_day=")[1][:10] for f in new.keys() - before.keys()} == {"2024-01-02", "2024-01-03", "2024-01-05", "2024-01-10"}
    assert {str(r[0]) for r in table.days().groupBy("seen_day").count().where("count > 1").collect()} == {"2024-01-05"}


def test_day_filters_and_lists_prune_partitions(spark, table):
    plan = table.read().where(F.col("seen_day") >= F.lit("2024-01-05").cast("date"))._jdf.queryExecution().executedPlan().toString()
    scan = [x for x in plan.splitlines() if "PartitionFilters" in x and "v#" in x]
    assert any("seen_day" in x.split("PartitionFilters: [")[1].split("]")[0] for x in scan)
    assert any("dynamicpruning" in x.lower() for x in table.read()._jdf.queryExecution().executedPlan().toString().splitlines())


def test_unfinished_and_empty_tables(spark, tmp_path):
    t = DatedListings(spark, str(tmp_path / "t"), "month")
    t.write(spark.createDataFrame([], SCHEMA))
    assert t.read().count() == 0
    t.expire(F.lit(at(5)), 10)
    t.touch(spark.createDataFrame([], TOUCH), F.col("seq"))
    t.touch(spark.createDataFrame([("a", "B", "m", "1", at(40), 1)], TOUCH), F.col("seq"))
    assert [str(r[0]) for r in t.read().select("seen_day").collect()] == ["2024-02-01"]
    # rows and a list of a job that died before its commit are no version
    t._append(spark.createDataFrame([("dead", "B", "m", "T", "1", at(0), at(0))], SCHEMA))
    os.makedirs(f"{t.root}/days/9-dead")
    again = DatedListings(spark, t.root, "month")
    assert rows(again.read(), "url") == [("a",)]
    assert again.vacuum() == 1 and rows(again.read(), "url") == [("a",)]
