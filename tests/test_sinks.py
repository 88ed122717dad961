"""Sinks (K1, K3, K6) and sources (S1, S6, S8) through real files."""

import datetime as dt
import glob
import os

from pyspark.sql import functions as F

from listwatch.operators import entitlements as E
from listwatch.operators import report, runs
from listwatch.sources import logs
from tests.conftest import rows


def test_export_csv_newest_first_k1(spark, tmp_path):
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1)), ("b", None), ("c", dt.datetime(2024, 2, 1))],
                               "url string, last_seen_at timestamp")
    path = str(tmp_path / "k1")
    report.export_csv(df.coalesce(1), path)
    text = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(os.path.join(path, "part-*"))))
    assert [line.split(",")[0] for line in text.splitlines()] == ["url", "c", "a", "b"]
    empty = str(tmp_path / "k1-empty")
    report.export_csv(df.filter(F.lit(False)), empty)
    assert "".join(open(f).read() for f in glob.glob(os.path.join(empty, "part-*"))) == ""


def test_user_reports_in_buckets_k3(spark, tmp_path):
    df = spark.createDataFrame([(u, f"{u}-{i}") for u in range(50) for i in range(3)], "user_id long, url string")
    path = str(tmp_path / "k3")
    report.write_user_reports(df, path, buckets=4)
    assert len(glob.glob(os.path.join(path, "bucket=*"))) == 4
    for u in (0, 17, 49):
        assert rows(report.read_user_report(spark, path, u, buckets=4), "url") == [(f"{u}-{i}",) for i in range(3)]


def test_run_log_appends_k6(spark, tmp_path):
    path = str(tmp_path / "k6")
    r = spark.createDataFrame([(1, "b", "*", dt.datetime(2024, 1, 1))],
                              "user_id long, brand_key string, model_key string, started_at timestamp")
    runs.append_runs(r, path)
    runs.append_runs(r, path)
    assert spark.read.parquet(path).count() == 2


def test_flag_log_source_s8(spark, tmp_path):
    p = tmp_path / "ips.log"
    p.write_text("2024-01-01T10:00:00Z port=9050 10.0.0.1 reason=new_session\n"
                 "2024-01-01T11:00:00Z port=9051 not-an-ip reason=bot_wall\n", encoding="utf-8")
    out = logs.read_flag_log(spark, str(p)).collect()
    assert [(r["port"], r["ip"], r["reason"], r["ip_valid"]) for r in out] == [
        (9050, "10.0.0.1", "new_session", True), (9051, "not-an-ip", "bot_wall", False)]


def test_payment_json_files_s6(spark, tmp_path):
    p = tmp_path / "events.json"
    p.write_text('{"id":"e1","type":"checkout.session.completed","created":1704067200,'
                 '"data":{"object":{"metadata":{"plan":"starter","telegram_id":"5"}}}}\n', encoding="utf-8")
    raw = spark.read.text(str(p))
    out = E.activate_paid(E.parse_payment_json(raw))
    assert rows(out, "user_id", "plan_name", "expires_at") == [(5, "starter", dt.datetime(2024, 1, 31))]
