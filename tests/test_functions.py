"""Scalar functions against hand-made edge rows (FIXTURES.md §3)."""

import datetime as dt

from pyspark.sql import functions as F

from listwatch.functions import dates, labels, text, urls
from listwatch.operators import extract, runs


def one(spark, col, data, schema="s string"):
    df = spark.createDataFrame(data, schema)
    return [r[0] for r in df.select(col.alias("o")).collect()]


def test_normalize_text(spark):
    out = one(spark, text.normalize_text(F.col("s")), [("  Hello,   WORLD!! a.b_c/d ",), ("",)])
    assert out == ["hello world a b c d", ""]


def test_digits_only(spark):
    assert one(spark, text.digits_only(F.col("s")), [("₪ 1,234",), ("x²9",)]) == ["1234", "9"]


def test_escape_and_shorten(spark):
    assert one(spark, text.escape_markdown(F.col("s")), [("a*b_c[d`e",)]) == ["a\\*b\\_c\\[d\\`e"]
    s = "word " * 100
    out = one(spark, text.shorten(F.col("s"), 11), [(s,), ("short",)])
    assert out[0] == "word word…" and out[1] == "short"


def test_canonical_url(spark):
    col = urls.canonical_url(F.col("s"), prefix="https://s/vehicles/item/")
    out = one(spark, col, [("https://s/vehicles/item/ab1?x=1",), ("/item/ab1",), ("https://s/other?y",), ("",)])
    assert out == ["https://s/vehicles/item/ab1", "https://s/vehicles/item/ab1", "https://s/other", ""]


def test_external_links_q16(spark):
    col = urls.is_external(F.col("s"), domain="site.example")
    out = one(spark, col, [("https://other.com/item/ab1",), ("https://notsite.example/x",),
                           ("https://www.site.example/vehicles/item/1",), ("/relative/path",),
                           ("https://site.example/live/3",)])
    assert out == [True, True, False, False, True]


def test_selection_key_x7(spark):
    df = spark.createDataFrame([([],), ([" b", "a", ""],), (["b", "a", "b"],)], "a array<string>")
    assert [r[0] for r in df.select(runs.selection_key(F.col("a"))).collect()] == ["*", "a|b", "a|b|b"]


def test_parse_dates_q9(spark):
    as_of = F.lit("2025-09-20 10:00:00").cast("timestamp")
    out = one(spark, dates.parse_date_or_none(F.col("s"), as_of),
              [("13/09/25",), ("13/09/2025",), ("99/99/99",), ("היום",), ("אתמול",), ("2025-02-03T12:22:55Z",),
               ("garbage",)])
    assert out == [dt.date(2025, 9, 13), dt.date(2025, 9, 13), None, dt.date(2025, 9, 20), dt.date(2025, 9, 19),
                   dt.date(2025, 2, 3), None]


def test_ad_created_text_x10(spark):
    as_of = F.lit("2025-09-20 22:30:00").cast("timestamp")  # already the 21st in the site's zone
    out = one(spark, dates.ad_created_text(F.col("s"), as_of),
              [("פורסם ב 13/09/25",), ("‏היום",), ("אתמול",), ("לפני שבוע",)])
    assert out == ["13/09/25", "21/09/25", "20/09/25", "לפני שבוע"]


def test_format_dates_x3_x4(spark):
    out = one(spark, dates.format_date_only(F.col("s"), is_text=True),
              [("2025-09-14T13:15:25Z",), ("2025-11-03 junk",), ("raw",), ("",)])
    assert out == ["14/09/2025", "03/11/2025", "raw", ""]
    out = one(spark, dates.format_datetime(F.col("s"), is_text=True), [("2025-09-14T13:15:25Z",), ("bad",)])
    assert out == ["14/09/2025 13:15", "bad"]


def test_banner_x8(spark):
    df = spark.createDataFrame([("20/09/25", "2025-09-20 08:00:00"), ("10/09/25", "2025-09-12 08:00:00"),
                                ("10/09/25", "2025-09-10 08:00:00"), ("junk", "2025-09-12 08:00:00")],
                               "c string, f string")
    as_of = F.lit("2025-09-20 10:00:00").cast("timestamp")
    out = [r[0] for r in df.select(labels.banner(F.col("c"), F.col("f").cast("timestamp"), as_of)).collect()]
    assert out == [labels.BANNER_NEW, labels.BANNER_BUMPED, labels.BANNER_FALLBACK, labels.BANNER_FALLBACK]


def test_spec_list_q10(spark):
    df = spark.createDataFrame([("2019", {"z": "1", "Color": "red", "a": " ", "Gearbox": "auto", "b": "2"})],
                               "y string, m map<string,string>")
    specs = labels.spec_list(F.col("y"), F.lit(""), F.lit(""), F.lit(""), F.col("m"), max_items=4)
    out = df.select(specs.alias("s")).collect()[0]["s"]
    assert [(e["label"], e["value"]) for e in out] == [
        (labels.SPEC_YEAR, "2019"), ("Gearbox", "auto"), ("Color", "red"), ("b", "2")]


def test_zip_labels_last_wins_j13(spark):
    df = spark.createDataFrame([(["k1", "", "k1", "k2", "k3"], ["a", "b", "c", "d"])], "l array<string>, v array<string>")
    out = df.select(extract.zip_labels(F.col("l"), F.col("v")).alias("m")).collect()[0]["m"]
    assert out == {"k1": "c", "k2": "d"}


def test_spec_triage_x9(spark):
    df = spark.createDataFrame([([["2019"], ["יד", "2"], ["120,000", 'ק"מ'], ["2020"]],)], "b array<array<string>>")
    y, h, k = extract.spec_triage(F.col("b"))
    r = df.select(y, h, k).collect()[0]
    assert tuple(r) == ("2020", "יד 2", '120,000 ק"מ')


def test_page_flags_q8(spark):
    big = "x" * 2500
    df = spark.createDataFrame([(1, ""), (2, big + "Access Denied"), (3, big + " validate.perfdrive.com "),
                                (4, "<title>502 Bad Gateway</title>" + big), (5, big)], "page_id long, html string")
    out = {r["page_id"]: (r["soft_blocked"], r["hard_blocked"], r["broken"])
           for r in extract.page_flags(df).collect()}
    assert out[1] == (True, False, False)
    assert out[2] == (True, False, False)   # marker beyond the first 2000 chars: not a broken page
    assert out[3] == (False, True, False)   # dotted needle matches after normalisation (Q8)
    assert out[4] == (False, False, True)
    assert out[5] == (False, False, False)


def test_broken_page_word_boundary_q19(spark):
    df = spark.createDataFrame([(1, "<title>Order 14045</title>"), (2, "<title>Error 404</title>")],
                               "page_id long, html string")
    loose = {r["page_id"]: r["broken"] for r in extract.page_flags(df).collect()}
    strict = {r["page_id"]: r["broken"] for r in extract.page_flags(df, numeric_word_boundary=True).collect()}
    assert loose == {1: True, 2: True} and strict == {1: False, 2: True}


def test_scheme_relative_links_have_a_host_p2(spark):
    from listwatch.functions import urls
    df = spark.createDataFrame([("//other.com/item/ab1",), ("//www.example.com/item/ab1",), ("/item/ab1",), ("item//ab1",),
                                ("//u:p@other.com:80/x",)], "u string")
    got = [r[0] for r in df.select(urls.is_external(F.col("u"))).collect()]
    assert got == [True, False, False, False, True]
