"""The crawl chain, default page markup and the operators around subscriptions."""

import datetime as dt

from pyspark.sql import functions as F

from listwatch.functions import labels
from listwatch.operators import crawl, extract, snapshot, subs
from listwatch.plans.reports import report_table
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1)

FEED_PAGE = """
<a class="agency-item_box" href="https://www.example.com/vehicles/item/ab1?x=1"><span class="feed-item-info-section_heading__x">Kia Rio 2019</span>
<span data-testid="price">50,000</span></a>
<a class="private-item_box" href="/vehicles/item/cd2"><span class="feed-item-info-section_heading__x">Mazda 3</span><span data-testid='price'>1</span></a>
<a class="menu" href="/vehicles/item/zz9">menu</a><a class="private" href="//other.com/item/ab1">foreign</a>
<a class="private" href="https://www.example.com/vehicles/item/ab1">second card of the same item</a>"""
DETAIL_PAGE = """<h1 class="h"> Kia <b>Rio</b> </h1><span data-testid="price">49,900</span><span data-testid="location">Haifa</span>
<span class="report-ad_createdAt__1">פורסם ב 05/01/24</span><div class="agency-box"></div>
<div class="details-item_detailsItemBox__1"><span>2019</span></div>
<div class="details-item_detailsItemBox__1"><span>יד</span><span>2</span></div>
<div class="details-item_detailsItemBox__1"><span>10</span><span>ק״מ</span></div>
<dd class="item-detail_label__1">Fuel</dd><dt class="item-detail_value__1">petrol</dt><p>first</p><p>second</p>"""


def pages(spark, data):
    return spark.createDataFrame([(i, u, h, T0 + dt.timedelta(hours=i)) for i, u, h in data],
                                 "page_id long, url string, html string, seen_at timestamp")


def test_feed_default_markup(spark):
    out = rows(extract.feed_links(pages(spark, [(1, "u", FEED_PAGE)])), "url", "title", "price_raw", "seller_type")
    prefix = "https://www.example.com/vehicles/item/"
    assert out == [(prefix + "ab1", "Kia Rio 2019", "50,000", "agency"), (prefix + "cd2", "Mazda 3", "1", "private")]


def test_detail_default_markup(spark):
    p = pages(spark, [(1, "u", DETAIL_PAGE)])
    r = extract.page_detail(p, as_of=F.lit(T0)).collect()[0]
    assert (r["title"], r["price_raw"], r["location"], r["year_raw"], r["hands_raw"], r["km_raw"]) == (
        "Kia Rio", "49,900", "Haifa", "2019", "יד 2", "10 ק״מ")
    assert (r["ad_created_at"], r["seller_type"], r["fields"], r["description"]) == ("05/01/24", "agency", {"Fuel": "petrol"}, "first")
    preset = extract.page_detail(p, preset_seller=F.lit("private")).collect()[0]
    assert preset["seller_type"] == "private"


def test_crawl_known_items_keep_details(spark):
    stored = spark.createDataFrame([("https://www.example.com/vehicles/item/cd2", T0 - dt.timedelta(days=30), "Mazda", "3", "Mazda 3", "7", "private",
                                     "01/12/23", '{"a":"b"}', "old text", T0 - dt.timedelta(days=30)),
                                    ("gone", T0 - dt.timedelta(days=40), "X", "", "X", "1", "private", "", "", "", T0 - dt.timedelta(days=40))],
                                   "url string, first_seen_at timestamp, brand string, model string, title string, price_raw string, "
                                   "seller_type string, ad_created_at string, fields string, description string, last_seen_at timestamp")
    brands = spark.createDataFrame([("Kia",), ("Mazda",), ("Kia Rio",)], "brand string")
    p = pages(spark, [(1, "https://www.example.com/feed", FEED_PAGE), (2, "https://www.example.com/vehicles/item/ab1", DETAIL_PAGE)])
    out = crawl.ingest(p, stored, brands, F.lit(T0 + dt.timedelta(days=1)), extract.FeedMarkup(), extract.DetailMarkup(), 10)
    got = {r["url"].rsplit("/", 1)[-1]: r for r in out.collect()}
    ab, cd, gone = got["ab1"], got["cd2"], got["gone"]
    assert (ab["brand"], ab["model"], ab["visit"], ab["fields"], ab["description"], ab["ad_created_at"]) == (
        "Kia Rio", "2019", True, '{"Fuel":"petrol"}', "first", "05/01/24")
    assert (cd["visit"], cd["fields"], cd["description"], cd["price_raw"], cd["first_seen_at"]) == (
        False, '{"a":"b"}', "old text", "1", T0 - dt.timedelta(days=30))
    assert (gone["seen"], gone["expired"], ab["expired"]) == (False, True, False)
    assert rows(crawl.statistics(out)) == [(2, 1, 1, 0, 1, 2)]


def test_absent_columns_p11(spark):
    old = spark.createDataFrame([("u", T0, "private", "{}", 5, T0)],
                                "url string, first_seen_at timestamp, seller_type string, fields string, price long, last_seen_at timestamp")
    batch = spark.createDataFrame([("u", T0, {"k": "v"}, T0)], "url string, first_seen_at timestamp, fields map<string,string>, last_seen_at timestamp")
    r = snapshot.upsert(old, batch, F.col("last_seen_at"), ["seller_type", "fields", "price", "last_seen_at"]).collect()[0]
    assert (r["seller_type"], r["fields"], r["price"]) == ("", '{"k":"v"}', None)


def test_stored_attribute_text_x16(spark):
    df = spark.createDataFrame([('{"a":"1","b":2}',), ("{bad",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(labels.fields_of_text(F.col("t"))).collect()] == [{"a": "1", "b": "2"}, {}, {}, {}]


def test_report_alternate_names_k2(spark):
    df = spark.createDataFrame([("l1", "B", "10", 5, T0, None)],
                               "LINK string, Brand string, amount string, Mileage int, first_seen_at timestamp, last_seen_at timestamp")
    r = report_table(df).collect()[0]
    assert (r["link_target"], r["יצרן"], r["מחיר"], r["ק״מ"], r["דגם"], r["פורסם"]) == ("l1", "B", "10", "5", "", "")


def test_job_stamps_j11(spark):
    s = spark.createDataFrame([(1, "A", "", None), (1, "B", "", None), (1, "B", "x", None), (1, "C", "y", None), (2, "A", "", None)],
                              "user_id long, brand string, model string, last_checked_at timestamp")
    jobs = spark.createDataFrame([(1, ["A", "B"], T0), (3, ["A"], T0)], "user_id long, brands array<string>, checked_at timestamp")
    out = rows(subs.stamp_checked(s, jobs), "user_id", "brand", "model", "last_checked_at")
    assert [r[:3] for r in out if r[3]] == [(1, "A", ""), (1, "B", "x")]


def test_row_delete_and_wipe(spark):
    s = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "row_id long, user_id long")
    requests = spark.createDataFrame([(1, 7), (3, 7)], "row_id long, user_id long")
    assert rows(subs.delete_rows(s, requests), "row_id") == [(2,), (3,)]
    items = spark.createDataFrame([(7, "u"), (9, "v")], "user_id long, url string")
    assert rows(subs.wipe_totals(s, items)) == [(3, 2, 2)]
    assert rows(subs.wipe_totals(s.where("false"), items.where("false"))) == [(0, 0, 0)]


def test_alert_texts():
    assert labels.ALERT_PRICE.count("{}") == 2 and all(t.count("{}") == 1 for t in (labels.ALERT_N_NEW, labels.ALERT_N_PRICE, labels.ALERT_REST))
