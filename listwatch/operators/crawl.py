"""One crawl as one job: feed pages -> links -> brands -> known/new -> details
-> snapshot -> expiry -> statistics (S2, S3, P1, P2, P10, P11, J3, J4, M1, M6,
U1, U2, A4, A11).

Each step is an operator of its own; this module chains them on one set of
pages, so a page is parsed twice (as feed, as detail) and everything after
is keyed by the canonical url.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwatch.functions.urls import canonical_url
from listwatch.operators import catalog, extract, snapshot

VALUES = ["brand", "model", "title", "price_raw", "seller_type", "ad_created_at", "fields", "description", "last_seen_at"]


def feed_items(pages: DataFrame, markup: extract.FeedMarkup) -> DataFrame:
    """Per url of the feed the values of its last card and its first and last
    sighting; ``pages`` carry ``seen_at``."""
    f = extract.feed_links(pages, markup, keep=("seen_at",))
    last = F.max_by(F.struct("title", "price_raw", "seller_type"), F.struct("page_id", "pos"))
    return (f.groupBy("url").agg(F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"),
                                 last.alias("c"))
            .select("url", "first_seen_at", "last_seen_at", "c.title", "c.price_raw", "c.seller_type"))


def ingest(pages: DataFrame, stored: DataFrame, brands: DataFrame, as_of: Column, feed: extract.FeedMarkup,
           detail: extract.DetailMarkup, days: int = 10) -> DataFrame:
    """The snapshot after the crawl: ``stored`` (url, first_seen_at, VALUES
    with ``fields`` as JSON text) with the crawl's items folded in. Details
    are read for urls that were not stored (``visit``); a known url keeps
    its stored details and gets the feed's price and sighting."""
    items = catalog.resolve_brands(feed_items(pages, feed), brands)
    items = snapshot.split_known(items, stored)
    own_url = canonical_url(F.col("url"), feed.id_pattern, feed.canonical_prefix)
    found = extract.page_detail(pages, detail, as_of).withColumn("url", own_url)
    found = (found.groupBy("url").agg(F.max_by(F.struct("price_raw", "ad_created_at", "fields_json", "description"), "page_id")
                                      .alias("d")).select("url", "d.*").withColumnRenamed("price_raw", "detail_price"))
    old = stored.select("url", *[F.col(c).alias(f"old_{c}") for c in ("ad_created_at", "fields", "description")])
    j = items.join(found, "url", "left").join(old, "url", "left")

    def value(new, kept):
        return F.coalesce(F.when(F.col("visit"), F.col(new)).otherwise(F.col(kept)), F.lit(""))

    batch = j.select(
        "url", "first_seen_at", "last_seen_at", "brand", "model", "title", "seller_type",
        F.coalesce(F.nullif(F.col("price_raw"), F.lit("")), F.when(F.col("visit"), F.col("detail_price")), F.lit("")).alias("price_raw"),
        value("ad_created_at", "old_ad_created_at").alias("ad_created_at"),
        value("fields_json", "old_fields").alias("fields"),
        value("description", "old_description").alias("description"))
    new = snapshot.upsert(stored, batch, F.col("last_seen_at"), VALUES)
    flags = items.select("url", "visit")
    out = new.join(flags, "url", "left").withColumn("seen", F.col("visit").isNotNull())
    return snapshot.with_expired(out.withColumn("visit", F.coalesce("visit", F.lit(False))), as_of, days)


def statistics(snapshot_rows: DataFrame) -> DataFrame:
    """A4/A11 of one crawl, in one pass over its snapshot."""
    return snapshot_rows.agg(
        F.count_if("seen").alias("n_seen"), F.count_if("visit").alias("n_new"),
        F.count_if(F.col("seen") & ~F.col("visit")).alias("n_known"),
        F.count_if(F.col("brand") == catalog.UNKNOWN_BRAND).alias("n_unknown_brand"),
        F.count_if("expired").alias("n_removed"), F.count_if(~F.col("expired")).alias("n_kept"))
