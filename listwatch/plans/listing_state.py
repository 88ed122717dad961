"""Queries of build step 2: listing state (upsert, touch, expiry, cleanup),
price history and crawl statistics.

A crawl batch is the sightings from ``SPLIT`` on; the stored snapshot is
loaded from the sightings before it (``tables.stored_listings``). Both halves
together cover the whole lineitem table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from listwatch.operators import distinct, prices, snapshot
from listwatch.plans.oracle_views import with_views
from listwatch.plans.registry import register
from listwatch.session import SharedTables, checkpoint_dir
from listwatch.sources import tables as T
from listwatch.sources.dated import DatedListings

SPLIT = T.CRAWL_SPLIT
EXPIRY_DAYS = 180
CRAWL_WINDOW_DAYS = 90
ORDER_SQL = "seen_at, o_key, line_no, x_price, s_key"


@register("listing_upsert", "M1 M2 P11 U2 Q17", oracle=with_views(["sightings"], f"""
SELECT url, min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at,
       arg_max_null(price_raw, ({ORDER_SQL})) AS price_raw, arg_max_null(price, ({ORDER_SQL})) AS price,
       arg_max_null(seller_type, ({ORDER_SQL})) AS seller_type
FROM sightings GROUP BY url"""))
def listing_upsert(spark, sf_dir):
    """What the snapshot job has stored after the crawl batch was merged in."""
    return T.stored_sightings(spark, sf_dir).select("url", "first_seen_at", "last_seen_at", "price_raw", "price", "seller_type")


_TOUCH_CTES = [
    ("old", f"""SELECT p.p_brand AS brand, p.p_type AS model, f.* FROM part p JOIN (
          SELECT url, min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at,
                 arg_max(price_raw, ({ORDER_SQL})) AS price_raw
          FROM sightings WHERE seen_at < TIMESTAMP '{SPLIT}' GROUP BY url) f
        ON f.url = CAST(p.p_partkey AS VARCHAR)"""),
    ("t", f"""SELECT url, seen_at, o_key, line_no, x_price, s_key,
             CASE seller_type WHEN 'agency' THEN 'Brand#' || CAST(s_key % 25 + 1 AS VARCHAR)
                              WHEN 'private' THEN 'Unknown' END AS brand,
             CASE seller_type WHEN 'agency' THEN 'TOUCHED' END AS model,
             CASE WHEN trim(price_raw) <> '' THEN price_raw END AS price_raw
      FROM sightings WHERE seen_at >= TIMESTAMP '{SPLIT}'"""),
    ("ta", f"""SELECT url, max(seen_at) AS t_last_seen_at,
              arg_max(brand, ({ORDER_SQL})) FILTER (WHERE brand IS NOT NULL AND trim(brand) NOT IN ('', 'Unknown')) AS t_brand,
              arg_max(model, ({ORDER_SQL})) FILTER (WHERE model IS NOT NULL AND trim(model) NOT IN ('', 'Unknown')) AS t_model,
              arg_max(price_raw, ({ORDER_SQL})) FILTER (WHERE price_raw IS NOT NULL) AS t_price_raw
       FROM t GROUP BY url"""),
]


_TOUCH_SQL = """
SELECT coalesce(old.url, ta.url) AS url,
       coalesce(t_brand, CASE WHEN trim(old.brand) NOT IN ('', 'Unknown') THEN old.brand END, old.brand) AS brand,
       coalesce(t_model, CASE WHEN trim(old.model) NOT IN ('', 'Unknown') THEN old.model END, old.model) AS model,
       coalesce(t_price_raw, old.price_raw) AS price_raw,
       coalesce(t_last_seen_at, old.last_seen_at) AS last_seen_at,
       coalesce(old.first_seen_at, t_last_seen_at) AS first_seen_at,
       t_last_seen_at IS NOT NULL AS touched,
       old.first_seen_at IS NULL AS inserted
FROM old FULL JOIN ta ON old.url = ta.url"""


def _before_and_touches(spark, sf_dir):
    old = T.stored_sightings(spark, sf_dir, T.LOADED).filter("in_catalog").select(
        "url", "brand", "model", "price_raw", "first_seen_at", "last_seen_at")
    touches = T.crawl_batch(spark, sf_dir).select(
        "url", "seen_at", "price_raw", *T.SIGHTING_ORDER[1:],
        F.when(F.col("seller_type") == "agency",
               F.concat(F.lit("Brand#"), (F.col("s_key") % 25 + 1).cast("string")))
        .when(F.col("seller_type") == "private", F.lit("Unknown")).alias("brand"),
        F.when(F.col("seller_type") == "agency", F.lit("TOUCHED")).alias("model"))
    return old, touches, T.sighting_seq(touches)


@register("listing_touch", "M3 M4 Q11", oracle=with_views(["sightings"], _TOUCH_SQL, extra=_TOUCH_CTES))
def listing_touch(spark, sf_dir):
    return snapshot.touch(*_before_and_touches(spark, sf_dir))


@register("listing_days", "M6 T4 M3 M4", oracle=with_views(["sightings"], f"""
SELECT url, brand, model, price_raw, first_seen_at, last_seen_at FROM ({_TOUCH_SQL})
WHERE last_seen_at IS NULL OR last_seen_at >= (SELECT max(seen_at) FROM sightings) - INTERVAL {EXPIRY_DAYS} DAY""", extra=_TOUCH_CTES))
def listing_days(spark, sf_dir):
    """Listings stored by their last sighting, touched by the crawl batch, expired by whole folders: by month, as the
    test tables hold a few listings a day over seven years."""
    stored = DatedListings(spark, f"{checkpoint_dir(spark).rstrip('/')}/listwatch-days-{uuid.uuid4().hex}", "month")
    old, touches, order = _before_and_touches(spark, sf_dir)
    stored.write(old)
    stored.touch(touches, order)
    stored.expire(T.newest_sighting(spark, sf_dir), EXPIRY_DAYS)
    stored.vacuum()
    return stored.read().select("url", "brand", "model", "price_raw", "first_seen_at", "last_seen_at")


@register("listing_expire", "M6 T4 A11", oracle=with_views(["listings"], f"""
SELECT url, last_seen_at,
       coalesce(last_seen_at < (SELECT max(seen_at) FROM sightings) - INTERVAL {EXPIRY_DAYS} DAY, false) AS expired
FROM listings"""))
def listing_expire(spark, sf_dir):
    lst = T.listings(spark, sf_dir).select("url", "last_seen_at")
    return snapshot.with_expired(lst, T.newest_sighting(spark, sf_dir), EXPIRY_DAYS)


@register("cohort_cleanup", "J6 M7 A5 U4", oracle=with_views(["sightings"], f"""
SELECT CAST(p_partkey AS VARCHAR) AS url, p_brand AS brand, p_type AS model FROM part p
WHERE (p_brand, p_type) IN (
        SELECT (p2.p_brand, p2.p_type) FROM seen JOIN part p2 ON seen.url = CAST(p2.p_partkey AS VARCHAR)
        WHERE coalesce(trim(p2.p_brand), '') NOT IN ('', 'Unknown'))
  AND CAST(p_partkey AS VARCHAR) NOT IN (SELECT url FROM seen)""", extra=[(
    "seen", f"""SELECT DISTINCT url FROM sightings
               WHERE seen_at >= (SELECT max(seen_at) FROM sightings) - INTERVAL {CRAWL_WINDOW_DAYS} DAY""")]))
def cohort_cleanup(spark, sf_dir):
    s = T.sightings(spark, sf_dir)
    crawl = s.filter(F.col("seen_at") >= T.newest_sighting(spark, sf_dir) - F.make_dt_interval(F.lit(CRAWL_WINDOW_DAYS)))
    parts = T.parts_as_listings(spark, sf_dir)
    seen = snapshot.seen_by_pair(crawl.select("url").distinct().join(parts, "url", "inner"))
    return snapshot.cohort_cleanup(parts, seen).select("url", "brand", "model")


@register("known_new_split", "J3", oracle=with_views(["sightings"], f"""
SELECT b.url, o.url IS NULL AS visit
FROM (SELECT DISTINCT url FROM sightings WHERE seen_at >= TIMESTAMP '{SPLIT}') b
LEFT JOIN (SELECT DISTINCT url FROM sightings WHERE seen_at < TIMESTAMP '{SPLIT}') o ON o.url = b.url"""))
def known_new_split(spark, sf_dir):
    old = T.stored_sightings(spark, sf_dir, T.LOADED)
    return snapshot.split_known(T.crawl_batch(spark, sf_dir).select("url").distinct(), old).select("url", "visit")


@register("delete_keys", "M5 A13 P10", oracle=with_views(["listings"], f"""
SELECT url FROM listings WHERE url NOT IN (
    SELECT url FROM sightings WHERE seller_type = 'agency' AND url IS NOT NULL AND url <> ''
      AND seen_at >= (SELECT max(seen_at) FROM sightings) - INTERVAL {CRAWL_WINDOW_DAYS} DAY)"""))
def delete_keys(spark, sf_dir):
    s = T.sightings(spark, sf_dir)
    keys = s.filter((F.col("seller_type") == "agency")
                    & (F.col("seen_at") >= T.newest_sighting(spark, sf_dir) - F.make_dt_interval(F.lit(CRAWL_WINDOW_DAYS))))
    return snapshot.delete_keys(T.listings(spark, sf_dir), keys).select("url")


_PREV_SQL = f"""
SELECT *, last_value(CASE WHEN trim(price_raw) <> '' THEN price_raw END IGNORE NULLS) OVER (
            PARTITION BY url ORDER BY {ORDER_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_price
FROM sightings"""


@register("price_change_log", "P16 X2 Q2 Q12 Q18 M4", oracle=with_views(["sightings"], """
SELECT url, seen_at, prev_price AS old_price, price_raw AS new_price,
       CASE WHEN TRY_CAST(regexp_replace(price_raw, '[^0-9]', '', 'g') AS DECIMAL(38,0))
                 > TRY_CAST(regexp_replace(prev_price, '[^0-9]', '', 'g') AS DECIMAL(38,0)) THEN 'up'
            WHEN TRY_CAST(regexp_replace(price_raw, '[^0-9]', '', 'g') AS DECIMAL(38,0))
                 < TRY_CAST(regexp_replace(prev_price, '[^0-9]', '', 'g') AS DECIMAL(38,0)) THEN 'down' END AS direction,
       o_key, line_no, x_price, s_key
FROM p WHERE trim(prev_price) <> '' AND trim(price_raw) <> ''
  AND regexp_replace(prev_price, '[^0-9]', '', 'g') <> regexp_replace(price_raw, '[^0-9]', '', 'g')""",
    extra=[("p", _PREV_SQL)]))
def price_change_log(spark, sf_dir):
    return prices.price_change_log(T.sightings(spark, sf_dir), T.SIGHTING_ORDER)


@register("crawl_stats", "A4", oracle=with_views(["sightings"], """
SELECT b.run, b.n_seen, b.n_urls, b.n_pages,
       coalesce(n.n_new, 0) AS n_new, coalesce(g.n_gone, 0) AS n_gone, coalesce(c.n_price_updates, 0) AS n_price_updates
FROM (SELECT date_trunc('month', seen_at) AS run, count(*) AS n_seen, count(DISTINCT url) AS n_urls,
             count(DISTINCT o_key) AS n_pages FROM sightings GROUP BY 1) b
LEFT JOIN (SELECT date_trunc('month', f) AS run, count(*) AS n_new
           FROM (SELECT min(seen_at) f FROM sightings GROUP BY url) GROUP BY 1) n ON n.run = b.run
LEFT JOIN (SELECT date_trunc('month', l) AS run, count(*) AS n_gone
           FROM (SELECT max(seen_at) l FROM sightings GROUP BY url) GROUP BY 1) g ON g.run = b.run
LEFT JOIN (SELECT date_trunc('month', seen_at) AS run, count(*) AS n_price_updates FROM p
           WHERE prev_price IS NOT NULL AND trim(price_raw) <> ''
             AND regexp_replace(prev_price, '[^0-9]', '', 'g') <> regexp_replace(price_raw, '[^0-9]', '', 'g')
           GROUP BY 1) c ON c.run = b.run""", extra=[("p", _PREV_SQL)]))
def crawl_stats(spark, sf_dir):
    """Sightings are reduced to one row per (url, run) together with their
    price updates; new and gone urls follow from each url's first and last
    run. The distinct feed pages of a run are counted by bitmaps."""
    s = T.sightings(spark, sf_dir)
    run = F.date_trunc("month", F.col("seen_at"))
    p = prices.with_previous_price(s, "url", T.SIGHTING_ORDER, run)
    updated = F.col("prev_price").isNotNull() & prices.price_changed(F.col("prev_price"), F.col("price_raw"), require_old=False)
    per_url = p.groupBy("url", run.alias("run")).agg(F.count(F.lit(1)).alias("n"), F.count_if(updated).alias("u"))
    life = Window.partitionBy("url")  # one row per run of the url
    per_url = per_url.withColumn("f", F.min("run").over(life)).withColumn("l", F.max("run").over(life))
    base = per_url.groupBy("run").agg(
        F.sum("n").alias("n_seen"), F.count("url").alias("n_urls"), F.count_if(F.col("run") == F.col("f")).alias("n_new"),
        F.count_if(F.col("run") == F.col("l")).alias("n_gone"), F.sum("u").alias("n_price_updates"))
    pages = distinct.count_keys(distinct.key_bitmaps(s, F.col("o_key"), [run.alias("run")]), ["run"], "n_pages")
    return base.join(pages, "run", "left").select("run", "n_seen", "n_urls", "n_pages", "n_new", "n_gone", "n_price_updates")


RANGE_RUNS = 12


@register("crawl_pages_range", "A4", oracle=with_views(["sightings"], f"""
SELECT r.run, count(DISTINCT s.o_key) AS n_pages
FROM (SELECT DISTINCT date_trunc('month', seen_at) AS run FROM sightings) r
JOIN (SELECT DISTINCT date_trunc('month', seen_at) AS run, o_key FROM sightings) s
  ON s.run <= r.run AND s.run > r.run - INTERVAL {RANGE_RUNS} MONTH
GROUP BY r.run"""))
def crawl_pages_range(spark, sf_dir):
    """Distinct feed pages of the RANGE_RUNS months that end with each run,
    from the stored bitmaps of the single runs."""
    s = T.sightings(spark, sf_dir)
    run = F.date_trunc("month", F.col("seen_at")).alias("run")
    stored = SharedTables(spark, "pages").save(distinct.key_bitmaps(s, F.col("o_key"), [run]), "bitmaps")
    ends = F.transform(F.sequence(F.lit(0), F.lit(RANGE_RUNS - 1)), lambda k: F.col("run") + F.make_ym_interval(F.lit(0), k))
    reached = stored.select(F.explode(ends).alias("run"), "bucket", "bits")
    return distinct.count_keys(reached, ["run"], "n_pages").join(stored.select("run").distinct(), "run", "left_semi")


@register("expiry_totals", "A11 M6", oracle=with_views(["listings"], f"""
SELECT count(*) FILTER (WHERE last_seen_at < (SELECT max(seen_at) FROM sightings) - INTERVAL {EXPIRY_DAYS} DAY)
           AS n_removed,
       count(*) FILTER (WHERE NOT coalesce(last_seen_at < (SELECT max(seen_at) FROM sightings)
                                           - INTERVAL {EXPIRY_DAYS} DAY, false)) AS n_kept
FROM listings"""))
def expiry_totals(spark, sf_dir):
    lst = T.listings(spark, sf_dir).select("url", "last_seen_at")
    flagged = snapshot.with_expired(lst, T.newest_sighting(spark, sf_dir), EXPIRY_DAYS)
    return flagged.agg(F.count_if("expired").alias("n_removed"), F.count_if(~F.col("expired")).alias("n_kept"))
