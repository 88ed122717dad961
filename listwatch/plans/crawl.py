"""The crawl as one query over ``pages``: every third page was crawled
before and gives the stored snapshot, all others are the new crawl. Page n was
fetched n hours into 2024; brand names are the short card titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwatch.operators import crawl
from listwatch.plans.pages import _ANCHOR, _LABEL, _VALUE, CANON_SQL, DETAIL, FEED, STRIP_SQL, external_sql
from listwatch.plans.registry import register
from listwatch.sources import tables as T

START = "2024-01-01"
DAYS = 5


def _crawl(spark, sf_dir):
    p = T.table(spark, sf_dir, "pages").select(
        "page_id", "url", "html", (F.lit(START).cast("timestamp") + F.make_dt_interval(hours=F.col("page_id").cast("int"))).alias("seen_at"))
    before, now = p.filter(F.col("page_id") % 3 == 0), p.filter(F.col("page_id") % 3 != 0)
    stored = crawl.feed_items(before, FEED).withColumn("brand", F.lit("Unknown"))
    for c in ("model", "ad_created_at", "fields", "description"):
        stored = stored.withColumn(c, F.lit(""))
    brands = crawl.feed_items(p, FEED).filter(F.length("title").between(4, 6)).select(F.col("title").alias("brand"))
    as_of = p.select(F.max("seen_at")).scalar()
    return crawl.ingest(now, stored, brands, as_of, FEED, DETAIL, DAYS)


_CRAWL_SQL = f"""
p AS (SELECT page_id, url, html, TIMESTAMP '{START}' + to_hours(CAST(page_id AS INTEGER)) AS seen_at FROM pages),
a AS (SELECT page_id, seen_at, unnest(regexp_extract_all(html, '{_ANCHOR}', 1)) AS attrs,
             unnest(regexp_extract_all(html, '{_ANCHOR}', 2)) AS body,
             unnest(range(0, len(regexp_extract_all(html, '{_ANCHOR}', 1)))) AS pos FROM p),
c AS (SELECT page_id, seen_at, pos, regexp_extract(attrs, '(?i)href="([^"]*)"', 1) AS raw_href,
             lower(regexp_extract(attrs, '(?i)class="([^"]*)"', 1)) AS cls, trim({STRIP_SQL.format(x='body')}) AS title FROM a),
d AS (SELECT *, {CANON_SQL.format(u='raw_href')} AS url FROM c WHERE raw_href <> '' AND NOT {external_sql('raw_href')}),
f AS (SELECT page_id, seen_at, url, min(pos) AS pos, arg_min(title, pos) AS title,
             arg_min(CASE WHEN contains(cls, 'agency') THEN 'agency' ELSE 'private' END, pos) AS seller_type
      FROM d WHERE url <> '' GROUP BY ALL),
every AS (SELECT url, arg_max(title, (page_id, pos)) AS title FROM f GROUP BY url),
names AS (SELECT DISTINCT title AS b FROM every WHERE length(title) BETWEEN 4 AND 6),
st AS (SELECT url, min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at, arg_max(title, (page_id, pos)) AS title,
              arg_max(seller_type, (page_id, pos)) AS seller_type FROM f WHERE page_id % 3 = 0 GROUP BY url),
it AS (SELECT url, min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at, arg_max(title, (page_id, pos)) AS title,
              arg_max(seller_type, (page_id, pos)) AS seller_type FROM f WHERE page_id % 3 <> 0 GROUP BY url),
br AS (SELECT url, arg_max(b, length(b)) AS brand FROM it JOIN names ON title = b OR starts_with(title, b || ' ') GROUP BY url),
dt AS (SELECT page_id, {CANON_SQL.format(u='url')} AS url,
              {STRIP_SQL.format(x="regexp_extract(html, '(?is)<p[^>]*>(.*?)</p>', 1)")} AS description,
              list_transform(regexp_extract_all(html, '{_LABEL}', 1), lambda x: {STRIP_SQL.format(x='x')}) AS labels,
              list_transform(regexp_extract_all(html, '{_VALUE}', 1), lambda x: {STRIP_SQL.format(x='x')}) AS vals
       FROM p WHERE page_id % 3 <> 0),
du AS (SELECT url, max(page_id) AS page_id, arg_max(description, page_id) AS description FROM dt GROUP BY url),
kv AS (SELECT page_id, unnest(labels[1:least(len(labels), len(vals))]) AS k, unnest(vals[1:least(len(labels), len(vals))]) AS v,
              unnest(range(0, least(len(labels), len(vals)))) AS i FROM dt),
nf AS (SELECT page_id, count(DISTINCT k) AS n_fields FROM kv WHERE k <> '' GROUP BY page_id),
snap AS (
    SELECT coalesce(it.url, st.url) AS url, coalesce(st.first_seen_at, it.first_seen_at) AS first_seen_at,
           coalesce(it.last_seen_at, st.last_seen_at) AS last_seen_at,
           CASE WHEN it.url IS NULL THEN 'Unknown' ELSE coalesce(br.brand, 'Unknown') END AS brand,
           CASE WHEN it.url IS NULL OR br.brand IS NULL THEN '' ELSE trim(substr(it.title, length(br.brand) + 1)) END AS model,
           coalesce(it.title, st.title) AS title, coalesce(it.seller_type, st.seller_type) AS seller_type,
           CASE WHEN it.url IS NOT NULL AND st.url IS NULL THEN coalesce(du.description, '') ELSE '' END AS description,
           CASE WHEN it.url IS NOT NULL AND st.url IS NULL AND du.url IS NOT NULL THEN coalesce(nf.n_fields, 0) ELSE 0 END AS n_fields,
           it.url IS NOT NULL AND st.url IS NULL AS visit, it.url IS NOT NULL AS seen
    FROM it FULL JOIN st ON st.url = it.url LEFT JOIN br ON br.url = it.url LEFT JOIN du ON du.url = it.url
    LEFT JOIN nf ON nf.page_id = du.page_id),
res AS (SELECT *, last_seen_at < (SELECT max(seen_at) FROM p) - INTERVAL {DAYS} DAY AS expired FROM snap)"""


@register("crawl_ingest", "S2 S3 P1 P2 P10 P11 J3 J4 M1 M6 U1 U2 T4", oracle=f"""WITH {_CRAWL_SQL.strip()}
SELECT url, brand, model, title, '' AS price_raw, seller_type, '' AS ad_created_at, description, n_fields,
       first_seen_at, last_seen_at, visit, seen, expired FROM res""")
def crawl_ingest(spark, sf_dir):
    fields = F.from_json("fields", "map<string,string>")
    return _crawl(spark, sf_dir).select(
        "url", "brand", "model", "title", "price_raw", "seller_type", "ad_created_at", "description",
        F.when(F.col("fields") == "", 0).otherwise(F.size(fields)).cast("bigint").alias("n_fields"),
        "first_seen_at", "last_seen_at", "visit", "seen", "expired")


@register("crawl_summary", "A4 A11", oracle=f"""WITH {_CRAWL_SQL.strip()}
SELECT count(*) FILTER (WHERE seen) AS n_seen, count(*) FILTER (WHERE visit) AS n_new,
       count(*) FILTER (WHERE seen AND NOT visit) AS n_known, count(*) FILTER (WHERE brand = 'Unknown') AS n_unknown_brand,
       count(*) FILTER (WHERE expired) AS n_removed, count(*) FILTER (WHERE NOT expired) AS n_kept FROM res""")
def crawl_summary(spark, sf_dir):
    return crawl.statistics(_crawl(spark, sf_dir))
