"""Queries of build step 6: URL canonicalisation and filtering, page-quality
flags, feed links and detail fields over the ``pages`` table.

Test markup (FIXTURES.md §2): the item id is the first ``/<digits>`` of a
URL, the site domain is ``example.com``; cards are the page's anchors and
the label/value pairs of a detail page are its navigation links.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from listwatch.functions import urls
from listwatch.functions.text import normalize_text
from listwatch.operators import extract
from listwatch.operators.markup import Select
from listwatch.plans.registry import register
from listwatch.sources import tables as T

ID_PATTERN = r"/([0-9]+)"
DOMAIN = "example.com"
PREFIX = "https://example.com/item/"
FEED = extract.FeedMarkup(require_seller_class=False, id_pattern=ID_PATTERN, canonical_prefix=PREFIX, domain=DOMAIN)
DETAIL = extract.DetailMarkup(label=Select("a"), label_attr="href", value=Select("a"), spec_box=Select("div", "class", "ad"),
                              spec_text=None)

# DuckDB twins of the Spark expressions
HOST_SQL = r"lower(regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^@/?#]*@)?([^:/?#]*)', 1))"
PATH_SQL = r"lower(regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^?#]*)', 1))"
CANON_SQL = (r"CASE WHEN {u} IS NULL OR {u} = '' THEN {u} "
             r"WHEN regexp_extract({u}, '/([0-9]+)', 1) <> '' THEN '" + PREFIX + r"' || regexp_extract({u}, '/([0-9]+)', 1) "
             r"ELSE split_part({u}, '?', 1) END")
STRIP_SQL = r"trim(regexp_replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
NORM_SQL = (r"""trim(regexp_replace(regexp_replace(lower({x}), '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{{|}}~]', ' ', 'g'),"""
            r""" '\s+', ' ', 'g'))""")


def external_sql(u: str) -> str:
    h, p = HOST_SQL.format(u=u), PATH_SQL.format(u=u)
    return (f"(({h} <> '' AND NOT ({h} = '{DOMAIN}' OR ends_with({h}, '.{DOMAIN}')))"
            f" OR contains({h}, 'konesy') OR contains({p}, 'konesy')"
            f" OR contains({h}, '/live/') OR contains({p}, '/live/'))")


@register("canonical_urls", "P1 U1", oracle=f"""
SELECT url, min(page_id) AS first_page_id, count(*) AS n_pages
FROM (SELECT page_id, {CANON_SQL.format(u='url')} AS url FROM pages) GROUP BY url""")
def canonical_urls(spark, sf_dir):
    p = T.table(spark, sf_dir, "pages").select("page_id", urls.canonical_url(F.col("url"), ID_PATTERN, PREFIX).alias("url"))
    return p.groupBy("url").agg(F.min("page_id").alias("first_page_id"), F.count(F.lit(1)).alias("n_pages"))


@register("external_filter", "P2 Q16", oracle=f"""
SELECT page_id, url, {HOST_SQL.format(u='url')} AS host, {external_sql('url')} AS rejected
FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN regexp_replace(url, '^https?:', '') ELSE url END AS url FROM pages)""")
def external_filter(spark, sf_dir):
    """Every fifth link has no scheme (//host/path): its host counts all the same."""
    bare = F.regexp_replace("url", "^https?:", "")
    p = T.table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 5 == 0, bare).otherwise(F.col("url")).alias("url"))
    return p.select("page_id", "url", urls.url_host(F.col("url")).alias("host"),
                    urls.is_external(F.col("url"), DOMAIN).alias("rejected"))


def _any(expr: str, needles) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{n}')" for n in needles) + ")"


_NEEDLES = sorted({n for n in (extract.normalize_needle(x) for x in extract.HARD_BLOCK_NEEDLES) if n})
_TITLE_SQL = r"trim(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1))"


@register("page_flags", "P7 P8 P9 X1 Q8 Q19", oracle=f"""
SELECT page_id, length(html) AS n_chars,
       coalesce(length(html), 0) < {extract.SOFT_BLOCK_MIN_CHARS}
           OR {_any("lower(coalesce(html, ''))", extract.SOFT_BLOCK_MARKERS)} AS soft_blocked,
       {NORM_SQL.format(x="coalesce(html, '')")} <> '' AND {_any(NORM_SQL.format(x="coalesce(html, '')"), _NEEDLES)}
           AS hard_blocked,
       {_any(f"lower(concat_ws(' ', {_TITLE_SQL}, substring(coalesce(html, ''), 1, {extract.BROKEN_PREFIX_CHARS})))",
             [s.replace("'", "''") for s in extract.BROKEN_SIGNATURES])} AS broken,
       md5({NORM_SQL.format(x="coalesce(html, '')")}) AS norm_md5
FROM pages""")
def page_flags(spark, sf_dir):
    p = T.table(spark, sf_dir, "pages")
    return extract.page_flags(p).select(
        "page_id", F.length("html").cast("bigint").alias("n_chars"), "soft_blocked", "hard_blocked", "broken",
        F.md5(normalize_text(F.coalesce(F.col("html"), F.lit("")))).alias("norm_md5"))


_ANCHOR = r"(?is)<a\b([^>]*)>(.*?)</a>"


@register("feed_links", "S2 P10 U1 X11 X12", oracle=f"""
WITH a AS (
    SELECT page_id, unnest(regexp_extract_all(html, '{_ANCHOR}', 1)) AS attrs,
           unnest(regexp_extract_all(html, '{_ANCHOR}', 2)) AS body,
           unnest(range(0, len(regexp_extract_all(html, '{_ANCHOR}', 1)))) AS pos
    FROM pages),
c AS (SELECT page_id, CAST(pos AS BIGINT) AS pos, regexp_extract(attrs, '(?i)href="([^"]*)"', 1) AS raw_href,
             lower(regexp_extract(attrs, '(?i)class="([^"]*)"', 1)) AS cls,
             trim({STRIP_SQL.format(x='body')}) AS title FROM a),
d AS (SELECT *, {CANON_SQL.format(u='raw_href')} AS url FROM c WHERE raw_href <> '' AND NOT {external_sql('raw_href')})
SELECT page_id, min(pos) AS pos, url, arg_min(raw_href, pos) AS raw_href, arg_min(title, pos) AS title,
       '' AS price_raw, arg_min(CASE WHEN contains(cls, 'agency') THEN 'agency' ELSE 'private' END, pos) AS seller_type
FROM d WHERE url <> '' GROUP BY page_id, url""")
def feed_links(spark, sf_dir):
    return extract.feed_links(T.table(spark, sf_dir, "pages"), FEED)


_LABEL = r'(?is)<li><a href="([^"]*)">'
_VALUE = r'(?is)<li><a href="[^"]*">(.*?)</a></li>'


@register("page_detail", "S3 X9 X12 X14 X15 J13", oracle=f"""
WITH d AS (
    SELECT page_id, url,
           {STRIP_SQL.format(x="regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS title,
           {STRIP_SQL.format(x="regexp_extract(html, '(?is)<div class=\"ad\">(.*?)</div>', 1)")} AS year_raw,
           {STRIP_SQL.format(x="regexp_extract(html, '(?is)<p[^>]*>(.*?)</p>', 1)")} AS description,
           list_transform(regexp_extract_all(html, '{_LABEL}', 1), lambda x: {STRIP_SQL.format(x='x')}) AS labels,
           list_transform(regexp_extract_all(html, '{_VALUE}', 1), lambda x: {STRIP_SQL.format(x='x')}) AS vals
    FROM pages),
kv AS (SELECT page_id, unnest(labels[1:least(len(labels), len(vals))]) AS k,
              unnest(vals[1:least(len(labels), len(vals))]) AS v,
              unnest(range(0, least(len(labels), len(vals)))) AS i FROM d),
f AS (SELECT page_id, count(*) AS n_fields, string_agg(k || '=' || v, '|' ORDER BY k) AS fields_digest,
             CAST(to_json(map(list(k ORDER BY k), list(v ORDER BY k))) AS VARCHAR) AS fields_json
      FROM (SELECT page_id, k, arg_max(v, i) AS v FROM kv WHERE k <> '' GROUP BY page_id, k) GROUP BY page_id)
SELECT d.page_id, d.title, d.year_raw, d.description, coalesce(f.n_fields, 0) AS n_fields,
       coalesce(f.fields_digest, '') AS fields_digest, coalesce(f.fields_json, '{{}}') AS fields_json
FROM d LEFT JOIN f USING (page_id)""")
def page_detail(spark, sf_dir):
    d = extract.page_detail(T.table(spark, sf_dir, "pages"), DETAIL)
    entries = F.array_sort(F.map_entries(F.col("fields")))
    return d.select("page_id", "title", "year_raw", "description",
                    F.size("fields").cast("bigint").alias("n_fields"),
                    F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
                    .alias("fields_digest"),
                    F.to_json(F.map_from_entries(entries)).alias("fields_json"))


@register("feed_dedupe", "U2 U1", oracle=f"""
WITH a AS (
    SELECT page_id, unnest(regexp_extract_all(html, '{_ANCHOR}', 1)) AS attrs,
           unnest(regexp_extract_all(html, '{_ANCHOR}', 2)) AS body,
           unnest(range(0, len(regexp_extract_all(html, '{_ANCHOR}', 1)))) AS pos
    FROM pages),
c AS (SELECT page_id, CAST(pos AS BIGINT) AS pos, regexp_extract(attrs, '(?i)href="([^"]*)"', 1) AS raw_href,
             trim({STRIP_SQL.format(x='body')}) AS title FROM a),
d AS (SELECT *, {CANON_SQL.format(u='raw_href')} AS url FROM c WHERE raw_href <> '' AND NOT {external_sql('raw_href')}),
f AS (SELECT page_id, url, min(pos) AS pos, arg_min(raw_href, pos) AS raw_href, arg_min(title, pos) AS title
      FROM d WHERE url <> '' GROUP BY page_id, url)
SELECT url, arg_min(page_id, (page_id, pos)) AS first_page_id, arg_min(pos, (page_id, pos)) AS first_pos,
       arg_max(title, (page_id, pos)) AS title, arg_max(raw_href, (page_id, pos)) AS raw_href,
       count(*) AS n_seen
FROM f GROUP BY url""")
def feed_dedupe(spark, sf_dir):
    """U2 across the whole feed: per url the values of its *last* card, kept
    at the position of its *first* card (page order, then card order)."""
    f = extract.feed_links(T.table(spark, sf_dir, "pages"), FEED)
    order = F.struct("page_id", "pos")
    return (f.groupBy("url")
            .agg(F.min(order).alias("_first"), F.max_by(F.struct("title", "raw_href"), order).alias("_last"),
                 F.count(F.lit(1)).alias("n_seen"))
            .select("url", F.col("_first.page_id").alias("first_page_id"), F.col("_first.pos").alias("first_pos"),
                    "_last.title", "_last.raw_href", "n_seen"))


#: A detail block as three sites would write it: single quotes, attributes in another order, divs within divs. {p}, {c},
#: {d}, {y}, {k} stand for price, place, date, year and km.
BLOCKS = (
    """<div class="details-item_detailsItemBox__1"><span>{y}</span></div><div class="details-item_detailsItemBox__1"><span>{k}</span><span>ק״מ</span></div>"""
    """<span data-testid="price">₪ {p}</span><span data-testid="location">{c}</span><span class="report-ad_createdAt__x">ב {d}</span>"""
    """<dd class="item-detail_label__1">color</dd><dt class="item-detail_value__1">{c}</dt>""",
    """<DIV class='x details-item_detailsItemBox__1'><span>{y}</span></DIV><div class='details-item_detailsItemBox__1'><span>{k}</span><span>ק״מ</span></div>"""
    """<span class='agency-box' data-testid='price'>₪ {p}</span ><span data-testid = 'location'>{c}</span><span title='a > b' class='report-ad_createdAt__x'>ב {d}</span>"""
    """<dd class='item-detail_label__1'>color</dd><dt class='item-detail_value__1'>{c}</dt>""",
    """<div id=1 class="details-item_detailsItemBox__1"><div><div></div><span>{y}</span></div></div><!-- <span data-testid="price">no</span> -->"""
    """<div data-n="1" class="details-item_detailsItemBox__1"><div><span>{k}</span></div><div><div><span>ק״מ</span></div></div></div>"""
    """<span id='p' data-testid=price><span>₪</span> <b>{p}</b></span><span class="l" data-testid="location"><span></span>{c}</span>"""
    """<span data-class="report-ad_createdAt">no</span><span id="r" class="report-ad_createdAt__x"><span>ב</span> {d}</span>"""
    """<dd id="l" class="item-detail_label__1">color</dd><dt id="v" class="item-detail_value__1"><div>{c}</div></dt>""",
)
_PLACES = ("north", "coast", "hills", "south")
_FIELDS_SQL = f"""SELECT page_id, url, html, CAST(1000 + page_id * 37 AS VARCHAR) AS p, (['{"', '".join(_PLACES)}'])[page_id % {len(_PLACES)} + 1] AS c,
    lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') || '/' || lpad(CAST(page_id % 12 + 1 AS VARCHAR), 2, '0') || '/24' AS d,
    CAST(2000 + page_id % 24 AS VARCHAR) AS y, CAST(page_id * 11 AS VARCHAR) AS k FROM pages"""


@register("page_fields", "S3 X9 X10 X11 X14 J13 P11", oracle=f"""
SELECT page_id, url, {STRIP_SQL.format(x="regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS title, '₪ ' || p AS price_raw,
       y AS year_raw, k || ' ק״מ' AS km_raw, c AS location, 'ב ' || d AS created_raw, d AS ad_created_at,
       CASE WHEN page_id % 3 = 1 THEN 'agency' ELSE 'private' END AS seller_type, '{{"color":"' || c || '"}}' AS fields_json
FROM ({_FIELDS_SQL})""")
def page_fields(spark, sf_dir):
    """Every page with a detail block derived from its id put before its end, in one of three spellings; the default markup
    reads them alike."""
    n = F.col("page_id")
    place = F.get(F.array(*[F.lit(x) for x in _PLACES]), (n % len(_PLACES)).cast("int"))
    day = F.concat(F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lit("/"), F.lpad((n % 12 + 1).cast("string"), 2, "0"), F.lit("/24"))
    block = F.get(F.array(*[F.lit(b) for b in BLOCKS]), (n % len(BLOCKS)).cast("int"))
    for mark, value in (("{p}", (1000 + n * 37).cast("string")), ("{c}", place), ("{d}", day), ("{y}", (2000 + n % 24).cast("string")),
                        ("{k}", (n * 11).cast("string"))):
        block = F.replace(block, F.lit(mark), value)
    end = "</body></html>"
    p = T.table(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.replace("html", F.lit(end), F.lit("")), block, F.lit(end)).alias("html"))
    found = extract.page_detail(p, as_of=F.lit("2024-06-01").cast("timestamp"))
    return found.select("page_id", "url", "title", "price_raw", "year_raw", "km_raw", "location", "created_raw", "ad_created_at",
                        "seller_type", "fields_json")
