"""Queries of build step 8: the report table (K2), listing cards (X16,
X17, X19, X20) and banners (X5, X8, X10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwatch.functions import dates, labels
from listwatch.plans.oracle_views import with_views
from listwatch.plans.registry import register
from listwatch.sources import tables as T

BANNER_AS_OF = "2001-07-01 10:00:00"
ITEM_PREFIX = "https://www.example.com/vehicles/item/"
CARD_SPECS = 8

# report headers, in order (fixed values)
REPORT_COLUMNS = [
    ("url", "קישור"), ("ad_created_at", "פורסם"), ("brand", "יצרן"), ("model", "דגם"), ("price", "מחיר"),
    ("year", "שנה"), ("km", "ק״מ"), ("hands", "ידיים"), ("location", "מיקום"), ("seller_type", "סוג מודעה"),
    ("first_seen_at", "נראה לראשונה"), ("last_seen_at", "עודכן לאחרונה"),
]


# fixed values: other names under which rows may carry a report column
ALTERNATE_NAMES = {"url": ["link"], "price": ["amount"], "km": ["mileage"]}


def report_table(rows):
    """K2: the 12 report columns in order, with local headers, dd/MM/yyyy
    dates (X3), local seller type (X6), and the url as a link label plus a
    ``link_target`` column for the hyperlink. A column may come under an
    alternate name, in any case; the first non-empty one counts, and a
    column that is not there is empty."""
    H = dict(REPORT_COLUMNS)
    known = {c.lower() for c in rows.columns}

    def txt(c):
        names = [n for n in [c, *ALTERNATE_NAMES.get(c, [])] if n in known]
        return F.trim(F.coalesce(*[F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names], F.lit("")))

    return rows.select(
        F.when(txt("url") != "", F.lit(H["url"])).otherwise(F.lit("")).alias(H["url"]),
        txt("url").alias("link_target"),
        dates.format_date_only(txt("ad_created_at"), is_text=True).alias(H["ad_created_at"]),
        txt("brand").alias(H["brand"]), txt("model").alias(H["model"]), txt("price").alias(H["price"]),
        txt("year").alias(H["year"]), txt("km").alias(H["km"]), txt("hands").alias(H["hands"]),
        txt("location").alias(H["location"]), labels.seller_label(txt("seller_type")).alias(H["seller_type"]),
        dates.format_date_only(F.col("first_seen_at")).alias(H["first_seen_at"]),
        dates.format_date_only(F.col("last_seen_at")).alias(H["last_seen_at"]))


@register("report_rows", "K2 X3 X6", oracle=with_views(["listings"], """
SELECT CASE WHEN trim(url) <> '' THEN 'קישור' ELSE '' END AS "קישור", trim(url) AS link_target,
       coalesce(strftime(first_seen_at, '%d/%m/%Y'), '') AS "פורסם", trim(brand) AS "יצרן", trim(model) AS "דגם",
       trim(coalesce(price_raw, '')) AS "מחיר",
       coalesce(CAST(year(first_seen_at) AS VARCHAR), '') AS "שנה", coalesce(CAST(price % 300000 AS VARCHAR), '') AS "ק״מ",
       coalesce(CAST(price % 5 AS VARCHAR), '') AS "ידיים", split_part(trim(model), ' ', 1) AS "מיקום",
       CASE lower(trim(coalesce(seller_type, ''))) WHEN 'private' THEN 'פרטי' WHEN 'agency' THEN 'סוכנות'
            ELSE lower(trim(coalesce(seller_type, ''))) END AS "סוג מודעה",
       coalesce(strftime(first_seen_at, '%d/%m/%Y'), '') AS "נראה לראשונה",
       coalesce(strftime(last_seen_at, '%d/%m/%Y'), '') AS "עודכן לאחרונה"
FROM listings"""))
def report_rows(spark, sf_dir):
    lst = T.listings(spark, sf_dir)
    # url, price and km come under their alternate names
    rows = lst.select(F.col("url").alias("link"), F.date_format("first_seen_at", "dd/MM/yyyy").alias("ad_created_at"), "brand", "model",
                      F.col("price_raw").alias("Amount"), F.year("first_seen_at").cast("string").alias("Year"),
                      (F.col("price") % 300000).alias("mileage"), (F.col("price") % 5).alias("hands"),
                      F.split_part(F.trim("model"), F.lit(" "), F.lit(1)).alias("location"), "seller_type",
                      "first_seen_at", "last_seen_at")
    return report_table(rows)


_ESC = r"regexp_replace({x}, '([*_\[`])', '\\\1', 'g')"


def _esc(x: str) -> str:
    return _ESC.format(x=x)


_CARD_SQL = f"""
c AS (
    SELECT l.url, l.brand, l.model, l.price_raw, l.seller_type, l.first_seen_at, l.last_seen_at,
           CASE WHEN p.p_size % 5 = 0 THEN '' ELSE l.title END AS title, d.text AS description,
           list_filter(list_concat([
               {{'label': '{labels.SPEC_YEAR}', 'value': trim(coalesce(CAST(year(l.first_seen_at) AS VARCHAR), ''))}}], CASE WHEN p.p_size % 11 = 0 THEN [] ELSE [
               {{'label': 'Gearbox', 'value': CASE WHEN p.p_size % 2 = 0 THEN 'auto' ELSE '' END}},
               {{'label': 'Trim', 'value': trim(p.p_type)}},
               {{'label': 'Color', 'value': trim(split_part(p.p_name, ' ', 1))}},
               {{'label': 'size', 'value': CAST(p.p_size AS VARCHAR)}}] END), lambda e: e.value <> '')[1:{CARD_SPECS}] AS specs
    FROM listings l JOIN part p ON CAST(p.p_partkey AS VARCHAR) = l.url
    LEFT JOIN documents d ON CAST(d.doc_id AS VARCHAR) = l.url),
c2 AS (SELECT *, CASE WHEN trim(title) = '' THEN trim(concat_ws(' ', trim(brand), trim(model))) ELSE trim(title) END AS t,
              lower(trim(coalesce(seller_type, ''))) AS st FROM c)"""


@register("listing_cards", "X16 X17 X19 X20 X4 Q10", oracle=with_views(["listings"], f"""
SELECT url, CAST(len(specs) AS BIGINT) AS n_specs, substring(trim(concat_ws(chr(10),
    CASE WHEN t <> '' THEN '🚗 *' || {_esc('t')} || '*' END,
    CASE WHEN trim(coalesce(price_raw, '')) <> '' THEN '{labels.CARD_PRICE}: ' || {_esc('trim(price_raw)')} END,
    CASE WHEN st <> '' THEN CASE WHEN st = 'private' THEN '🙋 ' ELSE '🏢 ' END || '{labels.CARD_SELLER}: '
         || CASE WHEN st = 'private' THEN 'פרטי' ELSE 'סוכנות' END END,
    CASE WHEN len(specs) > 0 THEN array_to_string(list_transform(specs, lambda e:
         CASE WHEN e.label IN ('{labels.SPEC_YEAR}', '{labels.SPEC_LOCATION}', '{labels.SPEC_KM}', '{labels.SPEC_HANDS}')
              THEN e.label || ': ' || {_esc('e.value')}
              ELSE '• ' || {_esc('e.label')} || ': ' || {_esc('e.value')} END), chr(10)) END,
    CASE WHEN trim(coalesce(description, '')) <> '' THEN chr(10) || '{labels.CARD_DESCRIPTION}:' || chr(10) ||
         {_esc("CASE WHEN length(trim(description)) <= 360 THEN trim(description) ELSE rtrim(substring(trim(description), 1, 359)) || '…' END")} END,
    CASE WHEN first_seen_at IS NOT NULL OR last_seen_at IS NOT NULL THEN '' END,
    CASE WHEN first_seen_at IS NOT NULL THEN {_esc(f"'{labels.CARD_FIRST}: ' || strftime(first_seen_at, '%d/%m/%Y %H:%M')")} END,
    CASE WHEN last_seen_at IS NOT NULL THEN {_esc(f"'{labels.CARD_LAST}: ' || strftime(last_seen_at, '%d/%m/%Y %H:%M')")} END,
    chr(10) || '🔗 [{labels.CARD_LINK}](' || {_esc(f"'{ITEM_PREFIX}' || url")} || ')')), 1, {labels.CARD_MAX_CHARS}) AS card
FROM c2""", extra=[("c", _CARD_SQL.split("c AS (", 1)[1].rsplit("),\nc2 AS (", 1)[0]),
                   ("c2", _CARD_SQL.rsplit("c2 AS (", 1)[1].rstrip().rstrip(")"))]))
def listing_cards(spark, sf_dir):
    lst = T.listings(spark, sf_dir)
    p = T.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("url"), "p_size", "p_name", "p_type")
    docs = T.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("url"),
                                                       F.col("text").alias("description"))
    j = lst.join(p, "url").join(docs, "url", "left")
    stored = F.to_json(F.create_map(
        F.lit("Gearbox"), F.when(F.col("p_size") % 2 == 0, F.lit("auto")).otherwise(F.lit("")),
        F.lit("Trim"), F.col("p_type"),
        F.lit("Color"), F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)),
        F.lit("size"), F.col("p_size").cast("string")))
    # every eleventh listing's stored text is broken: it has no attributes
    fields = labels.fields_of_text(F.when(F.col("p_size") % 11 == 0, F.substring(stored, 1, 9)).otherwise(stored))
    specs = labels.spec_list(F.year("first_seen_at").cast("string"), F.lit(""), F.lit(""), F.lit(""), fields,
                             max_items=CARD_SPECS)
    title = F.when(F.col("p_size") % 5 == 0, F.lit("")).otherwise(F.col("title"))
    j = j.withColumn("_specs", specs)
    card = labels.listing_card(title, F.col("brand"), F.col("model"), F.col("price_raw"), F.lit(""),
                               F.col("seller_type"), F.col("_specs"), F.col("description"),
                               F.col("first_seen_at"), F.col("last_seen_at"),
                               F.concat(F.lit(ITEM_PREFIX), F.col("url")))
    return j.select("url", F.size("_specs").cast("bigint").alias("n_specs"), card.alias("card"))


_BANNER_RAW = """CASE o_orderpriority WHEN '1-URGENT' THEN 'היום' WHEN '2-HIGH' THEN 'אתמול'
         WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%d/%m/%Y') WHEN '5-LOW' THEN 'פורסם לפני שבוע'
         ELSE 'פורסם ב ' || strftime(o_orderdate, '%d/%m/%y') END"""


@register("banner", "X5 X8 X10 Q9", oracle=f"""
WITH b AS (
    SELECT o_orderkey AS order_key, {_BANNER_RAW} AS created_raw,
           CAST(o_orderdate AS TIMESTAMP) + to_days(CAST(o_orderkey % 3 AS INTEGER)) AS first_seen_at,
           CAST(timezone('{dates.LOCAL_ZONE}', TIMESTAMP '{BANNER_AS_OF}' AT TIME ZONE 'UTC') AS DATE) AS local_day
    FROM orders),
x AS (SELECT *, CASE
        WHEN regexp_extract(created_raw, '{dates.DMY_TOKEN}', 2) <> '' THEN regexp_extract(created_raw, '{dates.DMY_TOKEN}', 2)
        WHEN contains(trim(replace(created_raw, '{dates.RTL_MARK}', '')), '{dates.TODAY_WORD}') THEN strftime(local_day, '%d/%m/%y')
        WHEN contains(trim(replace(created_raw, '{dates.RTL_MARK}', '')), '{dates.YESTERDAY_WORD}')
             THEN strftime(local_day - 1, '%d/%m/%y')
        ELSE created_raw END AS ad_created_at FROM b),
y AS (SELECT *, coalesce(
        CASE WHEN regexp_extract(trim(ad_created_at), '{dates.DMY_PATTERN}', 1) <> '' THEN
             CAST(try_strptime(
                 CASE WHEN length(regexp_extract(trim(ad_created_at), '{dates.DMY_PATTERN}', 3)) = 2
                      THEN '20' ELSE '' END || regexp_extract(trim(ad_created_at), '{dates.DMY_PATTERN}', 3) || '-' ||
                 regexp_extract(trim(ad_created_at), '{dates.DMY_PATTERN}', 2) || '-' ||
                 regexp_extract(trim(ad_created_at), '{dates.DMY_PATTERN}', 1), '%Y-%m-%d') AS DATE) END,
        CASE WHEN trim(ad_created_at) = '{dates.TODAY_WORD}' THEN DATE '{BANNER_AS_OF[:10]}' END,
        CASE WHEN trim(ad_created_at) = '{dates.YESTERDAY_WORD}' THEN DATE '{BANNER_AS_OF[:10]}' - 1 END) AS created
      FROM x)
SELECT order_key, ad_created_at, strftime(created, '%Y-%m-%d') AS created_date,
       CASE WHEN created IS NOT NULL AND created = DATE '{BANNER_AS_OF[:10]}' THEN '{labels.BANNER_NEW}'
            WHEN created IS NOT NULL AND CAST(first_seen_at AS DATE) > created THEN '{labels.BANNER_BUMPED}'
            ELSE '{labels.BANNER_FALLBACK}' END AS banner
FROM y""")
def banner(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders")
    ts = F.col("o_orderdate").cast("timestamp")
    raw = (F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(dates.TODAY_WORD))
           .when(F.col("o_orderpriority") == "2-HIGH", F.lit(dates.YESTERDAY_WORD))
           .when(F.col("o_orderpriority") == "3-MEDIUM", F.date_format(ts, "dd/MM/yyyy"))
           .when(F.col("o_orderpriority") == "5-LOW", F.lit("פורסם לפני שבוע"))
           .otherwise(F.concat(F.lit("פורסם ב "), F.date_format(ts, "dd/MM/yy"))))
    as_of = F.lit(BANNER_AS_OF).cast("timestamp")
    b = o.select(F.col("o_orderkey").alias("order_key"), raw.alias("created_raw"),
                 (ts + F.make_dt_interval((F.col("o_orderkey") % 3).cast("int"))).alias("first_seen_at"))
    b = b.withColumn("ad_created_at", dates.ad_created_text(F.col("created_raw"), as_of))
    created = dates.parse_date_or_none(F.col("ad_created_at"), as_of)
    return b.select("order_key", "ad_created_at",
                    F.date_format(created, "yyyy-MM-dd").alias("created_date"),
                    labels.banner(F.col("ad_created_at"), F.col("first_seen_at"), as_of).alias("banner"))
