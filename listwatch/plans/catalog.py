"""Queries of build step 7: the catalog tree, brand resolution and
selection URLs, with the catalog derived from ``part``: brand = p_brand,
brand value = its number, models = the brand's part types."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwatch.operators import catalog
from listwatch.plans.oracle_views import with_views
from listwatch.plans.registry import register
from listwatch.sources import tables as T

SELECTED_BRANDS = ("Brand#1", "Brand#2", "Brand#3")
TWO_WORD_FIRST = ("small", "large")


def catalog_rows(spark, sf_dir):
    p = T.table(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("brand"),
                    F.regexp_extract("p_brand", "([0-9]+)$", 1).alias("brand_value"),
                    F.col("p_type").alias("model_name"), F.lower("p_type").alias("model_value"))


def catalog_tree_df(spark, sf_dir):
    """K4 then S1: the tree goes through its JSON text form and is read back
    with the fixed catalog schema."""
    tree = catalog.build_catalog(catalog_rows(spark, sf_dir))
    text = tree.select(F.to_json(F.struct(*tree.columns)).alias("j"))
    return text.select(F.from_json("j", catalog.CATALOG_SCHEMA).alias("c")).select("c.*")


_FLAT_BODY = """
    SELECT b.brand_index, b.brand, b.brand_value, m.model_index, m.model_name, m.model_value
    FROM (SELECT brand, brand_value, CAST(row_number() OVER (ORDER BY brand, brand_value) - 1 AS INTEGER) AS brand_index
          FROM (SELECT DISTINCT p_brand AS brand, regexp_extract(p_brand, '([0-9]+)$', 1) AS brand_value FROM part)) b
    JOIN (SELECT brand, model_name, model_value,
                 CAST(row_number() OVER (PARTITION BY brand ORDER BY model_name, model_value) - 1 AS INTEGER) AS model_index
          FROM (SELECT DISTINCT p_brand AS brand, p_type AS model_name, lower(p_type) AS model_value FROM part
                WHERE trim(coalesce(p_type, '')) <> '')) m USING (brand)"""
_FLAT_SQL = f"flat AS ({_FLAT_BODY})"


@register("catalog_tree", "K4 S1", oracle=f"""WITH {_FLAT_SQL.strip()}
SELECT * FROM flat""")
def catalog_tree(spark, sf_dir):
    return catalog.flatten_catalog(catalog_tree_df(spark, sf_dir))


def _titles_sql() -> str:
    return """SELECT CAST(p_partkey AS VARCHAR) AS url,
                     CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_brand || ' ' || p_name END AS title FROM part"""


@register("brand_resolution", "J4 X13 O3", oracle=f"""
WITH t AS ({_titles_sql()}),
names AS (SELECT DISTINCT p_brand AS b FROM part
          UNION SELECT DISTINCT p_brand || ' ' || split_part(p_name, ' ', 1) FROM part
          WHERE split_part(p_name, ' ', 1) IN {TWO_WORD_FIRST}),
ranked AS (SELECT t.url, n.b, row_number() OVER (
               PARTITION BY t.url ORDER BY (n.b IN {SELECTED_BRANDS}) DESC, length(n.b) DESC, n.b) AS r
           FROM t JOIN names n ON t.title = n.b OR starts_with(t.title, n.b || ' '))
SELECT t.url, t.title, coalesce(r.b, 'Unknown') AS brand,
       CASE WHEN r.b IS NULL THEN '' ELSE trim(substring(t.title, length(r.b) + 1)) END AS model
FROM t LEFT JOIN (SELECT * FROM ranked WHERE r = 1) r USING (url)""")
def brand_resolution(spark, sf_dir):
    p = T.table(spark, sf_dir, "part")
    items = p.select(F.col("p_partkey").cast("string").alias("url"),
                     F.when(F.col("p_size") % 3 == 0, F.col("p_name"))
                     .otherwise(F.concat_ws(" ", "p_brand", "p_name")).alias("title"))
    first = F.split_part(F.col("p_name"), F.lit(" "), F.lit(1))
    brands = (p.select(F.col("p_brand").alias("brand"))
              .unionByName(p.filter(first.isin(*TWO_WORD_FIRST))
                           .select(F.concat_ws(" ", "p_brand", first).alias("brand"))))
    selected = brands.filter(F.col("brand").isin(*SELECTED_BRANDS))
    return catalog.resolve_brands(items, brands, selected).select("url", "title", "brand", "model")


@register("combined_codes", "A12 J5 U5", oracle=with_views(["subscriptions"], f"""
SELECT b.user_id,
       string_agg(CAST(b.brand_index + 1 AS VARCHAR), ',' ORDER BY b.brand_index) AS brand_positions,
       string_agg(b.brand, ' + ' ORDER BY b.brand_index) AS brand_names,
       '{catalog.BASE_URL}?manufacturer=' || string_agg(b.brand_value, ',' ORDER BY b.brand_index) || '&model='
           || coalesce(max(mm.models), '') AS combined_url
FROM b LEFT JOIN (SELECT user_id, string_agg(model_value, ',' ORDER BY brand_index, model_index) AS models
                  FROM m GROUP BY user_id) mm USING (user_id)
GROUP BY b.user_id""", extra=[
    ("flat", _FLAT_BODY),
    ("sel", """SELECT DISTINCT user_id, upper(substring(brand, 1, 1)) || lower(substring(brand, 2)) AS brand,
                      upper(model) AS model FROM subscriptions"""),
    ("b", """SELECT DISTINCT sel.user_id, f.brand_index, f.brand, f.brand_value
             FROM (SELECT DISTINCT brand_index, brand, brand_value FROM flat) f JOIN sel USING (brand)"""),
    ("m", """SELECT DISTINCT b.user_id, f.brand_index, f.model_index, f.model_value FROM flat f
             JOIN b USING (brand_index)
             WHERE (b.user_id, coalesce(nullif(f.model_name, ''), f.model_value))
                   IN (SELECT (user_id, model) FROM sel WHERE model <> '')"""),
]))
def combined_codes(spark, sf_dir):
    s = T.subscriptions(spark, sf_dir)
    sel = s.select("user_id", F.initcap("brand").alias("brand"), F.upper("model").alias("model"))
    flat = catalog.flatten_catalog(catalog_tree_df(spark, sf_dir))
    brands, models = catalog.resolve_selection(sel, flat)
    b = (brands.groupBy("user_id")
         .agg(F.array_sort(F.collect_list(F.struct("brand_index", "brand", "brand_value"))).alias("bs")))
    m = (models.groupBy("user_id")
         .agg(F.array_sort(F.collect_list(F.struct("brand_index", "model_index", "model_value"))).alias("ms")))
    j = b.join(m, "user_id", "left")
    mv = F.coalesce(F.transform("ms", lambda x: x["model_value"]), F.array().cast("array<string>"))
    return j.select(
        "user_id",
        F.array_join(F.transform("bs", lambda x: (x["brand_index"] + 1).cast("string")), ",").alias("brand_positions"),
        F.array_join(F.transform("bs", lambda x: x["brand"]), " + ").alias("brand_names"),
        catalog.selection_url(F.transform("bs", lambda x: x["brand_value"]), mv).alias("combined_url"))
