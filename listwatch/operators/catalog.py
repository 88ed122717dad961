"""The brand/model catalog: nested JSON writer and reader (K4, S1), brand
resolution by longest prefix (J4, X13, O3), name -> catalog position
resolution (J5, U5) and selection URLs (A12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listwatch.functions.text import strip_prefix
from listwatch.operators.windows import row_number_split

CATALOG_SCHEMA = T.StructType([
    T.StructField("index", T.IntegerType()),
    T.StructField("brand", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("models", T.ArrayType(T.StructType([
        T.StructField("index", T.IntegerType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("model_value", T.StringType()),
    ]))),
])
UNKNOWN_BRAND = "Unknown"
BASE_URL = "https://www.example.com/vehicles/cars"


def build_catalog(rows: DataFrame) -> DataFrame:
    """K4: nest (brand, brand_value, model_name, model_value) rows into one
    row per brand with its models. Rows with an empty model name are dropped;
    indexes follow name order. Grouping is by brand, so each brand's model
    list is bounded by the catalog, not by the data."""
    r = rows.filter(F.trim(F.coalesce(F.col("model_name"), F.lit(""))) != "").select(
        "brand", "brand_value", "model_name", "model_value").distinct()
    per_brand = (r.groupBy("brand", "brand_value")
                 .agg(F.array_sort(F.collect_list(F.struct("model_name", "model_value"))).alias("_m")))
    models = F.transform(F.col("_m"), lambda m, i: F.struct(
        i.alias("index"), m["model_name"].alias("model_name"), m["model_value"].alias("model_value")))
    # brand positions: brand names only, numbered per leading characters
    # plus the count of the names before them; models stay where they are
    names = row_number_split(r.select("brand", "brand_value").distinct(), [], ["brand", "brand_value"],
                             F.substring("brand", 1, 3), "_n").withColumn("_b", F.struct("brand", "brand_value"))
    tree = per_brand.withColumn("_b", F.struct("brand", "brand_value"))
    return tree.join(names.select("_b", (F.col("_n") - 1).cast("int").alias("index")), "_b").select(
        "index", "brand", F.col("brand_value").alias("value"), models.alias("models"))


def write_catalog(tree: DataFrame, path: str) -> None:
    tree.coalesce(1).write.mode("overwrite").json(path)


def read_catalog(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The nested catalog with a fixed schema (no inference)."""
    return spark.read.schema(CATALOG_SCHEMA).json(path, multiLine=multi_line)


def flatten_catalog(tree: DataFrame) -> DataFrame:
    """One row per brand/model; a brand without models keeps one row with
    NULL model columns."""
    return tree.select(
        F.col("index").alias("brand_index"), "brand", F.col("value").alias("brand_value"),
        F.explode_outer("models").alias("m")).select(
        "brand_index", "brand", "brand_value",
        F.col("m.index").alias("model_index"), F.col("m.model_name").alias("model_name"),
        F.col("m.model_value").alias("model_value"))


def resolve_brands(items: DataFrame, brands: DataFrame, selected: DataFrame | None = None,
                   title: str = "title", key: str = "url") -> DataFrame:
    """brand = the catalog name equal to the title or followed by a
    space in it; selected brands are tried before all brands, longer names
    first; the model is the rest of the title (X13); no match -> 'Unknown'
    with model ''.

    Scale form: the title's word prefixes are exploded and equi-joined to the
    catalog names, so no listing is compared with every brand. The number
    of prefixes is bounded by the longest catalog name (in words), read from
    the catalog itself, so every possible match is produced.
    """
    names = brands.select(F.col("brand").alias("_b")).distinct()
    if selected is not None:
        sel = selected.select(F.col("brand").alias("_b")).distinct().withColumn("_sel", F.lit(1))
        names = names.unionByName(sel.select("_b"), allowMissingColumns=False).distinct() \
            .join(sel, "_b", "left").withColumn("_sel", F.coalesce("_sel", F.lit(0)))
    else:
        names = names.withColumn("_sel", F.lit(0))
    max_words = names.select(F.max(F.size(F.split("_b", " ")))).scalar()
    words = F.split(F.col(title), " ")
    # the bound is a scalar subquery; it is projected first because Spark
    # does not allow subqueries inside higher-order functions
    bounded = items.select(key, title, F.least(F.size(words), max_words).alias("_n"))
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.col("_n"), F.lit(1))),
                           lambda i: F.array_join(F.slice(F.split(F.col(title), " "), 1, i), " "))
    cand = bounded.select(key, title, F.explode(prefixes).alias("_p"))
    hits = cand.join(names, cand["_p"] == names["_b"], "inner")
    w = Window.partitionBy(key).orderBy(F.col("_sel").desc(), F.length("_b").desc(), F.col("_b"))
    best = (hits.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1)
            .select(key, F.col("_b").alias("_brand")))
    out = items.join(best, key, "left")
    return out.withColumn("brand", F.coalesce(F.col("_brand"), F.lit(UNKNOWN_BRAND))) \
        .withColumn("model", F.when(F.col("_brand").isNull(), F.lit(""))
                    .otherwise(strip_prefix(F.col(title), F.col("_brand")))) \
        .drop("_brand")


def resolve_selection(selection: DataFrame, flat: DataFrame) -> DataFrame:
    """A user's brand and model *names* -> catalog positions.
    A brand is chosen when its name is in the user's brand names (exact);
    a model of a chosen brand when its label - model name, or the model value
    when the name is empty - is in the user's model names."""
    label = F.coalesce(F.nullif(F.col("model_name"), F.lit("")), F.col("model_value").cast("string"))
    sb = selection.select("user_id", F.col("brand").alias("brand")).distinct()
    sm = selection.select("user_id", F.col("model").alias("_label")).filter(F.col("_label") != "").distinct()
    brands = flat.select("brand_index", "brand", "brand_value").distinct().join(sb, "brand", "inner")
    models = (flat.filter(F.col("model_index").isNotNull()).withColumn("_label", label)
              .join(brands.select("user_id", "brand"), "brand", "inner")
              .join(sm, ["user_id", "_label"], "left_semi"))
    return brands, models


def selection_url(brand_values: Column, model_values: Column, base: str = BASE_URL) -> Column:
    """One URL for a whole selection, codes joined with commas."""
    return F.concat(F.lit(base), F.lit("?manufacturer="), F.array_join(brand_values, ","),
                    F.lit("&model="), F.array_join(model_values, ","))
