"""Catalog: brand prefix resolution (J4), tree round trip."""

from listwatch.operators import catalog
from tests.conftest import rows


def test_brand_prefix_j4(spark):
    items = spark.createDataFrame([("1", "Alfa Romeo Giulia"), ("2", "Alfa"), ("3", "Alfabet"), ("4", "Alfa Romeo")],
                                  "url string, title string")
    brands = spark.createDataFrame([("Alfa",), ("Alfa Romeo",)], "brand string")
    out = rows(catalog.resolve_brands(items, brands), "url", "brand", "model")
    assert out == [("1", "Alfa Romeo", "Giulia"), ("2", "Alfa", ""), ("3", "Unknown", ""), ("4", "Alfa Romeo", "")]
    # selected brands are tried first, even when shorter
    sel = spark.createDataFrame([("Alfa",)], "brand string")
    out = rows(catalog.resolve_brands(items, brands, sel), "url", "brand", "model")
    assert out[0] == ("1", "Alfa", "Romeo Giulia")


def test_catalog_round_trip_k4_s1(spark, tmp_path):
    r = spark.createDataFrame([("B", "2", "y", "v2"), ("B", "2", "x", "v1"), ("A", "1", "", "v0"), ("A", "1", "z", "v3")],
                              "brand string, brand_value string, model_name string, model_value string")
    path = str(tmp_path / "catalog")
    catalog.write_catalog(catalog.build_catalog(r), path)
    flat = catalog.flatten_catalog(catalog.read_catalog(spark, path))
    assert rows(flat) == [(0, "A", "1", 0, "z", "v3"), (1, "B", "2", 0, "x", "v1"), (1, "B", "2", 1, "y", "v2")]
