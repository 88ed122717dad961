"""Tables whose files were written under several schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

#: Types that a later version may widen to, in order; Spark's Parquet reader widens values as it reads them.
WIDENING = (("tinyint", "smallint", "int", "bigint"), ("float", "double"))


def _wider(a, b):
    if a == b:
        return a
    for chain in WIDENING:
        if a.simpleString() in chain and b.simpleString() in chain:
            return max(a, b, key=lambda t: chain.index(t.simpleString()))
    raise ValueError(f"{a.simpleString()} and {b.simpleString()} cannot be merged")


def merged_schema(schemas: list[StructType]) -> StructType:
    """All columns of all versions in order of appearance, each with its widest type; all may be NULL."""
    out: dict[str, StructField] = {}
    for schema in schemas:
        for f in schema:
            kind = _wider(out[f.name].dataType, f.dataType) if f.name in out else f.dataType
            out[f.name] = StructField(f.name, kind, True)
    return StructType(list(out.values()))


def read_versions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The Parquet files of all ``paths`` as one table: a column that a version lacks is NULL in its rows, and a column
    that a later version has widened is read at its widest. One scan; only footers are read beforehand."""
    return spark.read.schema(merged_schema([spark.read.parquet(p).schema for p in paths])).parquet(*paths)
