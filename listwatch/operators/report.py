"""Report and export sinks (K1-K4) and the small report aggregates
(A4, A8, A9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest_first(listings: DataFrame) -> DataFrame:
    """O1/K1 order: last seen newest first, NULLs last, url as tie-break.
    A global sort is range-partitioned, never one task."""
    return listings.orderBy(F.col("last_seen_at").desc_nulls_last(), F.col("url"))


def export_csv(listings: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """K1: full listings CSV, newest first, with a header; an empty table
    gives an empty file without header, as the source does. The emptiness
    check reads at most one row."""
    df = newest_first(listings)
    if columns:
        df = df.select(*columns)
    header = not df.isEmpty()
    df.write.mode("overwrite").option("header", header).csv(path)


REPORT_BUCKETS = 256


def report_bucket(user: str = "user_id", buckets: int = REPORT_BUCKETS):
    return F.pmod(F.xxhash64(user), F.lit(buckets)).cast("int")


def write_user_reports(rows: DataFrame, path: str, fmt: str = "parquet", buckets: int = REPORT_BUCKETS) -> None:
    """K3: the users' reports in hash buckets, sorted by user inside each
    file, so there are as many folders as buckets and not as users. Spark
    rebalances the rows by bucket and splits a bucket that a large report
    fills."""
    (rows.withColumn("bucket", report_bucket(buckets=buckets)).hint("rebalance", "bucket")
     .sortWithinPartitions("bucket", "user_id").write.mode("overwrite").partitionBy("bucket").format(fmt).save(path))


def read_user_report(spark, path: str, user_id, fmt: str = "parquet", buckets: int = REPORT_BUCKETS) -> DataFrame:
    """One user's report: only its bucket is read."""
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(user_id).cast("bigint")), F.lit(buckets)).cast("int")).first()[0]
    return spark.read.format(fmt).load(path).filter((F.col("bucket") == bucket) & (F.col("user_id") == user_id)).drop("bucket")
