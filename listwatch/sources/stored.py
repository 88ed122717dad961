"""The stored snapshot of listings.

Listings live in a Parquet table that is hash-bucketed by url and sorted by it
within a bucket. An upsert reduces a batch to one row per url, shuffles only
that, and joins it to the stored side bucket by bucket; the result is a new
version of the table. Readers join on url without moving the stored rows.

A version is a folder that counts once Spark's commit has finished; readers
take the newest such version, so a job that dies leaves the one before it.
Nothing but folder names passes through the driver.
"""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwatch.operators import snapshot

KEY = "url"
#: Stored bytes that one bucket is meant to hold, and the most buckets that Spark is asked for. A join leaves the
#: stored side in place where it has as many buckets as the session has shuffle partitions, or more.
BUCKET_BYTES = 256 << 20
MOST_BUCKETS = 50_000
LEAST_BUCKETS = 8


def buckets_for(n_bytes: int) -> int:
    return min(max(LEAST_BUCKETS, -(-n_bytes // BUCKET_BYTES)), MOST_BUCKETS)


class StoredListings:
    """Versions of one listings table under ``root``, a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = LEAST_BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _folders(self) -> dict[int, str]:
        """Finished versions: number -> folder name (``v=<number>-b=<buckets>-<unique>``)."""
        jvm = self.spark._jvm.org.apache.hadoop.fs
        root = jvm.Path(self.root)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        done = [n for n in names if fs.exists(jvm.Path(f"{self.root}/{n}/_SUCCESS"))]
        return {int(re.match(r"v=(\d+)-", n)[1]): n for n in sorted(done)}

    def versions(self) -> list[int]:
        return sorted(self._folders())

    def read(self, version: int | None = None) -> DataFrame:
        """A version, the newest by default. The table is declared to the session's catalog when it is first read, so
        another session finds the buckets too."""
        folders = self._folders()
        folder = folders[max(folders) if version is None else version]
        path = f"{self.root}/{folder}"
        name = f"listings_{hashlib.md5(path.encode()).hexdigest()[:16]}"
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(path).schema)
            buckets = re.search(r"-b=(\d+)-", folder)[1]
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}) "
                           f"INTO {buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def write(self, rows: DataFrame) -> int:
        """Store ``rows`` (one per url) as the next version; returns its number."""
        number = max(self.versions(), default=-1) + 1
        folder = f"v={number}-b={self.buckets}-{uuid.uuid4().hex[:8]}"
        # one task a bucket, so that a bucket is one sorted file
        (rows.repartition(self.buckets, KEY).write.format("parquet").bucketBy(self.buckets, KEY).sortBy(KEY)
         .option("path", f"{self.root}/{folder}").saveAsTable(f"listings_{uuid.uuid4().hex}"))
        return number

    def upsert(self, batch: DataFrame, order: Column, value_cols: list[str] = snapshot.VALUE_COLS) -> int:
        """M1: the newest version with a batch of rows merged in, stored as the next version."""
        return self.write(snapshot.merge(self.read(), batch, order, value_cols))
