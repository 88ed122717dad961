"""Listings partitioned by the day they were last seen (M3, M4, M6, T4).

Rows lie in folders ``rows/seen_day=<day>/v=<version>``; a version of the table
is a small list of the (day, version) folders that make it up, which counts once
its own commit has finished. Expiry leaves days out of that list and writes
again only the day that the limit falls into. A touch moves rows to the day of
their new sighting: the days that held them are written again, all others keep
their files. Readers join the list to the partition columns, which Spark turns
into dynamic partition pruning. A job that dies leaves folders that no list
names; ``vacuum`` deletes these. One writer at a time.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType

from listwatch.operators import snapshot
from listwatch.session import delete_path

DAY, V = "seen_day", "v"
#: The day of rows without a sighting; they never expire (M6).
UNDATED = "9999-12-31"


class DatedListings:
    """One table under ``root``, a folder that the driver and all executors share. ``grain`` is a unit of
    ``date_trunc``: days by default, weeks or months where a day holds too little for a file."""

    def __init__(self, spark: SparkSession, root: str, grain: str = "day"):
        self.spark, self.root, self.grain = spark, root.rstrip("/"), grain

    def _day_of(self, seen: Column) -> Column:
        return F.coalesce(F.date_trunc(self.grain, seen).cast("date"), F.lit(UNDATED).cast("date"))

    def _names(self, path: str) -> list[str]:
        jvm = self.spark._jvm.org.apache.hadoop.fs
        folder = jvm.Path(path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()) if fs.exists(folder) else []

    def _lists(self) -> dict[int, str]:
        jvm = self.spark._jvm.org.apache.hadoop.fs
        names = self._names(f"{self.root}/days")
        fs = jvm.Path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        return {int(re.match(r"(\d+)-", n)[1]): n for n in names if fs.exists(jvm.Path(f"{self.root}/days/{n}/_SUCCESS"))}

    def versions(self) -> list[int]:
        return sorted(self._lists())

    def days(self, version: int | None = None) -> DataFrame:
        """(seen_day, v, n): the folders of a version, the newest by default, and their rows."""
        lists = self._lists()
        name = lists[max(lists) if version is None else version]
        return self.spark.read.schema(f"{DAY} date, {V} string, n long").parquet(f"{self.root}/days/{name}").where("n > 0")

    def _rows(self) -> DataFrame:
        shape = self.spark.read.parquet(f"{self.root}/shape").schema
        return self.spark.read.schema(shape.add(DAY, DateType()).add(V, StringType())).parquet(f"{self.root}/rows")

    def read(self, version: int | None = None) -> DataFrame:
        """A version's rows and their ``seen_day``, by which a filter reads whole partitions only."""
        return self._rows().join(self.days(version).select(DAY, V), [DAY, V]).drop(V)

    def _append(self, rows: DataFrame) -> DataFrame:
        """Write rows into folders of their own; returns these as (seen_day, v, n). A day that holds most of the rows is
        split by AQE, small days share a task."""
        v = f"b{uuid.uuid4().hex[:12]}"
        (rows.withColumn(DAY, self._day_of(F.col("last_seen_at"))).withColumn(V, F.lit(v)).hint("rebalance", DAY)
         .write.mode("append").partitionBy(DAY, V).parquet(f"{self.root}/rows"))
        return self._rows().where(F.col(V) == v).groupBy(DAY, V).agg(F.count("*").alias("n"))

    def _commit(self, days: DataFrame) -> int:
        number = max(self.versions(), default=-1) + 1
        days.select(DAY, V, "n").coalesce(1).write.parquet(f"{self.root}/days/{number}-{uuid.uuid4().hex[:8]}")
        return number

    def write(self, rows: DataFrame) -> int:
        """Store ``rows`` (one per url, with last_seen_at) as the next version; returns its number."""
        if "shape" not in self._names(self.root):
            rows.limit(0).write.parquet(f"{self.root}/shape")
        return self._commit(self._append(rows))

    def expire(self, as_of: Column, days: int = 10) -> int:
        """M6: rows last seen before ``as_of - days`` leave, those of earlier days by whole folders that are not read.
        Without ``as_of`` (an empty table's newest sighting) nothing leaves."""
        limit = (as_of - F.make_dt_interval(F.lit(days))).cast("timestamp")
        cut, first = self.spark.range(1).select(limit.alias("t")).select(F.col("t").cast("string"), self._day_of(F.col("t")).cast("string")).first()
        held, day = self.days(), F.lit(first).cast("date")
        if cut is None:
            return self._commit(held)
        edge = self.read().where(F.col(DAY) == day).drop(DAY)
        stays = F.col("last_seen_at") >= F.lit(cut).cast("timestamp")
        if edge.where(~stays).isEmpty():
            return self._commit(held.where(F.col(DAY) >= day))
        return self._commit(held.where(F.col(DAY) > day).unionByName(self._append(edge.where(stays))))

    def touch(self, touches: DataFrame, order: Column) -> int:
        """M3/M4 (``snapshot.touch``) on the days that hold a touched url; all other days keep their files."""
        urls = touches.select("url").distinct()
        path = f"{self.root}/touched/{uuid.uuid4().hex}"
        self.read().select("url", DAY).join(urls, "url", "left_semi").groupBy(DAY).agg(F.count("*").alias("n")).coalesce(1).write.parquet(path)
        opened = self.spark.read.schema(f"{DAY} date, n long").parquet(path).where("n > 0").select(DAY)
        rows = self._rows().join(self.days().join(opened, DAY).select(DAY, V), [DAY, V]).drop(DAY, V)
        old = rows.join(urls, "url", "left_semi")
        moved = snapshot.touch(old, touches, order).drop("touched", "inserted")
        others = [c for c in rows.columns if c not in moved.columns]
        moved = moved.join(old.select("url", *others), "url", "left") if others else moved
        new = self._append(rows.join(urls, "url", "left_anti").unionByName(moved))
        number = self._commit(self.days().join(opened, DAY, "left_anti").unionByName(new))
        delete_path(self.spark, path)
        return number

    def vacuum(self) -> int:
        """Delete the folders that the newest version does not name; older versions can then no longer be read."""
        live = {(f"{DAY}={r[0]}", f"{V}={r[1]}") for r in self.days().select(F.col(DAY).cast("string"), V).collect()}  # folder names
        gone = [(d, v) for d in self._names(f"{self.root}/rows") for v in self._names(f"{self.root}/rows/{d}") if (d, v) not in live]
        for d, v in gone:
            delete_path(self.spark, f"{self.root}/rows/{d}/{v}")
        lists = self._lists()
        for n in sorted(lists)[:-1]:
            delete_path(self.spark, f"{self.root}/days/{lists[n]}")
        return len(gone)
