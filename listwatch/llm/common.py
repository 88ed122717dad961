"""What the operators of this package share: tables in the shared folder and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwatch.session import apply_conf, checkpoint_dir

#: Rows of one Arrow batch. Texts can be long, so a batch holds few of them.
BATCH_ROWS = 256
#: Short rows to a file where a table's size is known before it is written.
ROWS_A_FILE = 250_000


class Scratch:
    """Tables of one run in the shared folder named by ``spark.checkpoint.dir``.

    A saved table cuts lineage: it is written once by Spark's commit protocol
    and read by every later step, so a lost executor costs a re-read and not a
    recomputation. ``drop`` deletes a table that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.saved: dict[str, str] = {}
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
        apply_conf(spark)
        # a general setting of all Python steps here: bounded Arrow batches
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """``rows``: how many rows the table will have, if that is known to be few for its partitions; it is then
        written in one file per ROWS_A_FILE of them."""
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
        self.saved[name] = path = self.path(f"{len(self.saved)}-{name}-{uuid.uuid4().hex[:8]}")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table by its name, or a folder by its path's last part."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.saved.pop(name, self.path(name)))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def every(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def private(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def under_share(key: Column, share: Column | float) -> Column:
    """True for about ``share`` of all uniform 64-bit hashes: the smallest ones."""
    limit = F.least(F.lit(1.0), F.lit(share) if isinstance(share, float) else share) * F.lit(2.0 ** 64) - F.lit(2.0 ** 63)
    return key.cast("double") <= limit


def enough_for(limit: int, total: Column | float) -> Column | float:
    """The share of ``total`` hashed rows that holds the ``limit`` smallest but for a chance below one in a million, so
    that only about ``limit`` rows, and not ``limit`` of every task, meet in one task to be ranked."""
    return (limit * 1.1 + 10 * limit ** 0.5 + 50) / total


def smallest(df: DataFrame, key: str, limit: int) -> DataFrame:
    """The ``limit`` rows of smallest hash ``key`` (ties: by the other columns)."""
    total = max(df.count(), 1)
    others = [c for c in df.columns if c != key]
    return df.where(under_share(F.col(key), enough_for(limit, float(total)))).orderBy(key, *others).limit(limit)


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b); root is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., "Connected
    Components in MapReduce and Beyond", 2014) until the edges no longer
    change. Every step is a minimum per node (partial aggregates before the
    shuffle) joined back to the edges, so a hub of any degree is never
    gathered in one place. Null ends and loops are ignored.
    """
    clean = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    cur = scratch.save(clean, "cc-0")
    state, step = _fingerprint(cur), 0
    while state[0]:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
        mid = scratch.save(large.distinct(), f"cc-{step}-large", rows=2 * state[0])
        low = mid.groupBy("a").agg(F.min("b").alias("m"))
        small = mid.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b"))).where("a > b")
        nxt = scratch.save(small.distinct(), f"cc-{step + 1}", rows=2 * state[0])
        now = _fingerprint(nxt)
        scratch.drop(f"cc-{step}")
        scratch.drop(f"cc-{step}-large")
        cur, step = nxt, step + 1
        if now == state:
            break
        state = now
    # at the fixpoint every edge points from a node to its root
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        cur.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
                    F.bit_xor(F.xxhash64("b", "a"))).first()
    return tuple(row)
