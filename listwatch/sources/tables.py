"""Readers for the input tables and the logical tables derived from them.

Every reader selects only the columns it needs, so the Parquet scan is
pruned; filters applied later by callers are pushed into the scan by
Catalyst. Nothing here collects or counts. Current listings are read from a
stored snapshot, which is written once (``stored_listings``).

The driver tables are a TPC-H-like star schema. The logical model of the
listing watcher (FIXTURES.md) is mapped onto them as follows:

* ``listings``     <- part (one listing per part) + its sightings
* ``sightings``    <- lineitem (one sighting of a listing per line)
* ``subscriptions``<- customer (two subscriptions per customer)
* ``job_runs``     <- events (one run request per event)
* ``plan events``  <- orders (one plan purchase per order)
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwatch.operators import snapshot
from listwatch.session import checkpoint_dir
from listwatch.sources.stored import StoredListings, buckets_for


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------------------
# Fixed values of the test mapping (FIXTURES.md §2). They are parameters of
# the mapping, not of the operators.
# ---------------------------------------------------------------------------
# subscription model by c_custkey % 4
SUB_MODEL_BY_KEY = ["", "promo", "ring", "small"]
# second subscription model by market segment
SUB_MODEL_BY_SEGMENT = {
    "AUTOMOBILE": "",
    "BUILDING": "gear",
    "FURNITURE": "large",
    "HOUSEHOLD": "hot",
    "MACHINERY": "ring",
}
# seller type of a sighting by return flag; N -> NULL
SELLER_BY_FLAG = {"A": "agency", "R": "private"}
# plan bought by an order, by order priority
PLAN_BY_PRIORITY = {
    "1-URGENT": "dealer",
    "2-HIGH": "pro",
    "3-MEDIUM": "starter",
    "4-NOT SPECIFIED": "starter",
    "5-LOW": "free",
}


def case_map(col: Column, mapping: dict, default=None) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == F.lit(k), F.lit(v)) if expr is None else expr.when(col == F.lit(k), F.lit(v))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only observation log: url, seen_at, price_raw, price, seller_type
    plus the columns that make a total order of sightings (SURVEY §7.5.3)."""
    li = table(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return li.select(
        F.col("l_partkey").cast("string").alias("url"),
        F.col("l_shipdate").cast("timestamp").alias("seen_at"),
        F.concat(F.lit("₪ "), cents.cast("string")).alias("price_raw"),
        cents.alias("price"),
        case_map(F.col("l_returnflag"), SELLER_BY_FLAG).alias("seller_type"),
        F.col("l_orderkey").alias("o_key"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_extendedprice").alias("x_price"),
        F.col("l_suppkey").alias("s_key"),
    )


SIGHTING_ORDER = ["seen_at", "o_key", "line_no", "x_price", "s_key"]


def sighting_seq(df: DataFrame) -> Column:
    """A struct that totally orders sightings; usable with max_by/min_by."""
    return F.struct(*[F.col(c) for c in SIGHTING_ORDER])


def parts_as_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog attributes of listings (no sighting data)."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("url"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("model"),
        F.col("p_name").alias("title"),
        F.col("p_retailprice").alias("list_price"),
    )


#: The stored snapshot is loaded from the sightings before this day; those from it on are a crawl batch.
CRAWL_SPLIT = "1996-01-01"
LOADED, UPSERTED = 0, 1
_STORED: dict[tuple, StoredListings] = {}


def _state_of(spark: SparkSession, path: str) -> tuple:
    """What tells one state of a table's files from another: their number, bytes and last change."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    total = fs.getContentSummary(p)
    return path, total.getFileCount(), total.getLength(), fs.getFileStatus(p).getModificationTime()


def stored_listings(spark: SparkSession, sf_dir: str, version: int = UPSERTED) -> StoredListings:
    """The snapshot job, and the only reader of the whole log: version LOADED folds the sightings before CRAWL_SPLIT,
    version UPSERTED merges the crawl batch from then on. Either runs once per application and state of the input, and
    not before it is asked for."""
    state = tuple(_state_of(spark, f"{sf_dir.rstrip('/')}/{t}.parquet") for t in ("lineitem", "part"))
    key = (spark.sparkContext.applicationId, *state)
    if key not in _STORED:
        name = hashlib.md5(repr(key).encode()).hexdigest()
        _STORED[key] = StoredListings(spark, f"{checkpoint_dir(spark).rstrip('/')}/listwatch-listings-{name}", buckets_for(2 * state[1][2]))
    store = _STORED[key]
    held = store.versions()
    if version not in held:
        s = sightings(spark, sf_dir)
        seq = sighting_seq(s)
        early = F.col("seen_at") < F.lit(CRAWL_SPLIT).cast("timestamp")
        if LOADED not in held:
            folded = snapshot.fold_sightings(s.filter(early), seq)
            parts = parts_as_listings(spark, sf_dir).withColumn("in_catalog", F.lit(True))
            store.write(parts.join(folded, "url", "full"))
        if version == UPSERTED:
            # folded to one row per url first: a sighting's order is led by its time, so first and last are plain min and max
            store.upsert(snapshot.fold_sightings(s.filter(~early), seq), F.col("last_seen_at"))
    return store


def stored_sightings(spark: SparkSession, sf_dir: str, version: int = UPSERTED) -> DataFrame:
    """Stored rows of the urls that have been seen by that version."""
    return stored_listings(spark, sf_dir, version).read(version).filter(F.col("first_seen_at").isNotNull())


def crawl_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sightings(spark, sf_dir)
    return s.filter(F.col("seen_at") >= F.lit(CRAWL_SPLIT).cast("timestamp"))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current-state listings, as stored: catalog attributes plus first/last seen and the latest price and seller type."""
    stored = stored_listings(spark, sf_dir).read(UPSERTED)
    return stored.filter(F.col("in_catalog")).select("url", "brand", "model", "title", "list_price", "first_seen_at",
                                                     "last_seen_at", "price_raw", "price", "seller_type")


def newest_sighting(spark: SparkSession, sf_dir: str) -> Column:
    """The crawl clock: the newest sighting, as a scalar subquery over the stored rows."""
    return stored_listings(spark, sf_dir).read(UPSERTED).select(F.max("last_seen_at")).scalar()


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two subscriptions per customer (user_id, brand, model); model '' means
    every model of the brand. Brands are written in mixed case on purpose:
    matching is case-insensitive."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    key_model = F.element_at(F.array(*[F.lit(m) for m in SUB_MODEL_BY_KEY]),
                             (F.col("c_custkey") % 4 + 1).cast("int"))
    first = c.select(
        F.col("c_custkey").alias("user_id"),
        F.concat(F.lit("brand#"), (F.col("c_custkey") % 25 + 1).cast("string")).alias("brand"),
        key_model.alias("model"),
    )
    second = c.select(
        F.col("c_custkey").alias("user_id"),
        F.concat(F.lit("BRAND#"), (F.col("c_nationkey") % 25 + 1).cast("string")).alias("brand"),
        case_map(F.col("c_mktsegment"), SUB_MODEL_BY_SEGMENT, "").alias("model"),
    )
    return first.unionByName(second)


def user_seller_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-user seller filter as a long table (user_id, seller_type). A user
    with no row, or with both types, gets everything (P5)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    wanted = (
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.array(F.lit("private")))
        .when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("agency")))
        .when(F.col("c_mktsegment") == "FURNITURE", F.array(F.lit("agency"), F.lit("private")))
        .otherwise(F.array().cast("array<string>"))
    )
    return c.select(F.col("c_custkey").alias("user_id"),
                    F.explode(wanted).alias("seller_type"))


RUN_KEY = ["user_id", "brand_key", "model_key"]


def job_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run requests: one per event; brand_key = event_type, model_key from
    the event's JSON props."""
    return runs_of_events(table(spark, sf_dir, "events"))


def runs_of_events(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", "user_id",
        F.col("event_type").alias("brand_key"),
        F.concat(F.lit("m"), (F.get_json_object("props", "$.k").cast("bigint") % 4).cast("string")).alias("model_key"),
        F.col("ts").cast("timestamp").alias("started_at"),
    )
