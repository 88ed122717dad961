"""Current-state listings as a fold of change sets (M1-M7, J3, J6, U1, U2,
M5, A5, A13, P10, P11, U4).

Plain Parquet has no MERGE, so every state change is
``new snapshot = f(old snapshot, change set)`` written to a new directory.
Each fold is one aggregate keyed by url over ``old UNION ALL changes``:
partial aggregation runs before the shuffle, so duplicated or hot urls cost
one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

VALUE_COLS = ["price_raw", "price", "seller_type", "last_seen_at"]


def _good(c: Column) -> Column:
    """Q11: '' and 'Unknown' carry no information, like NULL."""
    return F.when(~F.trim(c).isin("", "Unknown"), c)


def upsert(old: DataFrame, batch: DataFrame, order: Column, value_cols: list[str] = VALUE_COLS) -> DataFrame:
    """M1/M2/U2. ``old``: url, first_seen_at, *value_cols. ``batch``: url,
    first_seen_at, *value_cols, ordered by ``order`` (a struct).

    Result per url: values of the last batch row (old values when the url
    is not in the batch); ``first_seen_at`` of the stored row, filled from
    the first batch row when missing or NULL (Q17)."""
    missing = [c for c in value_cols + ["first_seen_at"] if c not in batch.columns]
    for c in missing:  # P11: absent text is empty text, other absent values are NULL
        kind = old.schema[c].dataType
        batch = batch.withColumn(c, F.lit("" if kind == StringType() else None).cast(kind))
    for c in value_cols:  # P11: attribute maps are stored as JSON text
        if isinstance(batch.schema[c].dataType, MapType):
            batch = batch.withColumn(c, F.to_json(c))
    o = old.select("url", "first_seen_at", *value_cols,
                   F.struct(F.lit(0).alias("src"), F.lit(None).cast(batch.select(order).schema[0].dataType)
                            .alias("seq")).alias("_ord"))
    b = batch.select("url", "first_seen_at", *value_cols,
                     F.struct(F.lit(1).alias("src"), order.alias("seq")).alias("_ord"))
    u = o.unionByName(b)
    return u.groupBy("url").agg(
        F.min_by("first_seen_at", F.when(F.col("first_seen_at").isNotNull(), F.col("_ord"))).alias("first_seen_at"),
        F.max_by(F.struct(*value_cols), "_ord").alias("_v"),
    ).select("url", "first_seen_at", *[F.col(f"_v.{c}").alias(c) for c in value_cols])


def merge(old: DataFrame, batch: DataFrame, order: Column, value_cols: list[str] = VALUE_COLS) -> DataFrame:
    """M1/M2/U2 against a stored table: the rules of ``upsert``, as one join.
    Only the batch is reduced and shuffled; ``old`` keeps its partitioning by
    url and its other columns (NULL for urls that it did not hold)."""
    last = batch.groupBy("url").agg(
        F.min_by("first_seen_at", F.when(F.col("first_seen_at").isNotNull(), order)).alias("_first"),
        F.max_by(F.struct(*value_cols), order).alias("_v"))
    j = old.join(last, "url", "full")

    def merged(c: str) -> Column:
        if c == "first_seen_at":
            return F.coalesce(c, "_first").alias(c)
        return F.when(F.col("_v").isNotNull(), F.col(f"_v.{c}")).otherwise(F.col(c)).alias(c) if c in value_cols else F.col(c)
    return j.select(*[merged(c) for c in old.columns])


def touch(old: DataFrame, touches: DataFrame, order: Column) -> DataFrame:
    """M3/M4: ``touches`` (url, brand, model, price_raw, seen_at) set
    last_seen_at, overwrite brand/model only with informative values (Q11)
    and price only with a non-empty one (Q12); missing urls get a stub."""
    t = touches.select(
        "url", F.col("seen_at").alias("last_seen_at"),
        _good(F.col("brand")).alias("brand"), _good(F.col("model")).alias("model"),
        F.when(F.trim(F.col("price_raw")) != "", F.col("price_raw")).alias("price_raw"),
        order.alias("_ord"))
    agg = t.groupBy("url").agg(
        F.max_by("last_seen_at", "_ord").alias("t_last_seen_at"),
        F.max_by("brand", F.when(F.col("brand").isNotNull(), F.col("_ord"))).alias("t_brand"),
        F.max_by("model", F.when(F.col("model").isNotNull(), F.col("_ord"))).alias("t_model"),
        F.max_by("price_raw", F.when(F.col("price_raw").isNotNull(), F.col("_ord"))).alias("t_price_raw"),
    )
    j = old.join(agg, "url", "full")
    return j.select(
        "url",
        F.coalesce("t_brand", _good(F.col("brand")), F.col("brand")).alias("brand"),
        F.coalesce("t_model", _good(F.col("model")), F.col("model")).alias("model"),
        F.coalesce("t_price_raw", "price_raw").alias("price_raw"),
        F.coalesce("t_last_seen_at", "last_seen_at").alias("last_seen_at"),
        F.coalesce("first_seen_at", "t_last_seen_at").alias("first_seen_at"),
        F.col("t_last_seen_at").isNotNull().alias("touched"),
        F.col("first_seen_at").isNull().alias("inserted"),
    )


def expire_by_age(snapshot: DataFrame, as_of: Column, days: int = 10) -> tuple[DataFrame, DataFrame]:
    """M6/T4: (kept, removed). A row is removed when last_seen_at is
    strictly older than as_of - days; NULL last_seen_at is kept. The
    comparison is on the raw column, so it pushes down to the scan."""
    cutoff = as_of - F.make_dt_interval(F.lit(days))
    removed_pred = F.col("last_seen_at") < cutoff
    kept = snapshot.filter(~removed_pred | F.col("last_seen_at").isNull())
    removed = snapshot.filter(removed_pred)
    return kept, removed


def with_expired(snapshot: DataFrame, as_of: Column, days: int = 10) -> DataFrame:
    """M6 as a flag: ``expired`` per row, for one pass over the snapshot."""
    old = F.col("last_seen_at") < as_of - F.make_dt_interval(F.lit(days))
    return snapshot.withColumn("expired", F.coalesce(old, F.lit(False)))


def cohort_cleanup(snapshot: DataFrame, seen: DataFrame) -> DataFrame:
    """Stored urls of every crawled (brand, model) cohort that were
    not seen in this crawl. ``seen``: url, brand, model of the crawl. Cohorts
    with brand 'Unknown' or '' are skipped. Returns the rows to delete."""
    cohorts = (seen.filter(~F.coalesce(F.trim("brand"), F.lit("")).isin("", "Unknown"))
               .select("brand", "model").distinct())
    seen_urls = seen.select("url").distinct()
    return (snapshot.join(cohorts, ["brand", "model"], "left_semi")
            .join(seen_urls, "url", "left_anti"))


def seen_by_pair(seen: DataFrame) -> DataFrame:
    """A5 kept relational: distinct (brand, model, url)."""
    return seen.select("brand", "model", "url").distinct()


def split_known(items: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Flag each feed item ``visit`` = url not stored yet. A left join
    against the stored keys, which a snapshot holds once each, keeps one
    output row per item."""
    keys = snapshot.select("url", F.lit(True).alias("_known"))
    return (items.join(keys, "url", "left")
            .withColumn("visit", F.col("_known").isNull())
            .drop("_known"))


def delete_keys(snapshot: DataFrame, keys: DataFrame) -> DataFrame:
    """Remove the distinct non-empty keys from the snapshot."""
    k = keys.select("url").filter(F.col("url").isNotNull() & (F.col("url") != "")).distinct()
    return snapshot.join(k, "url", "left_anti")


def first_wins(items: DataFrame, part_cols: list[str], pos: str = "pos") -> DataFrame:
    """First occurrence of each key in page order (``pos``)."""
    return (items.groupBy(*part_cols)
            .agg(F.min_by(F.struct(*[c for c in items.columns if c not in part_cols]), F.col(pos)).alias("_r"))
            .select(*part_cols, "_r.*"))


def last_wins(items: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """Last value per key, keeping the position of its *first*
    occurrence (a dict keeps insertion order when a key is overwritten)."""
    others = [c for c in items.columns if c not in (key, pos)]
    return (items.groupBy(key)
            .agg(F.max_by(F.struct(*others), F.col(pos)).alias("_r"), F.min(pos).alias(pos))
            .select(key, pos, "_r.*"))


def fold_sightings(s: DataFrame, order: Column, value_cols: list[str] = ("price_raw", "price", "seller_type")) -> DataFrame:
    """Snapshot rows from a sightings log: first/last seen and the values of
    the last sighting (by ``order``) per url. First/last seen are plain
    min/max (hash aggregation); the value struct is a separate ``max_by``, so
    a caller that needs only the dates lets Catalyst prune it."""
    return (s.groupBy("url")
            .agg(F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"),
                 F.max_by(F.struct(*value_cols), order).alias("_v"))
            .select("url", "first_seen_at", "last_seen_at", *[F.col(f"_v.{c}").alias(c) for c in value_cols]))
