"""Subscription state: per-user sets (A6, A7), counts (A1-A3), the event
fold that gives the current subscriptions (M9, M10, M11, J11, Q4) and the
user table fold (M8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def brand_model_sets(subs: DataFrame) -> DataFrame:
    """Per (user, brand) the brand-only marker and the sorted set of
    chosen models ('|'-joined). A brand-only row subsumes the model rows
    (Q5): matching treats the brand as open whenever ``brand_only``."""
    return (subs
            .groupBy("user_id", F.lower(F.trim("brand")).alias("brand"))
            .agg(F.bool_or(F.trim("model") == "").alias("brand_only"),
                 F.array_join(F.array_sort(F.collect_set(F.nullif(F.trim("model"), F.lit("")))), "|")
                 .alias("models")))


def user_selection_sets(subs: DataFrame) -> DataFrame:
    """Per user the set of brands and of non-empty models."""
    return (subs.groupBy("user_id")
            .agg(F.array_join(F.array_sort(F.collect_set(F.trim("brand"))), "|").alias("brands"),
                 F.array_join(F.array_sort(F.collect_set(F.nullif(F.trim("model"), F.lit("")))), "|")
                 .alias("models"),
                 F.count(F.lit(1)).alias("n_subs")))


def count_per_user(users: DataFrame, subs: DataFrame) -> DataFrame:
    """A1/A3: subscriptions per user, 0 for users without any. The count is
    a partial aggregate before the join, so a hot user costs one row."""
    counts = subs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_subs"))
    return (users.select("user_id").distinct()
            .join(counts, "user_id", "left")
            .select("user_id", F.coalesce("n_subs", F.lit(0)).cast("bigint").alias("n_subs")))


def fold_subscription_events(events: DataFrame) -> DataFrame:
    """Current subscriptions from an append-only event log.

    ``events``: user_id, brand, model, op ('add' | 'remove' | 'remove_all' |
    'checked'), ts, seq. Per key (user, brand, model) the state is decided by
    the last add/remove after the user's last remove_all; ``created_at`` is the
    first add of that live period; ``last_checked_at`` is the latest 'checked'
    after the last add (re-subscribing clears it, Q4).
    """
    key = ["user_id", "brand", "model"]
    order = F.struct("ts", "seq")
    wipes = (events.filter(F.col("op") == "remove_all")
             .groupBy("user_id").agg(F.max(order).alias("_wipe")))
    ev = (events.filter(F.col("op") != "remove_all")
          .join(wipes, "user_id", "left")
          .filter(F.col("_wipe").isNull() | (order > F.col("_wipe"))))
    per_key = ev.groupBy(*key).agg(
        F.max_by("op", F.when(F.col("op").isin("add", "remove"), order)).alias("_last_op"),
        F.max(F.when(F.col("op") == "add", order)).alias("_last_add"),
        F.max(F.when(F.col("op") == "remove", order)).alias("_last_rm"),
    )
    live = per_key.filter(F.col("_last_op") == "add")
    # created_at: first add after the last remove of the key
    created = (ev.join(live.select(*key, "_last_rm"), key)
               .filter((F.col("op") == "add") & (F.col("_last_rm").isNull() | (order > F.col("_last_rm"))))
               .groupBy(*key).agg(F.min("ts").alias("created_at")))
    checked = (ev.join(live.select(*key, "_last_add"), key)
               .filter((F.col("op") == "checked") & (order > F.col("_last_add")))
               .groupBy(*key).agg(F.max("ts").alias("last_checked_at")))
    return (live.select(*key).join(created, key, "left").join(checked, key, "left"))


def fold_users(sightings: DataFrame) -> DataFrame:
    """M8: user rows from (user_id, username, ts): first/last seen, and the
    latest non-NULL username."""
    return (sightings.groupBy("user_id")
            .agg(F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"),
                 F.max_by("username", F.when(F.col("username").isNotNull(), F.col("ts"))).alias("username")))


def ordered_user_subscriptions(subs: DataFrame) -> DataFrame:
    """O2: a user's subscriptions ordered by brand, model (adds ``pos``)."""
    w = Window.partitionBy("user_id").orderBy("brand", "model")
    return subs.withColumn("pos", F.row_number().over(w).cast("bigint"))


def stamp_checked(subs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Stamp the subscriptions that a job covered. ``jobs``: user_id,
    brands (the job's brand names), checked_at. Of a covered brand the model
    subscriptions are stamped, or the brand-only one when there are none."""
    done = (jobs.select("user_id", F.explode("brands").alias("_brand"), "checked_at")
            .groupBy("user_id", "_brand").agg(F.max("checked_at").alias("_at")))
    s = subs.withColumn("_brand", F.trim(F.coalesce("brand", F.lit("")))).withColumn(
        "_model", F.trim(F.coalesce("model", F.lit(""))))
    with_models = s.groupBy("user_id", "_brand").agg(F.bool_or(F.col("_model") != "").alias("_any"))
    j = s.join(with_models, ["user_id", "_brand"]).join(done, ["user_id", "_brand"], "left")
    stamped = F.col("_at").isNotNull() & ((F.col("_model") != "") | ~F.col("_any"))
    return j.withColumn("last_checked_at", F.when(stamped, F.col("_at")).otherwise(F.col("last_checked_at"))).drop(
        "_brand", "_model", "_any", "_at")


def delete_rows(subs: DataFrame, requests: DataFrame) -> DataFrame:
    """Delete single rows by (row_id, user_id); a row id of someone
    else's subscription deletes nothing."""
    return subs.join(requests.select("row_id", "user_id").distinct(), ["row_id", "user_id"], "left_anti")


def wipe_totals(subs: DataFrame, items: DataFrame) -> DataFrame:
    """M13/A2 for everybody: how many subscriptions and how many shown items
    a wipe of both tables deletes. One row."""
    both = subs.select(F.lit(1).alias("s"), F.lit(0).alias("i"), "user_id").unionByName(
        items.select(F.lit(0).alias("s"), F.lit(1).alias("i"), "user_id"))
    per_user = both.groupBy("user_id").agg(F.sum("s").alias("s"), F.sum("i").alias("i"))
    return per_user.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("n_subs"), F.coalesce(F.sum("i"), F.lit(0)).alias("n_items"),
                        F.count_if(F.col("s") > 0).alias("n_users"))
