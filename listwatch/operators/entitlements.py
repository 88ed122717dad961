"""Plan entitlements: plan state from events (M14, M21), effective plan with
expiry and free-trial window (M15-M17, J10, P14), trial expiry (P13, X21,
X22) and reset (J12, M13, M19, M20), admin month plans (M18, Q3), plan
prices (J14, X26), payment sources (S6, S7) and additive schema change
(M22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwatch.operators.windows import carry_last

# fixed values: plan limits, unknown plan -> 2
PLAN_LIMITS = {"free": 2, "free_expired": 0, "starter": 10, "pro": 20, "dealer": 50, "admin": 999}
UNKNOWN_PLAN_LIMIT = 2
# fixed values: plan prices in minor units (USD), paid period in days
PLAN_PRICES_MINOR = {"starter": 999, "pro": 1799, "dealer": 3999}
PAID_PERIOD_DAYS = 30
TRIAL_DAYS = 10
LIFETIME_MONTHS = 9999
# fixed values: the completed-checkout event type and the metadata key
# that carries the chat user id
COMPLETED_EVENT = "checkout.session.completed"
METADATA_USER_KEY = "telegram_id"

# the event as it arrives: id at the top, metadata on the checkout object
PAYMENT_EVENT_SCHEMA = (f"id string, type string, created long, "
                        f"data struct<object: struct<metadata: struct<plan: string, {METADATA_USER_KEY}: string>>>")


def plan_limits(spark: SparkSession) -> DataFrame:
    """J10 dimension (6 rows, fixed): safe to broadcast."""
    return spark.createDataFrame(list(PLAN_LIMITS.items()), "plan string, max_subs int")


def plan_prices(spark: SparkSession) -> DataFrame:
    """J14 dimension (3 rows, fixed)."""
    return spark.createDataFrame(list(PLAN_PRICES_MINOR.items()), "plan string, price_minor int")


def with_limit(df: DataFrame, limits: DataFrame, plan_col: str = "plan") -> DataFrame:
    """Limit of the plan; unknown plan -> 2."""
    lim = limits.withColumnRenamed("plan", "_lp")
    return (df.join(F.broadcast(lim), F.col(plan_col) == F.col("_lp"), "left")
            .withColumn("max_subs", F.coalesce(F.col("max_subs"), F.lit(UNKNOWN_PLAN_LIMIT)))
            .drop("_lp"))


def fold_plan_events(events: DataFrame) -> DataFrame:
    """Plan rows from (user_id, plan_name, expires_at, ts, seq): the
    last event sets plan and expiry; created_at is the first event,
    updated_at the last. ``free_started_at`` is the first event's time when
    that event started a free plan (the row was created as a trial, M15)."""
    order = F.struct("ts", "seq")
    return (events.groupBy("user_id")
            .agg(F.max_by(F.struct("plan_name", "expires_at"), order).alias("_last"),
                 F.min_by(F.struct("plan_name", "ts"), order).alias("_first"),
                 F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))
            .select("user_id",
                    F.lower(F.col("_last.plan_name")).alias("plan_name"),
                    F.col("_last.expires_at").alias("expires_at"),
                    "created_at", "updated_at",
                    F.when(F.lower(F.col("_first.plan_name")) == "free", F.col("_first.ts")).alias("free_started_at")))


def effective_plan(users: DataFrame, plans: DataFrame, as_of: Column, limits: DataFrame,
                   trial_days: int = TRIAL_DAYS) -> DataFrame:
    """M15-M17 for every user at ``as_of`` in one projection:
    a paid plan past its expiry becomes 'free' (M16) with the trial clock
    started at the expiry when it was never set (Q14); a user without a row
    is a fresh 'free' user (M15); a 'free' user whose trial is at least
    ``trial_days`` old is 'free_expired' (M17); the limit comes from J10."""
    j = users.select("user_id").distinct().join(plans, "user_id", "left")
    return with_limit(j.select("user_id", *_effective(as_of, trial_days)), limits)


def _effective(as_of: Column, trial_days: int) -> list[Column]:
    lapsed = F.col("expires_at").isNotNull() & (F.col("expires_at") < as_of)
    plan0 = F.when(lapsed, F.lit("free")).otherwise(F.lower(F.coalesce(F.col("plan_name"), F.lit("free"))))
    start = (F.when(F.col("plan_name").isNull(), as_of)
             .when(lapsed, F.coalesce(F.col("free_started_at"), F.col("expires_at")))
             .otherwise(F.col("free_started_at")))
    expired = (plan0 == "free") & start.isNotNull() & (trial_age_days(as_of, start) >= F.lit(float(trial_days)))
    return [F.when(expired, F.lit("free_expired")).otherwise(plan0).alias("plan"),
            F.when(lapsed, F.lit(None).cast("timestamp")).otherwise(F.col("expires_at")).alias("expires_at"),
            start.alias("free_started_at"),
            (F.lower(F.coalesce(F.col("plan_name"), F.lit("free"))) == "free").alias("is_free")]  # P14, stored row


def plan_intervals(events: DataFrame, bucket_s: int = 30 * 86400) -> DataFrame:
    """The plan history: (user_id, plan_name, expires_at, valid_from,
    valid_to, free_started_at) from plan events as in ``fold_plan_events``. An
    interval ends where the user's next event begins (NULL: it still holds);
    of events at one time only the last one holds. Neighbours are found in
    (user, time bucket) windows."""
    last = events.groupBy("user_id", "ts").agg(F.max_by(F.struct("plan_name", "expires_at"), "seq").alias("_p"))
    nxt = carry_last(last, ["user_id"], ["ts"], F.col("ts"), F.floor(F.unix_seconds("ts") / bucket_s), "valid_to", reverse=True)
    first = events.groupBy("user_id").agg(F.min_by(F.struct("plan_name", "ts"), F.struct("ts", "seq")).alias("_first"))
    return nxt.join(first, "user_id").select(
        "user_id", F.lower("_p.plan_name").alias("plan_name"), "_p.expires_at", F.col("ts").alias("valid_from"), "valid_to",
        F.when(F.lower(F.col("_first.plan_name")) == "free", F.col("_first.ts")).alias("free_started_at"))


def plan_at(jobs: DataFrame, intervals: DataFrame, limits: DataFrame, trial_days: int = TRIAL_DAYS, bucket_s: int = 30 * 86400) -> DataFrame:
    """M15-M17/J10 at each job's own time: ``jobs`` (user_id, at, ...) with the
    plan that held then, its limit and the trial state. An as-of join: jobs
    and interval starts are merged per user in time order (a start counts for
    a job at the same time) and the plan is carried forward over (user, time
    bucket) windows, so neither a user's jobs nor their history meet in one
    task as a product. A job before the user's first event finds no plan."""
    held = F.struct("plan_name", "expires_at", "free_started_at")
    j = jobs.select("*", F.lit(1).alias("_kind"), F.lit(None).cast(intervals.select(held.alias("h")).schema["h"].dataType).alias("_held"))
    starts = intervals.select("user_id", F.col("valid_from").alias("at"), F.lit(0).alias("_kind"), held.alias("_held"))
    both = carry_last(j.unionByName(starts, allowMissingColumns=True), ["user_id"], ["at", "_kind"], F.col("_held"),
                      F.floor(F.unix_seconds("at") / bucket_s), "_now", include_current=True).filter("_kind = 1")
    mine = both.select(*jobs.columns, "_now.*")
    return with_limit(mine.select(*jobs.columns, *_effective(F.col("at"), trial_days)), limits)


def trial_age_days(a: Column, b: Column) -> Column:
    """Absolute fractional days between two timestamps."""
    return F.abs(F.unix_micros(a) - F.unix_micros(b)) / F.lit(86400e6)


def trial_expired(plans: DataFrame, as_of: Column, days: int = TRIAL_DAYS) -> DataFrame:
    """Stored plan (NULL -> free) is 'free', trial started, and at
    least ``days`` old; with X21 age and the X22 trial end / days left."""
    p = plans.filter((F.lower(F.coalesce(F.col("plan_name"), F.lit("free"))) == "free")
                     & F.col("free_started_at").isNotNull()
                     & (F.col("free_started_at") <= as_of - F.make_dt_interval(F.lit(days))))
    end = F.col("free_started_at") + F.make_dt_interval(F.lit(days))
    return p.select("user_id", "free_started_at",
                    F.round(trial_age_days(as_of, F.col("free_started_at")), 6).alias("age_days"),
                    end.alias("trial_end"),
                    F.datediff(F.to_date(end), F.to_date(as_of)).cast("bigint").alias("days_left"))


def trial_reset(expired: DataFrame, subs: DataFrame, items: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete the subscriptions and the shown items of
    expired users and restart their trial clock. Returns (kept
    subscriptions, kept items, per-user summary with the deleted counts (A3),
    the new trial start and the notify flag)."""
    users = expired.select("user_id").distinct()

    def gone(df, name):
        return df.join(users, "user_id", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias(name))

    summary = (users.join(gone(subs, "n_subs"), "user_id", "left").join(gone(items, "n_items"), "user_id", "left")
               .select("user_id", F.coalesce("n_subs", F.lit(0)).cast("bigint").alias("n_deleted"),
                       F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items_deleted"),
                       as_of.alias("free_started_at"), as_of.alias("last_free_reset_at"))
               .withColumn("notify", F.col("n_deleted") > 0))
    return subs.join(users, "user_id", "left_anti"), items.join(users, "user_id", "left_anti"), summary


def months_expiry(ts: Column, months: Column, overflow: bool = False) -> Column:
    """Expiry after ``months``; NULL or >= 9999 months = lifetime.
    Calendar-correct month end clamping by default (Jan 31 + 1 = Feb 28);
    ``overflow`` rolls the surplus days into the next month like SQLite's
    'now, +N months' (Jan 31 + 1 = Mar 3)."""
    lifetime = months.isNull() | (months >= LIFETIME_MONTHS)
    m = F.make_ym_interval(F.lit(0), months.cast("int"))
    if overflow:
        start = F.date_trunc("month", ts)
        value = start + m + F.make_dt_interval(F.dayofmonth(ts) - F.lit(1))
        value = value + (ts - F.date_trunc("day", ts))
    else:
        value = ts + m
    return F.when(lifetime, F.lit(None).cast("timestamp")).otherwise(value)


def price_text(minor: Column) -> Column:
    """Minor units as a price with two decimals."""
    return F.format_number(minor / F.lit(100), 2)


def parse_payment_json(raw: DataFrame, col: str = "value") -> DataFrame:
    """Completed checkout events from JSON text; user id is the
    metadata user id (bad ids -> dropped), time is the event time."""
    ev = raw.select(F.from_json(F.col(col), PAYMENT_EVENT_SCHEMA).alias("e")).select("e.*")
    meta = "data.object.metadata"
    return (ev.filter(F.col("type") == COMPLETED_EVENT)
            .select(F.col("id").alias("event_id"),
                    F.col(f"{meta}.{METADATA_USER_KEY}").try_cast("bigint").alias("user_id"),
                    F.lower(F.col(f"{meta}.plan")).alias("plan_name"),
                    F.timestamp_seconds(F.col("created")).alias("ts"))
            .filter(F.col("user_id").isNotNull()))


def parse_payment_payload(raw: DataFrame, payload: str, ts: str, event_id: str) -> DataFrame:
    """S7: 'plan:<plan>:<user id>' payloads of native payments."""
    parts = F.split(F.col(payload), ":")
    return (raw.filter(F.size(parts) == 3)
            .filter(F.element_at(parts, 1) == "plan")
            .select(F.col(event_id).cast("string").alias("event_id"),
                    F.element_at(parts, 3).try_cast("bigint").alias("user_id"),
                    F.lower(F.element_at(parts, 2)).alias("plan_name"),
                    F.col(ts).alias("ts"))
            .filter(F.col("user_id").isNotNull()))


def activate_paid(payments: DataFrame) -> DataFrame:
    """A payment activates the plan for 30 days from the *event* time,
    so replaying an event gives the same row. Repeated events need no
    removal: the fold of plan events (M14) gives the same state for any
    number of copies, and payments without an id are all kept."""
    return (payments
            .withColumn("expires_at", F.col("ts") + F.make_dt_interval(F.lit(PAID_PERIOD_DAYS)))
            .withColumn("seq", F.col("event_id")))
