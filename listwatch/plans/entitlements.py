"""Queries of build step 5: users, subscription state, counts and plan
entitlements.

Plan events come from ``orders`` (user = o_custkey, time = o_orderdate,
plan by order priority, status F = webhook payment, P = native payment).
Subscription events come from ``events`` (op by event type).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwatch.operators import entitlements as E
from listwatch.operators import runs, subs
from listwatch.plans.oracle_views import with_views
from listwatch.plans.registry import register
from listwatch.session import checkpoint_dir
from listwatch.sources import tables as T
from listwatch.sources.versions import read_versions

# the clock of these queries: the newest order
AS_OF_SQL = "(SELECT max(CAST(o_orderdate AS TIMESTAMP)) FROM orders)"
SCHEMA_SPLIT = "1998-01-01"


def with_views_subs(body: str) -> str:
    return with_views(["subscriptions"], body)


def _as_of(spark, sf_dir):
    return T.table(spark, sf_dir, "orders").select(F.max(F.col("o_orderdate").cast("timestamp"))).scalar()


# --------------------------------------------------------------------------
# shared derivations (Spark) and their SQL twins
# --------------------------------------------------------------------------

def plan_events(spark, sf_dir) -> DataFrame:
    o = T.table(spark, sf_dir, "orders")
    plan = T.case_map(F.col("o_orderpriority"), T.PLAN_BY_PRIORITY)
    ts = F.col("o_orderdate").cast("timestamp")
    return (o.select(F.col("o_custkey").alias("user_id"), plan.alias("plan_name"), ts.alias("ts"),
                    F.col("o_orderkey").alias("seq"))
            .withColumn("expires_at", F.when(F.col("plan_name") != "free",
                                             F.col("ts") + F.make_dt_interval(F.lit(E.PAID_PERIOD_DAYS)))))


_PLAN_CASE = """CASE o_orderpriority WHEN '1-URGENT' THEN 'dealer' WHEN '2-HIGH' THEN 'pro'
                WHEN '3-MEDIUM' THEN 'starter' WHEN '4-NOT SPECIFIED' THEN 'starter' WHEN '5-LOW' THEN 'free' END"""
_LIMITS_SQL = "(VALUES " + ", ".join(f"('{p}', {n})" for p, n in E.PLAN_LIMITS.items()) + ") AS lim(plan, max_subs)"

_PRICES_SQL = "(VALUES " + ", ".join(f"('{p}', {n})" for p, n in E.PLAN_PRICES_MINOR.items()) + ") AS p(pplan, price_minor)"

_PLANS_SQL = f"""
pe AS (SELECT o_custkey AS user_id, {_PLAN_CASE} AS plan_name, CAST(o_orderdate AS TIMESTAMP) AS ts, o_orderkey AS seq
       FROM orders),
pe2 AS (SELECT *, CASE WHEN plan_name <> 'free' THEN ts + INTERVAL {E.PAID_PERIOD_DAYS} DAY END AS expires_at FROM pe),
plans AS (SELECT user_id, lower(arg_max(plan_name, (ts, seq))) AS plan_name,
                 arg_max_null(expires_at, (ts, seq)) AS expires_at, min(ts) AS created_at, max(ts) AS updated_at,
                 CASE WHEN lower(arg_min(plan_name, (ts, seq))) = 'free' THEN min(ts) END AS free_started_at
          FROM pe2 GROUP BY user_id)"""


def plans_state(spark, sf_dir) -> DataFrame:
    return E.fold_plan_events(plan_events(spark, sf_dir))


def sub_events(spark, sf_dir) -> DataFrame:
    e = T.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    op = (F.when(F.col("event_type").isin("click", "purchase"), "add")
          .when(F.col("event_type") == "view", "checked")
          .when(F.col("event_type") == "error", "remove")
          .when(F.col("event_type") == "signup", "remove_all"))
    return e.select("user_id",
                    F.concat(F.lit("brand#"), (k % 5 + 1).cast("string")).alias("brand"),
                    F.element_at(F.array(F.lit(""), F.lit("ring"), F.lit("small")), (k % 3 + 1).cast("int")).alias("model"),
                    op.alias("op"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))


_SUBS_SQL = """
se AS (SELECT user_id, 'brand#' || CAST(k % 5 + 1 AS VARCHAR) AS brand,
              CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 'ring' ELSE 'small' END AS model,
              CASE event_type WHEN 'click' THEN 'add' WHEN 'purchase' THEN 'add' WHEN 'view' THEN 'checked'
                              WHEN 'error' THEN 'remove' WHEN 'signup' THEN 'remove_all' END AS op,
              CAST(ts AS TIMESTAMP) AS ts, event_id AS seq
       FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
wipes AS (SELECT user_id, max((ts, seq)) AS w FROM se WHERE op = 'remove_all' GROUP BY user_id),
ev AS (SELECT se.* FROM se LEFT JOIN wipes USING (user_id) WHERE op <> 'remove_all' AND (w IS NULL OR (ts, seq) > w)),
pk AS (SELECT user_id, brand, model,
              arg_max(op, (ts, seq)) FILTER (WHERE op IN ('add', 'remove')) AS last_op,
              max((ts, seq)) FILTER (WHERE op = 'add') AS last_add,
              max((ts, seq)) FILTER (WHERE op = 'remove') AS last_rm
       FROM ev GROUP BY user_id, brand, model),
live AS (SELECT * FROM pk WHERE last_op = 'add'),
created AS (SELECT ev.user_id, ev.brand, ev.model, min(ev.ts) AS created_at FROM ev JOIN live USING (user_id, brand, model)
            WHERE ev.op = 'add' AND (last_rm IS NULL OR (ev.ts, ev.seq) > last_rm) GROUP BY ALL),
checked AS (SELECT ev.user_id, ev.brand, ev.model, max(ev.ts) AS last_checked_at
            FROM ev JOIN live USING (user_id, brand, model)
            WHERE ev.op = 'checked' AND (ev.ts, ev.seq) > last_add GROUP BY ALL),
subs_state AS (SELECT l.user_id, l.brand, l.model, c.created_at, k.last_checked_at
               FROM live l LEFT JOIN created c USING (user_id, brand, model)
               LEFT JOIN checked k USING (user_id, brand, model))"""


_ITEMS_SQL = """SELECT DISTINCT user_id, json_extract_string(props, '$.k') AS url FROM events WHERE event_type IN ('click', 'view')"""


def shown_items(spark, sf_dir) -> DataFrame:
    """What users were shown: the items they clicked or viewed."""
    e = T.table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view"))
    return e.select("user_id", F.get_json_object("props", "$.k").alias("url")).distinct()


def subs_state_df(spark, sf_dir) -> DataFrame:
    return subs.fold_subscription_events(sub_events(spark, sf_dir))


# --------------------------------------------------------------------------
# queries
# --------------------------------------------------------------------------

@register("user_upsert", "M8", oracle="""
SELECT user_id, min(CAST(ts AS TIMESTAMP)) AS first_seen_at, max(CAST(ts AS TIMESTAMP)) AS last_seen_at,
       arg_max(CASE WHEN event_type = 'signup' THEN 'user_' || json_extract_string(props, '$.k') END,
               CAST(ts AS TIMESTAMP)) AS username
FROM events GROUP BY user_id""")
def user_upsert(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    seen = e.select("user_id", F.col("ts").cast("timestamp").alias("ts"),
                    F.when(F.col("event_type") == "signup",
                           F.concat(F.lit("user_"), F.get_json_object("props", "$.k"))).alias("username"))
    return subs.fold_users(seen).select("user_id", "first_seen_at", "last_seen_at", "username")


@register("subs_state", "M9 M10 M11 J11 O2 Q4", oracle=f"""WITH {_SUBS_SQL.strip()}
SELECT user_id, brand, model, created_at, last_checked_at,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY brand, model) AS BIGINT) AS pos
FROM subs_state""")
def subs_state(spark, sf_dir):
    return subs.ordered_user_subscriptions(subs_state_df(spark, sf_dir)).select(
        "user_id", "brand", "model", "created_at", "last_checked_at", "pos")


@register("sub_counts", "A1 A3", oracle=f"""WITH {_SUBS_SQL.strip()}
SELECT c.c_custkey AS user_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_subs FROM customer c
LEFT JOIN (SELECT user_id, count(*) AS n FROM subs_state GROUP BY user_id) n ON n.user_id = c.c_custkey""")
def sub_counts(spark, sf_dir):
    users = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return subs.count_per_user(users, subs_state_df(spark, sf_dir))


@register("sub_totals", "A2 M13", oracle=f"""WITH {_SUBS_SQL.strip()}
SELECT count(*) AS n_subs, (SELECT count(*) FROM ({_ITEMS_SQL})) AS n_items, count(DISTINCT user_id) AS n_users FROM subs_state""")
def sub_totals(spark, sf_dir):
    return subs.wipe_totals(subs_state_df(spark, sf_dir), shown_items(spark, sf_dir))


@register("job_stamps", "J11 M11", oracle=f"""WITH {_SUBS_SQL.strip()},
jb AS (SELECT user_id, 'brand#' || CAST(k % 5 + 1 AS VARCHAR) AS b, max(CAST(ts AS TIMESTAMP)) AS at
       FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE event_type = 'purchase' GROUP BY ALL),
w AS (SELECT user_id, brand, bool_or(trim(model) <> '') AS has FROM subs_state GROUP BY ALL)
SELECT s.user_id, s.brand, s.model, s.created_at,
       CASE WHEN jb.at IS NOT NULL AND (trim(s.model) <> '' OR NOT w.has) THEN jb.at ELSE s.last_checked_at END AS last_checked_at
FROM subs_state s JOIN w USING (user_id, brand) LEFT JOIN jb ON jb.user_id = s.user_id AND jb.b = trim(s.brand)""")
def job_stamps(spark, sf_dir):
    """Each purchase is a finished job over one brand."""
    e = T.table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    brand = F.concat(F.lit("brand#"), (F.get_json_object("props", "$.k").cast("bigint") % 5 + 1).cast("string"))
    jobs = e.select("user_id", F.array(brand).alias("brands"), F.col("ts").cast("timestamp").alias("checked_at"))
    return subs.stamp_checked(subs_state_df(spark, sf_dir), jobs)


@register("sub_row_delete", "M10", oracle=with_views_subs("""
SELECT row_id, user_id, brand, model FROM (
    SELECT *, user_id * 2 + CASE WHEN starts_with(brand, 'brand') THEN 0 ELSE 1 END AS row_id FROM subscriptions)
WHERE (row_id, user_id) NOT IN (
    SELECT (user_id * 2 + k % 2, user_id + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END)
    FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'error'))"""))
def sub_row_delete(spark, sf_dir):
    """Delete requests by (row id, owner); every third names the wrong owner."""
    s = T.subscriptions(spark, sf_dir)
    s = s.withColumn("row_id", F.col("user_id") * 2 + F.when(F.col("brand").startswith("brand"), 0).otherwise(1))
    k = F.get_json_object("props", "$.k").cast("bigint")
    requests = T.table(spark, sf_dir, "events").filter(F.col("event_type") == "error").select(
        (F.col("user_id") * 2 + k % 2).alias("row_id"), (F.col("user_id") + F.when(k % 3 == 0, 1).otherwise(0)).alias("user_id"))
    return subs.delete_rows(s, requests).select("row_id", "user_id", "brand", "model")


_EFFECTIVE_SQL = f"""
j AS (SELECT c.c_custkey AS user_id, p.plan_name, p.expires_at, p.free_started_at
      FROM customer c LEFT JOIN plans p ON p.user_id = c.c_custkey),
k AS (SELECT *, coalesce(expires_at IS NOT NULL AND expires_at < {AS_OF_SQL}, false) AS lapsed FROM j),
m AS (SELECT user_id,
             CASE WHEN lapsed THEN 'free' ELSE lower(coalesce(plan_name, 'free')) END AS plan0,
             CASE WHEN plan_name IS NULL THEN {AS_OF_SQL} WHEN lapsed THEN coalesce(free_started_at, expires_at)
                  ELSE free_started_at END AS start,
             CASE WHEN lapsed THEN NULL ELSE expires_at END AS expires_at,
             lower(coalesce(plan_name, 'free')) = 'free' AS is_free
      FROM k),
eff AS (SELECT user_id,
               CASE WHEN plan0 = 'free' AND start IS NOT NULL
                         AND abs(epoch_us({AS_OF_SQL}) - epoch_us(start)) / 86400e6 >= {E.TRIAL_DAYS}
                    THEN 'free_expired' ELSE plan0 END AS plan,
               expires_at, start AS free_started_at, is_free
        FROM m)"""


@register("effective_plan", "M14 M15 M16 M17 J10 P14 Q14 Q6 X27", oracle=f"""WITH {_PLANS_SQL.strip()}, {_EFFECTIVE_SQL.strip()}
SELECT eff.*, coalesce(lim.max_subs, 2) AS max_subs FROM eff LEFT JOIN {_LIMITS_SQL} ON lim.plan = eff.plan""")
def effective_plan(spark, sf_dir):
    users = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return E.effective_plan(users, plans_state(spark, sf_dir), _as_of(spark, sf_dir), E.plan_limits(spark)).select(
        "user_id", "plan", "expires_at", "free_started_at", "is_free", "max_subs")


#: Jobs are the events, moved into the time of the orders.
JOB_SHIFT_DAYS = 8400

_PLAN_AT_SQL = f"""
jobs AS (SELECT event_id, user_id, CAST(ts AS TIMESTAMP) - INTERVAL {JOB_SHIFT_DAYS} DAY AS job_at FROM events),
firsts AS (SELECT user_id, CASE WHEN lower(arg_min(plan_name, (ts, seq))) = 'free' THEN min(ts) END AS free_started_at FROM pe2 GROUP BY user_id),
held AS (SELECT j.event_id, arg_max(pe2.plan_name, (ts, seq)) AS plan_name, arg_max_null(pe2.expires_at, (ts, seq)) AS expires_at
         FROM jobs j JOIN pe2 ON pe2.user_id = j.user_id AND pe2.ts <= j.job_at GROUP BY j.event_id),
j2 AS (SELECT j.*, h.plan_name, h.expires_at, CASE WHEN h.plan_name IS NOT NULL THEN f.free_started_at END AS free_started_at,
              coalesce(h.expires_at < j.job_at, false) AS lapsed
       FROM jobs j LEFT JOIN held h USING (event_id) LEFT JOIN firsts f ON f.user_id = j.user_id),
m AS (SELECT event_id, user_id, job_at, CASE WHEN lapsed THEN 'free' ELSE lower(coalesce(plan_name, 'free')) END AS plan0,
             CASE WHEN plan_name IS NULL THEN job_at WHEN lapsed THEN coalesce(free_started_at, expires_at) ELSE free_started_at END AS start,
             CASE WHEN lapsed THEN NULL ELSE expires_at END AS expires_at
      FROM j2)"""


@register("plan_at_job", "M17 J10 M16 M15", oracle=f"""WITH {_PLANS_SQL.strip()}, {_PLAN_AT_SQL.strip()}
SELECT event_id, user_id, job_at, q.plan, expires_at, coalesce(lim.max_subs, 2) AS max_subs FROM (
    SELECT *, CASE WHEN plan0 = 'free' AND start IS NOT NULL AND abs(epoch_us(job_at) - epoch_us(start)) / 86400e6 >= {E.TRIAL_DAYS}
                   THEN 'free_expired' ELSE plan0 END AS plan FROM m) q LEFT JOIN {_LIMITS_SQL} ON lim.plan = q.plan""")
def plan_at_job(spark, sf_dir):
    """The plan and the limit of every job's user at the time of the job."""
    jobs = T.table(spark, sf_dir, "events").select(
        "event_id", "user_id", (F.col("ts").cast("timestamp") - F.make_dt_interval(F.lit(JOB_SHIFT_DAYS))).alias("at"))
    out = E.plan_at(jobs, E.plan_intervals(plan_events(spark, sf_dir)), E.plan_limits(spark))
    return out.select("event_id", "user_id", F.col("at").alias("job_at"), "plan", "expires_at", "max_subs")


def payment_events(spark, sf_dir) -> DataFrame:
    """(o_orderkey, value): webhook events as they arrive, as JSON text: a
    completed checkout for a settled order, an expired one for an open
    order."""
    o = T.table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("F", "O"))
    plan = T.case_map(F.col("o_orderpriority"), T.PLAN_BY_PRIORITY)
    metadata = F.struct(plan.alias("plan"), F.col("o_custkey").cast("string").alias(E.METADATA_USER_KEY))
    event = F.struct(
        F.col("o_orderkey").cast("string").alias("id"),
        F.when(F.col("o_orderstatus") == "F", F.lit(E.COMPLETED_EVENT)).otherwise(F.lit("checkout.session.expired")).alias("type"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("created"),
        F.struct(F.struct(metadata.alias("metadata")).alias("object")).alias("data"))
    return o.select("o_orderkey", F.to_json(event).alias("value"))


@register("payments_to_plans", "S6 S7 M21 M14 T6", oracle=f"""
WITH pay AS (
    SELECT o_custkey AS user_id, {_PLAN_CASE} AS plan_name, CAST(o_orderdate AS TIMESTAMP) AS ts,
           o_orderkey AS seq
    FROM orders WHERE o_orderstatus IN ('F', 'P'))
SELECT user_id, lower(arg_max(plan_name, (ts, seq))) AS plan_name,
       arg_max(ts, (ts, seq)) + INTERVAL {E.PAID_PERIOD_DAYS} DAY AS expires_at,
       min(ts) AS created_at, max(ts) AS updated_at
FROM pay GROUP BY user_id""")
def payments_to_plans(spark, sf_dir):
    raw_json = payment_events(spark, sf_dir).select("value")
    o = T.table(spark, sf_dir, "orders")
    plan = T.case_map(F.col("o_orderpriority"), T.PLAN_BY_PRIORITY)
    ts = F.col("o_orderdate").cast("timestamp")
    # native payments carry a 'plan:<plan>:<id>' payload
    raw_payload = o.filter(F.col("o_orderstatus") == "P").select(
        F.col("o_orderkey").alias("event_id"), ts.alias("ts"),
        F.concat_ws(":", F.lit("plan"), plan, F.col("o_custkey").cast("string")).alias("payload"))
    pays = (E.parse_payment_json(raw_json)
            .unionByName(E.parse_payment_payload(raw_payload, "payload", "ts", "event_id")))
    act = E.activate_paid(pays).withColumn("seq", F.col("event_id").cast("bigint"))
    return E.fold_plan_events(act).select("user_id", "plan_name", "expires_at", "created_at", "updated_at")


@register("trial_expired", "P13 X21 X22", oracle=f"""WITH {_PLANS_SQL.strip()}
SELECT user_id, free_started_at, round(abs(epoch_us({AS_OF_SQL}) - epoch_us(free_started_at)) / 86400e6, 6) AS age_days,
       free_started_at + INTERVAL {E.TRIAL_DAYS} DAY AS trial_end,
       CAST(date_diff('day', CAST({AS_OF_SQL} AS DATE), CAST(free_started_at + INTERVAL {E.TRIAL_DAYS} DAY AS DATE)) AS BIGINT)
           AS days_left
FROM plans WHERE lower(coalesce(plan_name, 'free')) = 'free' AND free_started_at IS NOT NULL
  AND free_started_at <= {AS_OF_SQL} - INTERVAL {E.TRIAL_DAYS} DAY""")
def trial_expired(spark, sf_dir):
    return E.trial_expired(plans_state(spark, sf_dir), _as_of(spark, sf_dir))


@register("trial_reset", "J12 M13 M19 M20 T5 A3 Q15", oracle=f"""WITH {_PLANS_SQL.strip()}, {_SUBS_SQL.strip()},
ex AS (SELECT DISTINCT user_id FROM plans WHERE lower(coalesce(plan_name, 'free')) = 'free'
       AND free_started_at IS NOT NULL AND free_started_at <= {AS_OF_SQL} - INTERVAL {E.TRIAL_DAYS} DAY)
SELECT ex.user_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_deleted, CAST(coalesce(i.n, 0) AS BIGINT) AS n_items_deleted,
       {AS_OF_SQL} AS free_started_at, {AS_OF_SQL} AS last_free_reset_at, coalesce(n.n, 0) > 0 AS notify
FROM ex LEFT JOIN (SELECT user_id, count(*) AS n FROM subs_state GROUP BY user_id) n USING (user_id)
LEFT JOIN (SELECT user_id, count(*) AS n FROM ({_ITEMS_SQL}) GROUP BY user_id) i USING (user_id)""")
def trial_reset(spark, sf_dir):
    return _reset(spark, sf_dir)[2]


def _reset(spark, sf_dir):
    expired = E.trial_expired(plans_state(spark, sf_dir), _as_of(spark, sf_dir))
    return E.trial_reset(expired, subs_state_df(spark, sf_dir), shown_items(spark, sf_dir), _as_of(spark, sf_dir))


@register("trial_reset_kept", "J12 M13", oracle=f"""WITH {_PLANS_SQL.strip()}, {_SUBS_SQL.strip()},
ex AS (SELECT DISTINCT user_id FROM plans WHERE lower(coalesce(plan_name, 'free')) = 'free'
       AND free_started_at IS NOT NULL AND free_started_at <= {AS_OF_SQL} - INTERVAL {E.TRIAL_DAYS} DAY)
SELECT 'sub' AS kind, user_id, brand || '/' || model AS what FROM subs_state WHERE user_id NOT IN (SELECT user_id FROM ex)
UNION ALL SELECT 'item', user_id, url FROM ({_ITEMS_SQL}) WHERE user_id NOT IN (SELECT user_id FROM ex)""")
def trial_reset_kept(spark, sf_dir):
    """What the reset leaves: subscriptions and shown items of all others."""
    kept, items, _ = _reset(spark, sf_dir)
    return kept.select(F.lit("sub").alias("kind"), "user_id", F.concat_ws("/", "brand", "model").alias("what")).unionByName(
        items.select(F.lit("item").alias("kind"), "user_id", F.col("url").alias("what")))


_QUOTA_SEL = """
SELECT DISTINCT user_id, 'b' || CAST(k % 7 AS VARCHAR) AS brand, 'm' || CAST(k % 3 AS VARCHAR) AS model
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE event_type IN ({types})"""


@register("quota_admission", "W2 P15 J10 Q23", oracle=f"""
WITH sel AS ({_QUOTA_SEL.format(types="'click', 'view'")}),
held AS ({_QUOTA_SEL.format(types="'purchase'")}),
nh AS (SELECT user_id, count(*) AS n FROM held GROUP BY user_id),
s AS (SELECT sel.*, h.user_id IS NULL AS is_new FROM sel LEFT JOIN held h USING (user_id, brand, model)),
lim AS (SELECT DISTINCT user_id,
               CASE user_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 10 WHEN 2 THEN 20 ELSE 50 END AS max_subs FROM events)
SELECT s.user_id, s.brand, s.model, s.is_new,
       CAST(coalesce(nh.n, 0) + coalesce(sum(CAST(s.is_new AS INTEGER)) OVER (
           PARTITION BY s.user_id ORDER BY s.brand, s.model ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           AS BIGINT) AS count_before,
       coalesce(nh.n, 0) + coalesce(sum(CAST(s.is_new AS INTEGER)) OVER (
           PARTITION BY s.user_id ORDER BY s.brand, s.model ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           < lim.max_subs AS admitted
FROM s LEFT JOIN nh USING (user_id) LEFT JOIN lim USING (user_id)""")
def quota_admission(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")

    def pick(types):
        return (e.filter(F.col("event_type").isin(*types))
                .select("user_id", F.concat(F.lit("b"), (k % 7).cast("string")).alias("brand"),
                        F.concat(F.lit("m"), (k % 3).cast("string")).alias("model")).distinct())

    sel = pick(["click", "view"]).withColumn("pos", F.struct("brand", "model"))
    held = pick(["purchase"])
    plans = F.element_at(F.array(*[F.lit(p) for p in ("free", "starter", "pro", "dealer")]),
                         (F.col("user_id") % 4 + 1).cast("int"))
    limits = E.with_limit(e.select("user_id").distinct().withColumn("plan", plans), E.plan_limits(spark))
    out = runs.quota_admission(sel, held, limits.select("user_id", "max_subs"))
    return out.select("user_id", "brand", "model", "is_new", F.col("count_before").cast("bigint").alias("count_before"),
                      "admitted")


@register("plan_months", "M18 Q3", oracle=f"""
SELECT o_orderkey AS order_key, o_custkey AS user_id,
       CASE WHEN m >= 9999 THEN NULL ELSE ts + to_months(m) END AS expires_at,
       CASE WHEN m >= 9999 THEN NULL
            ELSE date_trunc('month', ts) + to_months(m) + to_days(CAST(day(ts) - 1 AS INTEGER))
                 + (ts - date_trunc('day', ts)) END AS expires_at_overflow
FROM (SELECT *, CAST(o_orderdate AS TIMESTAMP) AS ts,
             CAST(CASE WHEN o_orderkey % 15 = 14 THEN 9999 ELSE o_orderkey % 15 END AS INTEGER) AS m FROM orders)""")
def plan_months(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders")
    ts = F.col("o_orderdate").cast("timestamp")
    months = F.when(F.col("o_orderkey") % 15 == 14, F.lit(E.LIFETIME_MONTHS)).otherwise(F.col("o_orderkey") % 15)
    return o.select(F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("user_id"),
                    E.months_expiry(ts, months).alias("expires_at"),
                    E.months_expiry(ts, months, overflow=True).alias("expires_at_overflow"))


@register("plan_price", "J14 X26", oracle=f"""
SELECT o_orderkey AS order_key, plan, p.price_minor,
       CASE WHEN p.price_minor IS NULL THEN NULL ELSE printf('%.2f', p.price_minor / 100.0) END AS price_text,
       p.price_minor IS NULL AS rejected
FROM (SELECT o_orderkey, {_PLAN_CASE} AS plan FROM orders) o
LEFT JOIN {_PRICES_SQL} ON p.pplan = o.plan""")
def plan_price(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_key"), T.case_map(F.col("o_orderpriority"), T.PLAN_BY_PRIORITY).alias("plan"))
    pr = E.plan_prices(spark).withColumnRenamed("plan", "_pp")
    j = o.join(F.broadcast(pr), F.col("plan") == F.col("_pp"), "left")
    return j.select("order_key", "plan", "price_minor", E.price_text(F.col("price_minor")).alias("price_text"),
                    F.col("price_minor").isNull().alias("rejected"))


@register("plan_schema_evolution", "M22", oracle=f"""
SELECT o_orderkey AS order_key, o_custkey AS user_id, {_PLAN_CASE} AS plan_name,
       CASE WHEN o_orderdate >= TIMESTAMP '{SCHEMA_SPLIT}' AND {_PLAN_CASE} = 'free'
            THEN CAST(o_orderdate AS TIMESTAMP) END AS free_started_at,
       CAST(NULL AS TIMESTAMP) AS last_free_reset_at
FROM orders""")
def plan_schema_evolution(spark, sf_dir):
    """Files of an older schema (no trial columns, the user's id as a short
    integer) beside files of the newer one, read as one table."""
    o = T.table(spark, sf_dir, "orders")
    plan = T.case_map(F.col("o_orderpriority"), T.PLAN_BY_PRIORITY)
    ts = F.col("o_orderdate").cast("timestamp")
    old_rows = ts < F.lit(SCHEMA_SPLIT).cast("timestamp")
    key, user = F.col("o_orderkey").alias("order_key"), F.col("o_custkey")
    root = f"{checkpoint_dir(spark).rstrip('/')}/listwatch-plan-files-{uuid.uuid4().hex}"
    (o.filter(old_rows).select(key, user.cast("int").alias("user_id"), plan.alias("plan_name")).write.parquet(f"{root}/v1"))
    (o.filter(~old_rows).select(key, user.cast("bigint").alias("user_id"), plan.alias("plan_name"),
                                F.when(plan == "free", ts).alias("free_started_at"),
                                F.lit(None).cast("timestamp").alias("last_free_reset_at")).write.parquet(f"{root}/v2"))
    return read_versions(spark, [f"{root}/v1", f"{root}/v2"])


@register("user_scoped_scan", "S5 O2", oracle=with_views_subs("""
SELECT user_id, brand, model, CAST(row_number() OVER (PARTITION BY user_id ORDER BY brand, model) AS BIGINT) AS pos
FROM subscriptions WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')"""))
def user_scoped_scan(spark, sf_dir):
    """S5 for many keys at once: the subscriptions of a key set (users with a
    purchase) by a semi-join, ordered per user by brand, model."""
    keys = T.table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase").select("user_id")
    s = T.subscriptions(spark, sf_dir).join(keys, "user_id", "left_semi")
    return subs.ordered_user_subscriptions(s).select("user_id", "brand", "model", "pos")
