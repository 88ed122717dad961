"""Queries of build step 4: selection keys, accepted runs, due
subscriptions, the run log, the deny-list and parsed log lines.

Runs come from ``events``: user_id, brand_key = event_type, started_at = ts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from listwatch.operators import runs, subs
from listwatch.plans.oracle_views import with_views
from listwatch.plans.registry import register
from listwatch.session import checkpoint_dir
from listwatch.sources import logs
from listwatch.sources import tables as T

DAY_S = 86400
HOUR_S = 3600
RUN_WINDOW_S = 3600       # scheduler suppression window, 60 min
PENDING_S = 2 * 3600      # a queued manual job stays pending 2 h
PENDING_MIN_VALUE = 40.0  # events with value >= this are queued manual jobs
LOG_SPLIT = "2024-01-15"
DUE_TICKS = 24            # hourly ticks that are asked for, up to the newest run


@register("selection_keys", "X7 O4", oracle=with_views(["subscriptions"], """
SELECT user_id,
       coalesce(nullif(array_to_string(list_sort(list(trim(brand)) FILTER (WHERE brand IS NOT NULL AND trim(brand) <> '')), '|'), ''), '*') AS brand_key,
       coalesce(nullif(array_to_string(list_sort(list(trim(model)) FILTER (WHERE model IS NOT NULL AND trim(model) <> '')), '|'), ''), '*') AS model_key
FROM subscriptions GROUP BY user_id"""))
def selection_keys(spark, sf_dir):
    s = T.subscriptions(spark, sf_dir)
    return (s.groupBy("user_id")
            .agg(F.collect_list("brand").alias("b"), F.collect_list("model").alias("m"))
            .select("user_id", runs.selection_key(F.col("b")).alias("brand_key"),
                    runs.selection_key(F.col("m")).alias("model_key")))


_RUNS_SQL = """SELECT event_id, user_id, event_type AS brand_key, 'm' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS VARCHAR) AS model_key,
                      CAST(ts AS TIMESTAMP) AS started_at, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS t, value FROM events"""
_ACC_SQL = """acc AS (
    SELECT user_id, brand_key, model_key, arg_min(event_id, (t, event_id)) AS event_id, min(t) AS t FROM r GROUP BY ALL
    UNION ALL
    SELECT r.user_id, r.brand_key, r.model_key, arg_min(r.event_id, (r.t, r.event_id)), min(r.t)
    FROM acc a JOIN r ON r.user_id = a.user_id AND r.brand_key = a.brand_key AND r.model_key = a.model_key AND r.t > a.t + {w}
    GROUP BY r.user_id, r.brand_key, r.model_key)"""
_ACCEPTED_SQL = f"""
WITH RECURSIVE r AS ({_RUNS_SQL}),
{_ACC_SQL}
SELECT event_id, user_id, brand_key, model_key, started_at FROM r WHERE event_id IN (SELECT event_id FROM acc)"""


@register("accepted_runs", "W3", oracle=_ACCEPTED_SQL.format(w=DAY_S))
def accepted_runs(spark, sf_dir):
    return runs.accepted_runs(T.job_runs(spark, sf_dir), T.RUN_KEY, "started_at", "event_id", DAY_S)


_KEY_SQL = "user_id, brand_key, model_key"
_SAME_KEY = "r.user_id = t.user_id AND r.brand_key = t.brand_key AND r.model_key = t.model_key"
_DUE_SQL = f"""
WITH r AS ({_RUNS_SQL}),
hi AS (SELECT make_timestamp(CAST(floor(epoch_us(max(started_at)) / ({HOUR_S} * 1000000.0)) * {HOUR_S} * 1000000 AS BIGINT)) AS h FROM r),
tk AS (SELECT unnest(generate_series(h - INTERVAL {DUE_TICKS - 1} HOUR, h, INTERVAL 1 HOUR)) AS tick FROM hi),
span AS (SELECT {_KEY_SQL}, min(started_at) AS first_at FROM r GROUP BY ALL),
ticks AS (SELECT {_KEY_SQL}, tick FROM span JOIN tk ON first_at <= tick),
recent AS (SELECT DISTINCT t.user_id, t.brand_key, t.model_key, t.tick FROM ticks t JOIN r
           ON {_SAME_KEY} AND r.started_at >= t.tick - INTERVAL {RUN_WINDOW_S} SECOND AND r.started_at <= t.tick),
waiting AS (SELECT DISTINCT t.user_id, t.brand_key, t.model_key, t.tick FROM ticks t JOIN r
            ON {_SAME_KEY} AND r.value >= {PENDING_MIN_VALUE}
           AND r.started_at >= t.tick - INTERVAL {PENDING_S} SECOND AND r.started_at <= t.tick)
SELECT {_KEY_SQL}, tick FROM ticks
EXCEPT SELECT {_KEY_SQL}, tick FROM recent EXCEPT SELECT {_KEY_SQL}, tick FROM waiting"""


@register("due_subscriptions", "T1 J7 J8 O5", oracle=_DUE_SQL)
def due_subscriptions(spark, sf_dir):
    """What is due at each of the last DUE_TICKS hourly ticks."""
    r = T.job_runs(spark, sf_dir)
    value = T.table(spark, sf_dir, "events").select("event_id", "value").filter(F.col("value") >= PENDING_MIN_VALUE)
    span = r.groupBy(*T.RUN_KEY).agg(F.min("started_at").alias("first_at"))
    pending = r.join(value, "event_id", "left_semi").withColumnRenamed("started_at", "queued_at")
    newest = r.select(F.max("started_at")).scalar()
    last = F.date_trunc("hour", newest)
    return runs.due_at_ticks(span, T.RUN_KEY, r, pending, last - F.make_dt_interval(hours=F.lit(DUE_TICKS - 1)), last,
                             HOUR_S, RUN_WINDOW_S, PENDING_S)


@register("run_log_append", "K6 W3", oracle=f"""
WITH RECURSIVE a0 AS ({_RUNS_SQL}),
logged AS (SELECT {_KEY_SQL}, max(t) AS last_t FROM a0 WHERE started_at < TIMESTAMP '{LOG_SPLIT}' GROUP BY ALL),
r AS (SELECT a0.* FROM a0 LEFT JOIN logged l ON l.user_id = a0.user_id AND l.brand_key = a0.brand_key AND l.model_key = a0.model_key
      WHERE a0.started_at >= TIMESTAMP '{LOG_SPLIT}' AND (l.last_t IS NULL OR a0.t > l.last_t + {RUN_WINDOW_S})),
{_ACC_SQL.format(w=RUN_WINDOW_S)}
SELECT user_id, brand_key, model_key, started_at FROM a0 WHERE started_at < TIMESTAMP '{LOG_SPLIT}'
UNION ALL
SELECT user_id, brand_key, model_key, started_at FROM a0 WHERE event_id IN (SELECT event_id FROM acc)""")
def run_log_append(spark, sf_dir):
    """The run log after a batch of requests: the stored log (runs before
    LOG_SPLIT), to which the accepted requests after it are appended
    (60 min suppression, judged against the log)."""
    r = T.job_runs(spark, sf_dir)
    split = F.lit(LOG_SPLIT).cast("timestamp")
    path = f"{checkpoint_dir(spark).rstrip('/')}/listwatch-run-log-{uuid.uuid4().hex}"
    runs.append_runs(r.filter(F.col("started_at") < split), path)
    log = spark.read.parquet(path)
    runs.append_runs(runs.accepted_after(log, r.filter(F.col("started_at") >= split), T.RUN_KEY, "started_at", "event_id",
                                         RUN_WINDOW_S, bucket_s=HOUR_S), path)
    return spark.read.parquet(path)


_UNFLAGGED_SQL = f"""
SELECT p.event_id, p.user_id, CAST(p.ts AS TIMESTAMP) AS ts FROM events p
WHERE p.event_type = 'purchase' AND NOT EXISTS (
    SELECT 1 FROM events f WHERE f.event_type = 'error' AND f.user_id = p.user_id
      AND f.ts <= p.ts AND epoch_us(p.ts) - epoch_us(f.ts) < CAST({DAY_S} AS BIGINT) * 1000000)"""


@register("recent_flag_antijoin", "J9 T7", oracle=_UNFLAGGED_SQL)
def recent_flag_antijoin(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"),
                                                "event_type")
    actions = e.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    flags = e.filter(F.col("event_type") == "error").select("user_id", "ts")
    return runs.drop_recently_flagged(actions, flags, "user_id", DAY_S)


@register("user_selection_sets", "A6", oracle=with_views(["subscriptions"], """
SELECT user_id, array_to_string(list_sort(list_distinct(list(trim(brand)))), '|') AS brands,
       coalesce(array_to_string(list_sort(list_distinct(list(trim(model)) FILTER (WHERE trim(model) <> ''))), '|'), '')
           AS models,
       count(*) AS n_subs
FROM subscriptions GROUP BY user_id"""))
def user_selection_sets(spark, sf_dir):
    return subs.user_selection_sets(T.subscriptions(spark, sf_dir))


@register("log_lines", "S8 X28", oracle=f"""
WITH lines AS (
    SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' port=' || CAST(user_id % 1000 + 9000 AS VARCHAR) || ' ' ||
           CASE WHEN value < 45 THEN '10.' || CAST(user_id % 256 AS VARCHAR) || '.' || CAST(event_id % 256 AS VARCHAR)
                                     || '.' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)
                ELSE 'host-' || CAST(user_id AS VARCHAR) END
           || ' reason=' || event_type AS line
    FROM events)
SELECT regexp_extract(line, '^(\\S+) port=([0-9]+) (\\S+) reason=(.*)$', 1) AS ts_text,
       CAST(regexp_extract(line, '^(\\S+) port=([0-9]+) (\\S+) reason=(.*)$', 2) AS INTEGER) AS port,
       regexp_extract(line, '^(\\S+) port=([0-9]+) (\\S+) reason=(.*)$', 3) AS ip,
       regexp_extract(line, '^(\\S+) port=([0-9]+) (\\S+) reason=(.*)$', 4) AS reason,
       regexp_matches(regexp_extract(line, '^(\\S+) port=([0-9]+) (\\S+) reason=(.*)$', 3),
                      '^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$') AS ip_valid
FROM lines""")
def log_lines(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    ip = F.when(F.col("value") < 45,
                F.concat_ws(".", F.lit("10"), (F.col("user_id") % 256).cast("string"),
                            (F.col("event_id") % 256).cast("string"), F.floor("value").cast("bigint").cast("string"))
                ).otherwise(F.concat(F.lit("host-"), F.col("user_id").cast("string")))
    lines = e.select(F.concat(
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit(" port="), (F.col("user_id") % 1000 + 9000).cast("string"), F.lit(" "), ip,
        F.lit(" reason="), F.col("event_type")).alias("value"))
    return logs.parse_flag_lines(lines)
