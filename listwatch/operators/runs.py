"""Run bookkeeping: selection keys (X7, O4), accepted-run suppression (W3),
due subscriptions at scheduler ticks (T1, J7, J8, O5), the run log sink
(K6), the recently-flagged deny-list (J9, T7) and quota admission (W2, P15).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwatch.operators.entitlements import UNKNOWN_PLAN_LIMIT
from listwatch.operators.windows import carry_last, group_key
from listwatch.session import SharedTables


def selection_key(names: Column) -> Column:
    """Trim, drop empty/NULL, sort (duplicates kept), join with '|';
    an empty result is '*'."""
    cleaned = F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.nullif(F.array_join(F.array_sort(cleaned), "|"), F.lit("")), F.lit("*"))


# ---------------------------------------------------------------------------
# Accepted runs
# ---------------------------------------------------------------------------

def next_after_window(runs: DataFrame, keys: list[str], window_s: int, bucket_s: int) -> DataFrame:
    """For every run (keys, id, t) the id of the first run of the same key
    with t' > t + window (NULL if none).

    Probe rows at t + window are merged with the runs; runs sort before
    probes at equal t, so the strict '>' holds. The "first run after the
    probe" is a reverse carry over (key, time bucket) windows, so a hot key
    is spread over its time buckets.
    """
    ev = runs.select(*keys, "t", F.lit(0).alias("kind"), F.col("id").alias("rid"), F.col("id").alias("src"))
    probes = runs.select(*keys, (F.col("t") + F.lit(window_s)).alias("t"), F.lit(1).alias("kind"),
                         F.lit(None).cast("bigint").alias("rid"), F.col("id").alias("src"))
    u = ev.unionByName(probes)
    c = carry_last(u, keys, ["t", "kind", "src"], F.col("rid"), F.floor(F.col("t") / F.lit(bucket_s)),
                   "nxt", include_current=False, reverse=True)
    return c.filter(F.col("kind") == 1).select(F.col("src").alias("id"), "nxt")


#: Runs of a segment that are folded in one row.
SHORT_SEGMENT = 256


def _fold(runs: str, window_s: int) -> Column:
    """Ids of the accepted runs of a sorted array of (t, id)."""
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.filter(F.transform(runs, lambda x: x.id), lambda _: F.lit(False)).alias("ids"))

    def step(acc, x):
        taken = F.struct(x.t.alias("last"), F.concat(acc.ids, F.array(x.id)).alias("ids"))
        return F.when(acc.last.isNull() | (x.t > acc.last + F.lit(window_s)), taken).otherwise(acc)
    return F.aggregate(runs, start, step, lambda acc: acc.ids)


def accepted_runs(runs: DataFrame, keys: list[str], ts: str, id_col: str, window_s: int,
                  bucket_s: int = 86400, short: int = SHORT_SEGMENT) -> DataFrame:
    """A run is accepted when no *accepted* run of the same key lies
    within ``window_s`` seconds before it (inclusive); later runs compare to
    the last accepted one, not to the last request.

    A run more than the window after the run before it is accepted whatever
    came earlier, so each such run starts a *segment* of its own; most
    segments are single runs and are done. Those of up to ``short`` runs are
    gathered and folded, one row each. In longer ones the accepted runs are
    the orbit of the first run under ``next`` (first run after t + window),
    collected by pointer doubling: each round joins the found set with the
    2^k-step jump table and squares the table, so the work is a few joins on
    run ids and log2 of the longest segment rounds. Neither the segments nor
    the jumps gather a key in one task (windows are split by time bucket).
    Each round is a table in the shared folder; older rounds are dropped.
    """
    tables = SharedTables(runs.sparkSession, "accepted")
    named = segments(runs.select(*keys, id_col, ts), keys, ts, id_col, window_s, bucket_s)
    chains = tables.save(named.select(F.col(id_col).alias("id"), "t", "segment"), "segments")
    accepted = accepted_of(chains, window_s, tables, bucket_s, short)
    return runs.join(accepted.withColumnRenamed("id", id_col), id_col, "left_semi")


def accepted_of(chains: DataFrame, window_s: int, tables: SharedTables, bucket_s: int = 86400, short: int = SHORT_SEGMENT) -> DataFrame:
    """W3 on whole segments: the ids that are accepted of (id, t, segment), a stored table; a segment is named by its
    first run."""
    heads = chains.filter(F.col("id") == F.col("segment"))
    sizes = chains.groupBy("segment").count().filter(F.col("count") > 1)
    few = (chains.join(sizes.filter(F.col("count") <= short), "segment", "left_semi").groupBy("segment")
           .agg(F.array_sort(F.collect_list(F.struct("t", "id"))).alias("_runs")).select(F.explode(_fold("_runs", window_s)).alias("id")))
    chained = chains.join(sizes.filter(F.col("count") > short), "segment", "left_semi")
    if chained.isEmpty():
        return heads.select("id").unionByName(few).distinct()
    jump = tables.save(next_after_window(chained, ["segment"], window_s, bucket_s).filter(F.col("nxt").isNotNull()), "jump-0")
    found = tables.save(chained.filter(F.col("id") == F.col("segment")).select("id"), "found-0")
    k = 0
    while not jump.isEmpty():
        step = found.join(jump, "id").select(F.col("nxt").alias("id"))
        found = tables.save(found.unionByName(step), f"found-{k + 1}")
        a, b = jump.alias("a"), jump.alias("b")
        jump = tables.save(a.join(b, F.col("a.nxt") == F.col("b.id"))
                           .select(F.col("a.id").alias("id"), F.col("b.nxt").alias("nxt")), f"jump-{k + 1}")
        tables.drop(f"found-{k}")
        tables.drop(f"jump-{k}")
        k += 1
    return heads.select("id").unionByName(few).unionByName(found).distinct()


def accepted_after(log: DataFrame, requests: DataFrame, keys: list[str], ts: str, id_col: str, window_s: int,
                   bucket_s: int = 86400) -> DataFrame:
    """K6 + W3: the requests that are accepted given the runs that the log
    holds already. Requests are not older than their key's last logged run;
    one within the window after it is refused, whatever came in between."""
    last = log.groupBy(group_key(keys).alias("_k")).agg(F.max(F.unix_seconds(F.date_trunc("second", ts))).alias("_last"))
    asked = requests.withColumn("_k", group_key(keys)).join(last, "_k", "left")
    past = F.unix_seconds(F.date_trunc("second", F.col(ts))) > F.col("_last") + F.lit(window_s)
    return accepted_runs(asked.filter(F.col("_last").isNull() | past).drop("_k", "_last"), keys, ts, id_col, window_s, bucket_s)


def segments(runs: DataFrame, keys: list[str], ts: str, id_col: str, window_s: int, bucket_s: int = 86400) -> DataFrame:
    """The runs with ``t``, their second, and ``segment``, the id of the first
    run of their segment: a run more than the window after the run before it
    starts one, and what is accepted in one does not depend on any other."""
    r = runs.withColumn("t", F.unix_seconds(F.date_trunc("second", F.col(ts))))
    bucket = F.floor(F.col("t") / F.lit(bucket_s))
    r = carry_last(r, keys, ["t", id_col], F.col("t"), bucket, "_prev_t")
    head = F.when(F.col("_prev_t").isNull() | (F.col("t") - F.col("_prev_t") > window_s), F.col(id_col))
    return carry_last(r, keys, ["t", id_col], head, bucket, "segment", include_current=True).drop("_prev_t")


# ---------------------------------------------------------------------------
# Due subscriptions at scheduler ticks
# ---------------------------------------------------------------------------

def _ceil_to(c: Column, period_s: int) -> Column:
    us = F.lit(period_s * 1_000_000)
    return F.timestamp_micros(-F.floor(-F.unix_micros(c) / us) * us)


def _floor_to(c: Column, period_s: int) -> Column:
    us = F.lit(period_s * 1_000_000)
    return F.timestamp_micros(F.floor(F.unix_micros(c) / us) * us)


def covered_ticks(start: Column, end: Column, period_s: int) -> Column:
    """The scheduler ticks (multiples of ``period_s``) in [start, end]."""
    return F.sequence(_ceil_to(start, period_s), _floor_to(end, period_s),
                      F.make_dt_interval(secs=F.lit(period_s)))


def due_at_ticks(keys_span: DataFrame, keys: list[str], runs: DataFrame, pending: DataFrame, first_tick: Column,
                 last_tick: Column, period_s: int, window_s: int, pending_s: int) -> DataFrame:
    """(keys, tick) for each scheduler tick in [first_tick, last_tick]
    at which a key that exists by then is due: no run in [tick - window,
    tick] (J7, inclusive) and no job still pending (J8). Each run is turned
    into the few ticks it covers, so the interval anti-join becomes an equi
    anti-join on (keys, tick); no nested loop, no key gathered into one
    task. The result is keys x ticks asked for, not the keys' whole life."""
    step = F.make_dt_interval(secs=F.lit(period_s))
    start = F.greatest(_ceil_to(F.col("first_at"), period_s), F.col("_lo"))
    spans = keys_span.select(*keys, "first_at", first_tick.alias("_lo"), last_tick.alias("_hi"))
    ticks = spans.filter(start <= F.col("_hi")).select(*keys, F.explode(F.sequence(start, F.col("_hi"), step)).alias("tick"))

    def covered(df, since, seconds):
        rows = df.select(*keys, F.col(since).alias("_s"), first_tick.alias("_lo"), last_tick.alias("_hi"))
        rows = rows.filter((F.col("_s") + F.make_dt_interval(secs=F.lit(seconds)) >= F.col("_lo")) & (F.col("_s") <= F.col("_hi")))
        return rows.select(*keys, F.explode(covered_ticks(
            F.col("_s"), F.col("_s") + F.make_dt_interval(secs=F.lit(seconds)), period_s)).alias("tick"))

    return (ticks.join(covered(runs, "started_at", window_s), [*keys, "tick"], "left_anti")
            .join(covered(pending, "queued_at", pending_s), [*keys, "tick"], "left_anti"))


def append_runs(runs: DataFrame, path: str) -> None:
    """K6: append-only run log."""
    runs.select("user_id", "brand_key", "model_key", "started_at").write.mode("append").parquet(path)


# ---------------------------------------------------------------------------
# Recently flagged keys
# ---------------------------------------------------------------------------

def drop_recently_flagged(actions: DataFrame, flags: DataFrame, key: str, ttl_s: int,
                          bucket: Column | None = None) -> DataFrame:
    """Keep actions whose key has no flag at or before the action with
    action_ts - flag_ts < ttl (strict). An as-of join: flags and actions are
    merged per key in time order and the latest flag is carried forward
    (flags sort before actions at equal time)."""
    a = actions.select("*", F.lit(1).alias("_kind"), F.lit(None).cast("timestamp").alias("_flag_ts"))
    f = flags.select(key, "ts", F.lit(0).alias("_kind"), F.col("ts").alias("_flag_ts"))
    for c in a.columns:
        if c not in f.columns:
            f = f.withColumn(c, F.lit(None).cast(a.schema[c].dataType))
    u = a.unionByName(f.select(*a.columns))
    bucket = bucket if bucket is not None else F.date_trunc("day", F.col("ts"))
    c = carry_last(u, [key], ["ts", "_kind"], F.col("_flag_ts"), bucket, "_last_flag", include_current=True)
    alive = F.col("_last_flag").isNull() | (
        F.unix_micros(F.col("ts")) - F.unix_micros(F.col("_last_flag")) >= F.lit(ttl_s * 1_000_000))
    return c.filter((F.col("_kind") == 1) & alive).drop("_kind", "_flag_ts", "_last_flag")


# ---------------------------------------------------------------------------
# Quota admission
# ---------------------------------------------------------------------------

def quota_admission(selection: DataFrame, existing: DataFrame, limits: DataFrame) -> DataFrame:
    """Walk a user's selection in (brand, model) order and admit an item
    while the user's subscription count is below the limit. Already held
    pairs and repeats in the selection do not raise the count; once the
    count reaches the limit nothing more is admitted.

    ``selection``: user_id, brand, model, pos (walk order);
    ``existing``: user_id, brand, model; ``limits``: user_id, max_subs (a
    user without a limit has that of an unknown plan).
    The count before each item is the user's existing count plus the new
    items before it, a running sum over one user's selection (bounded by the
    catalog, not by the data)."""
    held = existing.select("user_id", "brand", "model").distinct().withColumn("_held", F.lit(True))
    n_held = existing.select("user_id", "brand", "model").distinct().groupBy("user_id").agg(
        F.count(F.lit(1)).alias("_n_held"))
    w_first = Window.partitionBy("user_id", "brand", "model").orderBy("pos")
    s = (selection.join(held, ["user_id", "brand", "model"], "left")
         .withColumn("_first", F.row_number().over(w_first) == 1)
         .withColumn("is_new", F.col("_held").isNull() & F.col("_first")))
    w = Window.partitionBy("user_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    s = (s.join(n_held, "user_id", "left").join(limits, "user_id", "left")
         .withColumn("count_before", F.coalesce("_n_held", F.lit(0))
                     + F.coalesce(F.sum(F.col("is_new").cast("int")).over(w), F.lit(0)))
         .withColumn("admitted", F.col("count_before") < F.coalesce("max_subs", F.lit(UNKNOWN_PLAN_LIMIT))))
    return s.drop("_held", "_first", "_n_held")
