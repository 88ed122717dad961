"""Window operators: top-k per group (W1), gaps-and-islands (W4),
hysteresis flag (W7), weighted interleave (W8), change-only snapshots (T8).

Every window here is partitioned by a key; none pulls all rows into one
task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int,
                    rank_col: str = "rn", total_col: str | None = "n_total") -> DataFrame:
    """The first ``k`` rows per group by ``order`` plus the group's
    total row count.

    ``row_number() <= k`` is planned with a group limit before the shuffle,
    so a hot group sends at most k rows per map task. The total is a
    separate partial aggregate (not a window count) for the same reason, and
    both sides arrive hash-partitioned on the group for the final join.
    A NULL key is a group like any other.
    """
    d = df.withColumn("_g", group_key(keys))
    w = Window.partitionBy("_g").orderBy(*order)
    top = d.withColumn(rank_col, F.row_number().over(w).cast("bigint")).filter(F.col(rank_col) <= k)
    if total_col is None:
        return top.drop("_g")
    totals = d.groupBy("_g").agg(F.count(F.lit(1)).alias(total_col))
    return top.join(totals, "_g", "inner").drop("_g")


def group_key(keys: list[str]) -> Column:
    """The key columns as one struct. A struct of NULLs is a value, so rows
    with NULL keys survive an equi-join on it, and windows, aggregates and
    joins on the same struct share one partitioning."""
    return F.struct(*[F.col(k) for k in keys])


def remaining_beyond(total: Column, cap: int) -> Column:
    """The "and N more" count of A9/W1."""
    return F.greatest(F.lit(0), total - F.lit(cap))


def carry_last(df: DataFrame, keys: list[str], order_cols: list[str], value: Column, bucket: Column,
               out: str, include_current: bool = False, reverse: bool = False) -> DataFrame:
    """Adds ``out`` = the last non-NULL ``value`` of the same key in
    ``order_cols`` order, strictly before the row (or up to and including it
    with ``include_current``).

    A window over ``partitionBy(keys)`` would put a hot key into one task.
    Here the running window is per (keys, bucket) - ``bucket`` must be
    non-decreasing in the order, e.g. a date truncation - and the carry-in
    from earlier buckets comes from a one-row-per-bucket summary with a small
    window per key. Exact for any bucket choice. ``reverse`` walks the order
    backwards: the first non-NULL value *after* the row.
    """
    seq = F.struct(*[F.col(c) for c in order_cols])
    d = df.withColumn("_cb", bucket).withColumn("_cv", value).withColumn("_ck", group_key([*keys, "_cb"]))
    end = 0 if include_current else -1
    order = [F.col(c).desc() for c in order_cols] if reverse else [F.col(c) for c in order_cols]
    w_in = Window.partitionBy("_ck").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    d = d.withColumn("_c_in", F.last("_cv", ignorenulls=True).over(w_in))
    pick = F.min_by if reverse else F.max_by
    summary = (d.groupBy("_ck")
               .agg(pick("_cv", F.when(F.col("_cv").isNotNull(), seq)).alias("_c_last")))
    b_order = F.col("_ck._cb").desc() if reverse else F.col("_ck._cb")
    w_b = Window.partitionBy(*[F.col(f"_ck.{k}") for k in keys]).orderBy(b_order).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select("_ck", F.last("_c_last", ignorenulls=True).over(w_b).alias("_c_prev"))
    return (d.join(carry, "_ck", "left")
            .withColumn(out, F.coalesce("_c_in", "_c_prev"))
            .drop("_ck", "_cb", "_cv", "_c_in", "_c_prev"))


def row_number_split(df: DataFrame, keys: list[str], order_cols: list[str], bucket: Column,
                     out: str = "rn") -> DataFrame:
    """Exact ``row_number()`` per key in ``order_cols`` order, computed per
    (key, bucket) plus the row count of the key's earlier buckets, so a hot
    key is numbered by many tasks. ``bucket`` must be non-decreasing in the
    order."""
    d = df.withColumn("_rb", bucket).withColumn("_rk", group_key([*keys, "_rb"]))
    w_in = Window.partitionBy("_rk").orderBy(*order_cols)
    d = d.withColumn("_rn_in", F.row_number().over(w_in))
    counts = d.groupBy("_rk").agg(F.count(F.lit(1)).alias("_n"))
    w_b = (Window.partitionBy(*[F.col(f"_rk.{k}") for k in keys]).orderBy(F.col("_rk._rb"))
           .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_rk", F.coalesce(F.sum("_n").over(w_b), F.lit(0)).alias("_off"))
    return (d.join(offsets, "_rk", "inner")
            .withColumn(out, (F.col("_rn_in") + F.col("_off")).cast("bigint"))
            .drop("_rk", "_rb", "_rn_in", "_off"))


def skip_ranges(df: DataFrame, keys: list[str], idx: str, flag: str) -> DataFrame:
    """Runs of consecutive flagged indices per key as (start, end, n).
    Island key = idx - rank among flagged rows; the rank uses a split row
    number so a hot key is not one task."""
    f = df.filter(F.col(flag))
    f = row_number_split(f, keys, [idx], F.floor(F.col(idx) / F.lit(4096)), "_k")
    return (f.groupBy(*keys, (F.col(idx) - F.col("_k")).alias("_island"))
            .agg(F.min(idx).alias("start_idx"), F.max(idx).alias("end_idx"), F.count(F.lit(1)).alias("n_skipped"))
            .drop("_island"))


def hysteresis(df: DataFrame, keys: list[str], order_cols: list[str], metric: Column, on_at: float, off_at: float,
               bucket: Column, out: str = "flag") -> DataFrame:
    """ON when metric >= on_at, OFF when metric <= off_at, otherwise
    the previous state; starts OFF. The state is the last decisive value,
    carried forward per key (split by bucket)."""
    decisive = F.when(metric >= F.lit(on_at), F.lit(True)).when(metric <= F.lit(off_at), F.lit(False))
    c = carry_last(df, keys, order_cols, decisive, bucket, out, include_current=True)
    return c.withColumn(out, F.coalesce(F.col(out), F.lit(False)))


def interleave_slot(rank: Column, first: bool, w: int, v: int) -> Column:
    """The position of the rank-th (1-based) item of list A (``first``)
    or B in a w:v weighted interleave; ordering by slot drains A w at a time,
    then B v at a time, and falls back to the other list when one is empty."""
    r = rank - F.lit(1)
    if first:
        return (F.floor(r / F.lit(w)) * F.lit(w + v) + r % F.lit(w)).cast("bigint")
    return (F.floor(r / F.lit(v)) * F.lit(w + v) + F.lit(w) + r % F.lit(v)).cast("bigint")
