"""Join helpers: broadcast only behind a proven size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirpflow.session import local_frame

# Largest side (rows) broadcast by ``small_side_join``; beyond it the join shuffles.
BROADCAST_MAX_ROWS = 2_000_000


def small_side_join(big: DataFrame, small: DataFrame, on, how: str = "inner",
                    max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Join ``big`` with ``small``, broadcasting ``small`` only when it is proven small.

    The bound is an exact row count of ``small`` (one cheap job); above it the
    join is left to the planner (sort-merge / shuffled hash, AQE may still
    switch to a broadcast when runtime statistics allow).
    """
    n = small.count()
    side = F.broadcast(small) if n <= max_rows else small
    return big.join(side, on, how)


# A left-side key with at least this many rows is treated as hot.
HOT_KEY_ROWS = 1_000_000
MAX_HOT_KEYS = 10_000


def split_hot_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[tuple[str, str]],
    how: str = "inner",
    hot_rows: int | None = None,
) -> DataFrame:
    """Join ``left`` to a ``right`` side that has at most one row per key, with hot keys split off.

    ``keys`` pairs (left column, right column). Keys holding at least
    ``hot_rows`` left rows (one thread root may collect a third of all
    replies) are found with a partially aggregated count; their rows join a
    broadcast of just the matching right rows (at most one per hot key, so the
    broadcast is bounded by MAX_HOT_KEYS: of more keys the hottest are split
    off), map-side and without shuffling the hot rows. Every other row takes the
    normal shuffle join, where AQE divides what is still skewed. ``how`` is
    'inner' or 'left'. Result columns: left columns then right columns.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    hot_rows = hot_rows or HOT_KEY_ROWS
    lk, rk = [a for a, _ in keys], [b for _, b in keys]
    cond = None
    for a, b in keys:
        c = left[a] == right[b]
        cond = c if cond is None else cond & c
    hot = (
        left.groupBy(*lk).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= hot_rows)
        .orderBy(F.desc("_rows"), *lk).limit(MAX_HOT_KEYS).drop("_rows").collect()
    )
    if not hot:
        return left.join(right, cond, how)
    spark = left.sparkSession
    hot_df = local_frame(spark, hot, left.select(*lk).schema)
    # semi / anti joins on key names put the keys first: restore the column order
    hot_right = right.join(F.broadcast(hot_df.toDF(*rk)), rk, "left_semi").select(*right.columns)
    is_hot = left.join(F.broadcast(hot_df), lk, "left_semi").select(*left.columns)
    cold = left.join(F.broadcast(hot_df), lk, "left_anti").select(*left.columns)
    # rebuild the condition on the filtered frames
    def on(lf, rf):
        c = None
        for a, b in keys:
            e = lf[a] == rf[b]
            c = e if c is None else c & e
        return c

    hot_part = is_hot.join(F.broadcast(hot_right), on(is_hot, hot_right), how)
    cold_part = cold.join(right, on(cold, right), how)
    return hot_part.unionByName(cold_part)
