"""Order-dependent operators that stay safe when one key owns most rows.

``row_number() <= n`` filters are rank-limited before the shuffle (Catalyst's
WindowGroupLimit), so a hot key sends at most n rows per map task. Running values
over a whole key are two-level: inside bounded slices of the order axis first, then
over one row per slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ranked


def _order(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int, rank: str | None = None) -> DataFrame:
    """The first n rows of every group in the given order."""
    w = Window.partitionBy(*keys).orderBy(*_order(order))
    out = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return out.withColumnRenamed("_rn", rank) if rank else out.drop("_rn")


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of every group: first occurrence wins."""
    return top_n(df, keys, order, 1)


def latest_version(df: DataFrame, keys: Sequence[str], newest_first: Sequence[str | Column]) -> DataFrame:
    return top_n(df, keys, newest_first, 1)


def retain_last(df: DataFrame, keys: Sequence[str], newest_first: Sequence[str | Column], n: int, row_id: str) -> DataFrame:
    """Every row with ``retained``: true for the newest n of its group.

    The kept ids come from a rank-limited window; the rest is found by a join on the
    row id, so no group is ever sorted whole.
    """
    kept = top_n(df, keys, newest_first, n).select(row_id, F.lit(True).alias("retained"))
    return df.join(kept, row_id, "left").withColumn("retained", F.coalesce("retained", F.lit(False)))


def running_sum(
    df: DataFrame, keys: Sequence[str], slice_col: str, order: Sequence[str | Column], value: str, out: str
) -> DataFrame:
    """Cumulative sum of ``value`` inside each key, in order.

    ``slice_col`` must not decrease along the order; it bounds how many rows of one
    key meet in one task. Slice totals are pre-aggregated map-side, their prefix sums
    run over one row per slice, and the offsets come back by an equi-join.
    """
    part = [*keys, slice_col]
    local = F.sum(value).over(Window.partitionBy(*part).orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, 0))
    totals = df.groupBy(*part).agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*part, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))
    return df.withColumn("_local", local).join(offsets, part).withColumn(out, F.col("_local") + F.col("_before")).drop("_local", "_before")


def following(df: DataFrame, keys: Sequence[str], slice_col: str, order: Sequence[str | Column], value: str, out: str) -> DataFrame:
    """``value`` of the next row of the key, which must not be null in any row; null after the last.

    Inside a slice it is a lead; the last row of a slice takes the first one of the key's next slice.
    """
    part = [*keys, slice_col]
    here = F.lead(value).over(Window.partitionBy(*part).orderBy(*_order(order)))
    first = df.groupBy(*part).agg(F.min_by(value, F.struct(*_order(order))).alias("_first"))
    after = first.select(*part, F.lead("_first").over(Window.partitionBy(*keys).orderBy(slice_col)).alias("_after")).where("_after IS NOT NULL")
    return df.withColumn("_here", here).join(after, part, "left").withColumn(out, F.coalesce("_here", "_after")).drop("_here", "_after")


def carry_last(
    df: DataFrame, keys: Sequence[str], slice_col: str, order: Sequence[str | Column], value: str, out: str
) -> DataFrame:
    """Last non-null ``value`` at or before each row (backward as-of on one table)."""
    part = [*keys, slice_col]
    here = Window.partitionBy(*part).orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, 0)
    last = df.where(F.col(value).isNotNull()).groupBy(*part).agg(F.max_by(value, F.struct(*_order(order))).alias("_v"))
    slices = df.select(*part).distinct().join(last, part, "left")
    before = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select(*part, F.last("_v", ignorenulls=True).over(before).alias("_carry"))
    return (
        df.withColumn("_here", F.last(value, ignorenulls=True).over(here))
        .join(carried, part, "left")
        .withColumn(out, F.coalesce("_here", "_carry"))
        .drop("_here", "_carry")
    )


def batch_items(df: DataFrame, order: Sequence[str | Column], size: int) -> DataFrame:
    """``batch_no`` from 1: consecutive rows in order, ``size`` per batch."""
    return ranked(df, [], order).withColumn("batch_no", F.floor(F.col("rank") / size).cast("bigint") + 1).drop("rank")


def limit_totals(df: DataFrame, order: Sequence[str | Column], size: str, max_files: int = 0, max_bytes: int | Column = 0) -> DataFrame:
    """Rows in order while the file and byte totals stay in bounds; 0 means no bound."""
    out = ranked(df, [], order, size)
    if isinstance(max_bytes, Column) or max_bytes:
        out = out.where(F.col("before") + F.col(size) <= max_bytes)
    if max_files:
        out = out.where(F.col("rank") < max_files)
    return out.drop("rank", "before")


def dup_flag(df: DataFrame, text: str, order: str, row_id: str, min_len: int = 50) -> DataFrame:
    """``verdict`` per text: too short, seen earlier in order, or kept; ``row_id`` (unique) settles ties.

    Only (digest, order, id) are grouped; the first of each digest is a partial minimum, so a text copied a
    billion times costs one value per task.
    """
    from ..functions.text import strip

    t = strip(F.col(text))
    d = df.withColumn("_t", t).withColumn("_d", F.sha2("_t", 256)).withColumn("_short", F.length("_t") <= min_len).drop("_t")
    firsts = d.where(~F.col("_short")).groupBy("_d").agg(F.min(F.struct(order, row_id)).alias("_first"))
    firsts = firsts.select(F.col(f"_first.{row_id}").alias(row_id), F.lit(True).alias("_is_first"))
    return (
        d.join(firsts, row_id, "left")
        .withColumn(
            "verdict",
            F.when(F.col("_short"), "Bad docstring")
            .when(F.col("_is_first"), "keep")
            .otherwise("Duplicate docstring — skipped"),
        )
        .drop("_d", "_short", "_is_first")
    )


def phase_durations(events: DataFrame, order: Sequence[str] = ("seq",), width: str = "hour") -> DataFrame:
    """One row per begin of a phase: its end, duration in ms and status; without an end it is open.

    Input: run_id, phase, event (begin/end), status, ts and the ``order`` of events with one ts; a ``step``
    column, if there, is part of the key. An end closes the latest open begin of its key. With begins counted
    up and ends down, begins and ends between two levels of that count alternate, so a begin's end is the next
    row of its level. The count and the next row are two-level over slices of time, so no key is sorted in one
    task; both work on one exchange of the events by key and slice.
    """
    keys = ["run_id", "phase", *(["step"] if "step" in events.columns else [])]
    at = ["ts", *order]
    begins = F.col("event") == "begin"
    e = events.where(F.col("event").isin("begin", "end")).withColumn("_s", F.date_trunc(width, "ts"))
    e = running_sum(e.withColumn("_up", F.when(begins, 1).otherwise(-1).cast("bigint")), keys, "_s", at, "_up", "_level")
    e = e.withColumn("_level", F.when(begins, F.col("_level") - 1).otherwise(F.col("_level")))
    e = e.withColumn("_row", F.struct(F.col("event"), F.col("ts"), F.col("status")))
    e = following(e, [*keys, "_level"], "_s", at, "_row", "_next").where(begins)
    closed = F.col("_next.event") == "end"
    j = e.select(*keys, F.col("ts").alias("begin_ts"), F.when(closed, F.col("_next.ts")).alias("end_ts"), F.when(closed, F.col("_next.status")).alias("_end"))
    us = F.unix_micros(F.col("end_ts").cast("timestamp")) - F.unix_micros(F.col("begin_ts").cast("timestamp"))
    status = F.when(F.col("end_ts").isNull(), "open").when(F.col("_end") == "error", "error").otherwise("ok")
    return j.select(*keys, "begin_ts", "end_ts", F.floor(us / 1000).cast("bigint").alias("dur_ms"), status.alias("status"))
