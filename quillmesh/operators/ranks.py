"""Ranks and running sums over groups of any size, the whole table included."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder


def stored(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back: one evaluation that outlives executors."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], value: str | None = None) -> DataFrame:
    """Add ``rank`` (from 0, gapless in each group, by ``order``) and, for a ``value`` column, ``before``:
    the sum of the values ranked earlier in the group.

    Rows are dealt by range of the order, so that a group of any size spreads over all tasks; ranks inside
    a range are shifted by the totals of the earlier ranges, of which a group has one row per range. The
    ranges are stored first: their bounds come from a sample and must not be drawn twice. Rows that agree
    in the whole order rank in any order. Pass narrow rows; nulls sort first and form groups of their own.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    earlier = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy(*group, "_range").orderBy(*order)
    ranges = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*group, "_range").agg(F.count("*").alias("_n"), F.sum(F.lit(0) if value is None else value).alias("_v"))
    base = totals.select(
        *(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)),
        F.col("_range").alias("_r"),
        F.coalesce(F.sum("_n").over(ranges), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_v").over(ranges), F.lit(0)).alias("_v0"),
    )
    local = dealt.withColumn("_rank", F.row_number().over(here) - 1)
    if value is not None:
        local = local.withColumn("_sum", F.coalesce(F.sum(value).over(earlier), F.lit(0)))
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = local.join(base, same).withColumn("rank", F.col("_rank") + F.col("_n0"))
    if value is not None:
        out = out.withColumn("before", F.col("_sum") + F.col("_v0"))
    return out.select(*df.columns, "rank", *(["before"] if value is not None else []))
