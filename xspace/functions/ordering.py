"""Dense positions and average ranks without a single-task sort.

Every helper works in two levels: positions inside bounded buckets, plus a prefix
sum over one small row per bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .session import cut_lineage

BUCKET_ROWS = 1 << 16


def _bucket_offsets(counts: DataFrame, order: list[str]) -> DataFrame:
    # one row per bucket: the only window that sees them all
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))


def redensify(df: DataFrame, idx: str = "idx") -> DataFrame:
    """Renumber ``idx`` to 0..m-1 keeping its order (``idx`` values are unique)."""
    bucketed = df.withColumn("_bucket", F.floor(F.col(idx) / BUCKET_ROWS))
    offsets = _bucket_offsets(
        bucketed.groupBy("_bucket").agg(F.count("*").alias("n")), ["_bucket"]
    ).select("_bucket", "offset")
    inside = Window.partitionBy("_bucket").orderBy(idx)
    return (
        bucketed.withColumn("_pos", F.row_number().over(inside) - 1)
        .join(offsets, "_bucket")
        .withColumn(idx, (F.col("offset") + F.col("_pos")).cast("bigint"))
        .drop("_bucket", "_pos", "offset")
    )


def carry_forward(df: DataFrame, line_no: str, value: str, out: str) -> DataFrame:
    """Last non-null ``value`` at or before each ``line_no``, written to ``out``."""
    bucketed = df.withColumn("_bucket", F.floor(F.col(line_no) / BUCKET_ROWS))
    inside = (
        Window.partitionBy("_bucket")
        .orderBy(line_no)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        bucketed.groupBy("_bucket")
        .agg(
            F.max_by(value, F.when(F.col(value).isNotNull(), F.col(line_no))).alias(
                "_last"
            )
        )
        .withColumn("_carry", F.last("_last", ignorenulls=True).over(earlier))
        .select("_bucket", "_carry")
    )
    return (
        bucketed.withColumn("_here", F.last(value, ignorenulls=True).over(inside))
        .join(carried, "_bucket")
        .withColumn(out, F.coalesce("_here", "_carry"))
        .drop("_bucket", "_here", "_carry")
    )


def average_ranks(df: DataFrame, groups: list[str], value: str, out: str) -> DataFrame:
    """Rank of each distinct ``value`` in its group, ties sharing the mean rank.

    Returns (*groups, value, out). Copies are counted before any shuffle of rows and
    the sorted order is range-partitioned, so one huge group spans many tasks.
    """
    distinct = (
        df.groupBy(*groups, value)
        .agg(F.count("*").alias("n"))
        .repartitionByRange(*groups, value)
        .withColumn("_part", F.spark_partition_id())
    )
    # the partition number is part of the result, so it must not be recomputed
    distinct = cut_lineage(distinct)
    parts = distinct.groupBy(*groups, "_part").agg(F.sum("n").alias("n"))
    before = (
        Window.partitionBy(*groups)
        .orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = parts.select(
        *groups, "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset")
    )
    inside = (
        Window.partitionBy(*groups, "_part")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    last = F.col("_offset") + F.sum("n").over(inside)
    return distinct.join(offsets, [*groups, "_part"]).select(
        *groups, value, (last - (F.col("n") - 1) / 2.0).alias(out)
    )
