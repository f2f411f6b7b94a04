"""Exact duplicates by a tree merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import session
from .common import settle

KEY = ["cell", "digest", "size"]


def _better(keep: str, id_: Column, row: Column):
    """Aggregate and order of candidates: null ids lose, the first row wins ties."""
    if keep == "smallest":
        return F.min, F.struct(id_.isNull().alias("absent"), id_.alias("id"), row.alias("row"))
    if keep == "largest":
        return F.max, F.struct(id_.isNotNull().alias("present"), id_.alias("id"), (-row).alias("row"))
    raise ValueError("keep must be smallest or largest")


def tree_merge(rows: DataFrame, better, cells: int, fan_bits: int) -> DataFrame:
    """(cell, digest, size, best, n) for each run of ``rows`` that holds a digest met twice.

    ``rows`` has cell (its run), digest, size, slot (the cell a digest ends in) and
    best. In each round the runs that differ in the next ``fan_bits`` bits of their
    number exchange: each gets the digests whose slot has its bits, sorted, and merges
    them. Runs stay even, since a digest reaches its last cell only after every copy
    of it on the way has been merged into one. The verdict then goes back down the
    same tree, one row per digest and run at a time.
    """
    bits = cells.bit_length() - 1

    def merged(level: DataFrame, n: Column) -> DataFrame:
        return level.groupBy(*KEY, "slot").agg(better("best").alias("best"), n.alias("n"))

    levels = [settle(merged(rows, F.count(F.lit(1))))]
    masks = []
    for low in range(0, bits, fan_bits):
        mask = ((1 << min(fan_bits, bits - low)) - 1) << low
        masks.append(mask)
        moved = levels[-1].withColumn("cell", _parent(mask))
        runs = moved.repartitionById(cells, F.col("cell")).sortWithinPartitions(*KEY)
        levels.append(settle(merged(runs, F.sum("n"))))

    # digests met once need no verdict
    found = levels.pop().where("n > 1").select(*KEY, "best", "n")
    for mask in reversed(masks):
        above = found.withColumnRenamed("cell", "parent")
        below = levels.pop().select(*KEY, _parent(mask).alias("parent"))
        found = settle(below.join(above, ["parent", "digest", "size"]).select(*KEY, "best", "n"))
    return found


def _parent(mask: int) -> Column:
    return F.expr(f"int((cell & {~mask}) | (slot & {mask}))")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise=None,
    fan_bits: int = 3,
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    Texts are equal when their normalised forms (default: unchanged) have the same
    SHA-256 and length. Null text counts as empty. Of rows with equal texts and equal
    ids one is kept; a null id is kept only if all ids of its group are null. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    cells = 1 << max(1, (session.shuffle_partitions(spark) - 1).bit_length())
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = text if normalise is None else normalise(text)
    rows = settle(
        docs.select(F.col(id_col).alias("id"), text.alias("text")).select(
            "id",
            F.monotonically_increasing_id().alias("row"),
            (F.spark_partition_id() % cells).alias("cell"),
            F.unhex(F.sha2("text", 256)).alias("digest"),
            F.octet_length("text").alias("size"),
        )
    )
    better, best = _better(keep, F.col("id"), F.col("row"))
    slot = F.pmod(F.xxhash64("digest"), F.lit(cells)).cast("int")
    runs = rows.select(*KEY, slot.alias("slot"), best.alias("best"))
    found = tree_merge(runs, better, cells, fan_bits).select(*KEY, "best", "n")
    mine = rows.withColumn("own", best)
    return mine.join(found, KEY, "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("best") == F.col("own"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
