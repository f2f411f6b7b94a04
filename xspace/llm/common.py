"""Helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import session

SPACES = r"[\x20\x09-\x0D]+"
# ``spark.xspace.broadcastBytes`` is for vectors of numbers; joins of small rows use
# at most this much of it, as a hash table takes several times its rows.
JOIN_BYTES = 24 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: no lineage, known size."""
    return session.cut_lineage(df)


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def small_side(settled: DataFrame, row_bytes: int) -> DataFrame:
    """Mark a settled table for broadcast if its counted rows are small.

    Beyond the limit the join shuffles both sides and gives the same rows.
    """
    limit = min(JOIN_BYTES, session.broadcast_limit(settled.sparkSession))
    return F.broadcast(settled) if settled.count() * row_bytes <= limit else settled


def join_spread(facts: DataFrame, table: DataFrame, on: list[str], count: str) -> DataFrame:
    """Join of ``facts`` to a settled ``table``, unique in ``on``, with frequent keys over several tasks.

    ``count`` names the table's column of the facts of a key. A key with a share s of them
    is split into ceil(s * P) parts, P being the shuffle partitions. Fewer than P keys
    have over 1/P of the facts, so the list of split keys is short whatever the data.
    """
    parts = session.shuffle_partitions(table.sparkSession)
    total = table.agg(F.coalesce(F.sum(count), F.lit(0))).head()[0]
    often = table.where(F.col(count) * parts > total)
    ways = F.ceil(F.col(count) * parts / max(1, total)).cast("int")
    often = F.broadcast(often.select(*on, ways.alias("_ways")))
    split = F.coalesce("_ways", F.lit(1))
    spread = facts.join(often, on, "left").withColumn("_part", F.pmod(F.xxhash64(*facts.columns), split).cast("int"))
    copied = table.join(often, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), split - 1)))
    return spread.drop("_ways").join(copied.drop("_ways", count), [*on, "_part"]).drop("_part")


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is not among ``ids`` (id); null ids stay."""
    gone = small_side(settle(ids.select(F.col("id").alias("_gone"))), 64)
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")


def learnable(id_col: str = "doc_id") -> Column:
    """False for the third of the rows held out for tests: crc32 of the id mod 3 is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1, F.lit(True))
