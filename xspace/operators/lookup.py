"""Joins from many rows to a table with unique keys, safe for very frequent keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import session

# Below this many rows a single task can take them all, however they repeat.
FEW_ROWS = 200_000


def word_index(emb: DataFrame) -> DataFrame:
    """(word, idx) with one row per word; the last duplicate wins."""
    return emb.groupBy("word").agg(F.max("idx").alias("idx"))


def lookup(
    facts: DataFrame,
    table: DataFrame,
    on: str,
    how: str = "inner",
    rows: int | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Join ``facts`` to ``table`` (unique in ``on``) with frequent keys spread out.

    A key holding a share s of the facts is split over ceil(s * P) salts, P being
    the shuffle partitions, and the table's row is copied to each. Fewer than P keys
    exceed a 1/P share, so the list of split keys can be broadcast whatever the
    data. ``facts`` rows should be distinct.

    ``rows`` is a known bound on the facts: a few need no salts. ``counted`` names
    rows with the same key frequencies that are cheaper to count than ``facts``.
    """
    if rows is not None and rows <= FEW_ROWS:
        return facts.join(table, on, how)
    counted = facts if counted is None else counted
    parts = session.shuffle_partitions(facts.sparkSession)
    total = counted.agg(F.count("*")).scalar()
    frequent = (
        counted.groupBy(on)
        .agg(F.count("*").alias("_n"))
        .select(on, F.ceil(F.col("_n") * parts / total).cast("int").alias("_ways"))
        .where(F.col("_ways") > 1)
    )
    ways = F.coalesce("_ways", F.lit(1))
    spread = facts.join(F.broadcast(frequent), on, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*facts.columns), ways).cast("int")
    )
    copied = table.join(F.broadcast(frequent), on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), ways - 1))
    )
    return (
        spread.drop("_ways")
        .join(copied.drop("_ways"), [on, "_salt"], how)
        .drop("_salt")
    )


def resolve_pairs(raw: DataFrame, src: DataFrame, trg: DataFrame) -> DataFrame:
    """Word pairs (src, trg) with their ids; NULL where a word is not in the table.

    Copies of a pair are counted into ``w`` before anything is shuffled by word.
    """
    rows = raw.count()
    pairs = raw.groupBy("src", "trg").agg(F.count("*").alias("w"))
    src_words = word_index(src).select(
        F.col("word").alias("src"), F.col("idx").alias("src_idx")
    )
    trg_words = word_index(trg).select(
        F.col("word").alias("trg"), F.col("idx").alias("trg_idx")
    )
    found = lookup(pairs, src_words, "src", "left", rows)
    return lookup(found, trg_words, "trg", "left", rows, counted=pairs)
