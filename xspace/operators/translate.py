"""Word-translation retrieval and its evaluation against a gold dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import hashing, session
from . import pairs, ranking
from .lookup import resolve_pairs
from .normalize import normalize

METHODS = ("nn", "invnn", "invsoftmax", "csls")
# Sources listed per target before inverted ranks are counted; any length is exact.
LISTED = 16


# SQL condition: both words of a resolved pair are in their vocabulary.
KNOWN = "src_idx IS NOT NULL AND trg_idx IS NOT NULL"


def gold_dictionary(raw: DataFrame, src: DataFrame, trg: DataFrame):
    """(gold, coverage): distinct known id pairs, and one row of coverage counts.

    A source word is covered if any of its lines is in both vocabularies;
    coverage is covered / (covered + never covered words).
    """
    # resolved pairs are distinct, and both results read them
    found = session.cut_lineage(resolve_pairs(raw, src, trg))
    gold = found.where(KNOWN).select("src_idx", "trg_idx")
    words = found.groupBy("src").agg(F.expr(f"bool_or({KNOWN})").alias("known"))
    coverage = words.agg(
        F.expr("count_if(known)").alias("covered"),
        F.expr("count_if(NOT known)").alias("oov"),
        F.expr("try_divide(count_if(known), count(*))").alias("coverage"),
    )
    return gold, coverage


def oov_words(raw: DataFrame, src: DataFrame, trg: DataFrame) -> DataFrame:
    """Source words of the dictionary that no line covers."""
    found = resolve_pairs(raw, src, trg)
    covered = found.where(KNOWN).select("src")
    missing = found.where(f"NOT ({KNOWN})").select("src").distinct()
    return missing.join(covered, "src", "left_anti")


def comparable(emb: DataFrame, dot: bool = False) -> DataFrame:
    """Unit-length vectors, so that dot products are cosines, unless ``dot``."""
    return emb if dot else normalize(emb, ["unit"])


def inverse_sample(src: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """Source rows drawn ``size`` times with replacement, with their draw counts."""
    spark = src.sparkSession
    rows = src.count()
    draw = hashing.uniform_column("id", hashing.stream_key(seed))
    picks = (
        spark.range(size)
        .select(F.floor(draw * rows).cast("bigint").alias("idx"))
        .groupBy("idx")
        .agg(F.count("*").cast("double").alias("extra"))
    )
    return src.join(picks, "idx")


def translate(
    src: DataFrame,
    trg: DataFrame,
    queries: DataFrame,
    method: str = "nn",
    inv_temperature: float = 1.0,
    inv_sample: int | None = None,
    neighborhood: int = 10,
    seed: int = 0,
) -> DataFrame:
    """(src_idx, trg_idx, score): retrieved target of every source id in ``queries``.

    All methods but ``invnn`` are one scorer, alpha * sim - penalty(target):
    plain (1, 0), CSLS (2, neighbourhood mean), inverted softmax (beta, log Z).
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    wanted = queries.select(F.col("src_idx").alias("idx")).distinct()
    asked = session.cut_lineage(src.select("idx", "vec").join(wanted, "idx", "left_semi"))
    if method == "invnn":
        return _inverted(src, trg, asked)
    n_asked, n_src, n_trg = pairs.measure(asked, src, trg)
    alpha, penalised = 1.0, trg
    if method == "csls":
        near = pairs.topk_mean(src, trg, neighborhood, "right", (n_src, n_trg))
        alpha, penalised = 2.0, _penalised(trg, near)
    elif method == "invsoftmax":
        sources = src if inv_sample is None else inverse_sample(src, inv_sample, seed)
        total = pairs.log_partition(
            sources, trg, inv_temperature, inv_sample is not None, (n_src, n_trg)
        )
        alpha, penalised = inv_temperature, _penalised(trg, total)
    best = pairs.top_neighbours(
        asked, penalised, 1, alpha, method != "nn", sizes=(n_asked, n_trg)
    )
    return best.select(
        F.col("idx").alias("src_idx"), F.col("nbr").alias("trg_idx"), "score"
    )


def _penalised(trg: DataFrame, values: DataFrame) -> DataFrame:
    return trg.select("idx", "vec").join(
        values.select("idx", F.col("value").alias("extra")), "idx"
    )


def _inverted(src: DataFrame, trg: DataFrame, asked: DataFrame) -> DataFrame:
    """For each query the target that ranks it best among all sources.

    Equal ranks go to the higher similarity, then to the lower target id. The sources
    nearest to each target bound the ranks: a query's rank is exact at the targets
    that list it, and at least the length of a list at all others, so a query on any
    list is settled there. Only queries on no list are counted against all sources.
    """
    n_src, n_trg = pairs.measure(src, trg)
    listed = pairs.top_neighbours(trg, src, LISTED, sizes=(n_trg, n_src))
    wanted = asked.select(F.col("idx").alias("nbr"))
    order = F.expr("min(struct(rank, -sim AS neg, trg_idx))")
    ranks = listed.join(wanted, "nbr", "left_semi").selectExpr(
        "nbr AS src_idx", "idx AS trg_idx", "rank - 1L AS rank", "score AS sim"
    )
    near = ranks.groupBy("src_idx").agg(order.alias("best"))
    if n_src.rows > LISTED:
        near = session.cut_lineage(near)
        rest = session.cut_lineage(
            asked.join(near.select(F.col("src_idx").alias("idx")), "idx", "left_anti")
        )
        if rest.head() is not None:
            cells = ranking.rank_cells(rest, trg, src)
            counted = cells.mapInArrow(ranking.best_ranks, ranking.RANK_SCHEMA)
            near = near.unionAll(counted.groupBy("src_idx").agg(order.alias("best")))
    return near.selectExpr("src_idx", "best.trg_idx AS trg_idx", "double(best.rank) AS score")


def translation_hits(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(src_idx, trg_idx, correct): is the prediction one of the gold targets."""
    right = gold.select("src_idx", "trg_idx").distinct().withColumn("_hit", F.lit(True))
    return predicted.join(right, ["src_idx", "trg_idx"], "left").select(
        "src_idx", "trg_idx", F.coalesce("_hit", F.lit(False)).alias("correct")
    )


def translation_accuracy(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """One row (queries, correct, accuracy); accuracy is NULL without queries."""
    return translation_hits(predicted, gold).agg(
        F.count("*").alias("queries"),
        F.expr("count_if(correct)").alias("correct"),
        F.expr("try_divide(count_if(correct), count(*))").alias("accuracy"),
    )
