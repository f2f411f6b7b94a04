"""Word similarity / relatedness: cosines of word pairs against gold scores."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from ..functions import ordering, vectors
from .lookup import lookup


def _word_vectors(emb: DataFrame, word: str, vec: str) -> DataFrame:
    # the last row of a duplicated word is the one looked up
    latest = emb.groupBy("word").agg(F.max_by("vec", "idx").alias("vec"))
    return latest.select(F.col("word").alias(word), vectors.unit("vec").alias(vec))


def pair_scores(
    pairs: DataFrame, src: DataFrame, trg: DataFrame | None = None
) -> DataFrame:
    """``pairs`` (dataset, line_no, w1, w2, gold) with ``cos``; NULL if a word is OOV.

    Without ``trg`` both words are looked up in ``src``. Only words occurring in the
    datasets keep their vectors: the tables are reduced by a semi join first.
    """
    trg = src if trg is None else trg
    w1, w2 = pairs.select("w1").distinct(), pairs.select("w2").distinct()
    left = src.join(w1, F.col("word") == F.col("w1"), "left_semi")
    right = trg.join(w2, F.col("word") == F.col("w2"), "left_semi")
    found = lookup(pairs, _word_vectors(left, "w1", "v1"), "w1", "left")
    found = lookup(found, _word_vectors(right, "w2", "v2"), "w2", "left", counted=pairs)
    both = F.col("v1").isNotNull() & F.col("v2").isNotNull()
    cos = F.when(both, vectors.dot("v1", "v2"))
    return found.select("dataset", "line_no", "w1", "w2", "gold", cos.alias("cos"))


def system_scores(scored: DataFrame, backoff: float | None = None) -> DataFrame:
    """Adds ``system``: the cosine, or the back-off score for OOV pairs, or NULL."""
    fallback = F.lit(backoff).cast("double")
    return scored.withColumn("system", F.coalesce("cos", fallback))


def coverage(scored: DataFrame) -> DataFrame:
    """(dataset, scored, oov, coverage) of the ``system`` column."""
    hit, miss = F.count("system"), F.count_if(F.col("system").isNull())
    return scored.groupBy("dataset").agg(
        hit.alias("scored"),
        miss.alias("oov"),
        F.try_divide(hit, hit + miss).alias("coverage"),
    )


def pearson(scored: DataFrame) -> DataFrame:
    """(dataset, pearson) over the pairs that have a system score."""
    usable = scored.where(F.col("system").isNotNull())
    return usable.groupBy("dataset").agg(F.corr("gold", "system").alias("pearson"))


def spearman(scored: DataFrame) -> DataFrame:
    """(dataset, spearman): correlation of average ranks."""
    usable = scored.where("system IS NOT NULL")
    # equal (gold, system) pairs collapse before the ranks are joined back
    counted = usable.groupBy("dataset", "gold", "system").agg(F.count("*").alias("n"))
    both = usable.selectExpr(
        "dataset",
        "inline(array(named_struct('kind', 'gold', 'value', gold), "
        "named_struct('kind', 'system', 'value', system)))",
    )
    ranks = ordering.average_ranks(both, ["dataset", "kind"], "value", "rank")
    ranked = counted
    for kind, short in (("gold", "g"), ("system", "s")):
        own = ranks.where(F.col("kind") == kind).selectExpr(
            "dataset", f"value AS {kind}", f"rank AS {short}"
        )
        ranked = ranked.join(own, ["dataset", kind])
    means = counted.groupBy("dataset").agg(F.expr("(sum(n) + 1) / 2D").alias("mean"))
    centred = ranked.join(means, "dataset").selectExpr(
        "dataset", "n", "g - mean AS x", "s - mean AS y"
    )
    spread = "sqrt(sum(n * x * x)) * sqrt(sum(n * y * y))"
    return centred.groupBy("dataset").agg(
        F.expr(f"try_divide(sum(n * x * y), {spread})").alias("spearman")
    )


def correlations(scored: DataFrame) -> DataFrame:
    """(dataset, scored, oov, coverage, pearson, spearman)."""
    return (
        coverage(scored)
        .join(pearson(scored), "dataset", "left")
        .join(spearman(scored), "dataset", "left")
    )


def summarise(
    results: DataFrame,
    sim: Iterable[str] | None = None,
    rel: Iterable[str] | None = None,
    all_: Iterable[str] | None = None,
) -> DataFrame:
    """(name, coverage, pearson, spearman): unweighted means over named datasets.

    Rows ``sim`` and ``rel`` appear if asked for and not empty; ``all`` covers every
    dataset by default. Nothing is returned for a single dataset.
    """
    groups = [("sim", sim), ("rel", rel), ("all", all_)]
    parts = []
    for name, wanted in groups:
        if wanted is None and name != "all":
            continue
        chosen = results
        if wanted is not None:
            chosen = results.where(F.col("dataset").isin(list(wanted)))
        parts.append(chosen.withColumn("name", F.lit(name)))
    together = parts[0]
    for part in parts[1:]:
        together = together.unionAll(part)
    several = results.agg(F.count("*") > 1).scalar()
    return (
        together.where(several)
        .groupBy("name")
        .agg(
            F.avg("coverage").alias("coverage"),
            F.avg("pearson").alias("pearson"),
            F.avg("spearman").alias("spearman"),
        )
    )
