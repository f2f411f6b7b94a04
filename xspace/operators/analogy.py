"""Word analogies: a is to b as c is to d."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import session
from . import pairs
from .lookup import lookup, word_index

# Fixed value: categories whose name starts so are syntactic.
SYNTACTIC_PREFIX = "gram"
# Fixed value: the score a question's own words get as answers.
EXCLUDED_SCORE = -1.0


def is_syntactic(category) -> Column:
    return F.startswith(category, F.lit(SYNTACTIC_PREFIX))


def lowercase_questions(questions: DataFrame) -> DataFrame:
    """Lower-case the question words; category names stay as they are."""
    return questions.withColumns({c: F.lower(c) for c in "abcd"})


def resolve_questions(questions: DataFrame, emb: DataFrame) -> DataFrame:
    """Adds a_idx .. d_idx and ``known``; one missing word makes a question OOV."""
    words = questions.select(
        "line_no",
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("slot"), F.col(c).alias("word")) for c in "abcd"])
        ).alias("w"),
    ).select("line_no", "w.slot", "w.word")
    found = lookup(words, word_index(emb), "word")
    slots = found.groupBy("line_no").agg(
        F.count("*").alias("n"),
        *[
            F.max(F.when(F.col("slot") == c, F.col("idx"))).alias(f"{c}_idx")
            for c in "abcd"
        ],
    )
    joined = questions.join(slots, "line_no", "left")
    return joined.withColumn("known", F.coalesce(F.col("n") == 4, F.lit(False))).drop("n")


def question_vectors(resolved: DataFrame, emb: DataFrame) -> DataFrame:
    """(idx, vec): c - a + b of each answerable question, not renormalised."""
    terms = (
        resolved.where("known")
        .select(
            "line_no",
            F.explode(
                F.array(
                    F.struct(F.col("c_idx").alias("word_idx"), F.lit(1.0).alias("sign")),
                    F.struct(F.col("a_idx").alias("word_idx"), F.lit(-1.0).alias("sign")),
                    F.struct(F.col("b_idx").alias("word_idx"), F.lit(1.0).alias("sign")),
                )
            ).alias("t"),
        )
        .select("line_no", "t.word_idx", "t.sign")
    )
    # one row per (question, word), so that copies of a term cannot pile up
    terms = terms.groupBy("line_no", "word_idx").agg(F.sum("sign").alias("sign"))
    table = emb.select(F.col("idx").alias("word_idx"), "vec")
    scaled = lookup(terms, table, "word_idx").select(
        "line_no", "word_idx", F.transform("vec", lambda x: x * F.col("sign")).alias("vec")
    )
    # at most three vectors per question, added in the order of their words' ids
    vs = F.transform(F.array_sort("vs"), lambda v: v["vec"])
    first = F.slice("vs", 2, 3)
    total = F.aggregate(
        first,
        F.element_at("vs", 1),
        lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y),
    )
    return (
        scaled.groupBy("line_no")
        .agg(F.collect_list(F.struct("word_idx", "vec")).alias("vs"))
        .select("line_no", vs.alias("vs"))
        .select(F.col("line_no").alias("idx"), total.alias("vec"))
    )


def solve_analogies(resolved: DataFrame, emb: DataFrame) -> DataFrame:
    """``resolved`` with ``answer``, the best word id for each answerable question.

    ``emb`` has unit vectors. A question's own words score -1: three of the four
    best candidates can be its own words, so the fourth always competes.
    """
    # several steps read the question vectors: measured, then scanned or shipped
    asked = session.cut_lineage(question_vectors(resolved, emb))
    top = pairs.top_neighbours(asked, emb, k=4)
    candidates = top.select(F.col("idx").alias("line_no"), "nbr", "score").join(
        resolved.select("line_no", "a_idx", "b_idx", "c_idx"), "line_no"
    )
    own = F.array_contains(F.array("a_idx", "b_idx", "c_idx"), F.col("nbr"))
    best = candidates.groupBy("line_no").agg(
        F.max(
            F.when(~own, F.struct("score", (-F.col("nbr")).alias("neg")))
        ).alias("top")
    )
    lowest_own = F.least("a_idx", "b_idx", "c_idx")
    other, score = -F.col("top.neg"), F.col("top.score")
    answer = (
        F.when(F.col("top").isNull() | (score < EXCLUDED_SCORE), lowest_own)
        .when(score == EXCLUDED_SCORE, F.least(other, lowest_own))
        .otherwise(other)
    )
    return resolved.join(best, "line_no", "left").withColumn(
        "answer", F.when(F.col("known"), answer)
    ).drop("top")


def _metrics(grouped, *extra) -> DataFrame:
    known, correct = F.count_if("known"), F.count_if(F.col("answer") == F.col("d_idx"))
    return grouped.agg(
        *extra,
        known.alias("answered"),
        F.count_if(~F.col("known")).alias("oov"),
        correct.alias("correct"),
        F.try_divide(known, F.count("*")).alias("coverage"),
        F.try_divide(correct, known).alias("accuracy"),
    )


def by_category(solved: DataFrame) -> DataFrame:
    """(category, is_syntactic, answered, oov, correct, coverage, accuracy)."""
    return _metrics(solved.groupBy("category", "is_syntactic"))


def totals(solved: DataFrame) -> DataFrame:
    """The same metrics per category, per kind and overall, from summed counts.

    ``level`` is ``category``, ``kind`` or ``total``.
    """
    level = (
        F.when(F.grouping("is_syntactic") == 1, "total")
        .when(F.grouping("category") == 1, "kind")
        .otherwise("category")
    )
    return _metrics(solved.rollup("is_syntactic", "category"), level.alias("level"))
