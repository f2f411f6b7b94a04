"""Seed dictionaries: from pairs, identical words, numerals or no supervision."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from . import induction
from .lookup import resolve_pairs, word_index
from .pairs import means_of_scan
from .profiles import Profiles, scan_of, sort_profile, sqrt_similarity  # noqa: F401

# Fixed value: what counts as a numeral.
NUMERAL = "^[0-9]+$"


def seed_from_pairs(raw: DataFrame, src: DataFrame, trg: DataFrame) -> DataFrame:
    """(src_idx, trg_idx, w) for the pairs with both words known; copies weigh more."""
    known = F.col("src_idx").isNotNull() & F.col("trg_idx").isNotNull()
    found = resolve_pairs(raw, src, trg)
    return found.where(known).select("src_idx", "trg_idx", "w")


def oov_pairs(raw: DataFrame, src: DataFrame, trg: DataFrame) -> DataFrame:
    """(src, trg, w): dictionary entries with a word missing on either side."""
    missing = F.col("src_idx").isNull() | F.col("trg_idx").isNull()
    return resolve_pairs(raw, src, trg).where(missing).select("src", "trg", "w")


def seed_identical(src: DataFrame, trg: DataFrame) -> DataFrame:
    """One pair for every word found in both tables."""
    left = word_index(src).withColumnRenamed("idx", "src_idx")
    right = word_index(trg).withColumnRenamed("idx", "trg_idx")
    pairs = left.join(right, "word")
    return pairs.select("src_idx", "trg_idx", F.lit(1).cast("bigint").alias("w"))


def seed_numerals(src: DataFrame, trg: DataFrame) -> DataFrame:
    """Identical words made of the digits 0-9 only."""
    numeral = F.col("word").rlike(NUMERAL)
    return seed_identical(src.where(numeral), trg.where(numeral))


def unsupervised_size(src: DataFrame, trg: DataFrame, vocab: int) -> int:
    """Rows compared per side: the smaller table, or ``vocab`` if that is less."""
    smaller = min(src.count(), trg.count())
    return smaller if vocab <= 0 else min(smaller, vocab)


def limit_vocabulary(src: DataFrame, trg: DataFrame, vocab: int):
    """The leading rows of both tables, equally many of each."""
    size = unsupervised_size(src, trg, vocab)
    return src.where(F.col("idx") < size), trg.where(F.col("idx") < size)


def similarity_profiles(emb: DataFrame, actions: Iterable[str]) -> Profiles:
    """Sorted, normalised square-root similarities of a table, as vectors."""
    return Profiles(emb, actions)


def profile_scores(
    src_profiles: Profiles, trg_profiles: Profiles, csls: int = 0
) -> DataFrame:
    """(src_idx, trg_idx, score): best target of each source by profile similarity.

    With ``csls`` the score is reduced by half of both neighbourhood means.
    """
    scan = scan_of(src_profiles, trg_profiles)
    best = _induced(src_profiles, trg_profiles, "forward", csls, scan)
    scored = best.select("src_idx", "trg_idx", "score")
    if csls <= 0:
        return scored
    own = means_of_scan(scan, csls).select(F.col("idx").alias("src_idx"), "value")
    return scored.join(own, "src_idx").select(
        "src_idx", "trg_idx", (F.col("score") - F.col("value") / 2).alias("score")
    )


def profile_means(src_profiles: Profiles, trg_profiles: Profiles, k: int) -> DataFrame:
    """(idx, value): mean of the k best similarities of each source profile."""
    scan = scan_of(src_profiles, trg_profiles)
    return means_of_scan(scan, k).drop("job")


def _induced(src: Profiles, trg: Profiles, direction: str, csls: int, scan=None) -> DataFrame:
    scan = scan or scan_of(src, trg)
    return induction.Inducer(src.frame, trg.frame, direction, csls, scan=scan).run()


def seed_unsupervised(
    src: DataFrame,
    trg: DataFrame,
    actions: Iterable[str],
    vocab: int = 0,
    csls: int = 0,
    direction: str = "union",
) -> DataFrame:
    """Pairs whose similarity profiles match best, from the leading ``vocab`` rows."""
    actions = list(actions)
    tables = limit_vocabulary(src, trg, vocab)
    profiles = [similarity_profiles(t, actions) for t in tables]
    return induction.as_dictionary(_induced(*profiles, direction, csls))
