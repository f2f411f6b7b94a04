"""The five end-to-end jobs, from text files to text files or metric tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import session
from ..operators import analogy, seed, similarity, translate
from ..operators.mapping import apply_map
from ..operators.normalize import normalize
from ..sources import sinks, text
from .config import MapConfig
from .self_learning import LearnedMap, Validation, learn_map


def normalize_job(
    spark: SparkSession,
    source: str,
    target: str,
    actions: Iterable[str],
    encoding: str = "utf-8",
) -> None:
    """Read word vectors, normalise them in double precision, write them."""
    emb = text.read_word2vec(spark, source, encoding=encoding)
    sinks.write_word2vec(normalize(emb, actions), target, encoding)


def build_seed(
    src: DataFrame,
    trg: DataFrame,
    config: MapConfig,
    dictionary: DataFrame | None = None,
) -> DataFrame:
    """Seed dictionary of two normalised tables as the configuration asks for."""
    if config.init == "identical":
        return seed.seed_identical(src, trg)
    if config.init == "numerals":
        return seed.seed_numerals(src, trg)
    if config.init == "unsupervised":
        return seed.seed_unsupervised(
            src,
            trg,
            config.normalize,
            config.unsupervised_vocab,
            config.csls,
            config.direction,
        )
    if dictionary is None:
        raise ValueError("init='dictionary' needs a training dictionary")
    return seed.seed_from_pairs(dictionary, src, trg)


def map_tables(
    src: DataFrame,
    trg: DataFrame,
    config: MapConfig,
    dictionary: DataFrame | None = None,
    validation: DataFrame | None = None,
    on_iteration=None,
) -> tuple[DataFrame, DataFrame, LearnedMap]:
    """Mapped source, mapped target and what was learned, from raw tables.

    ``dictionary`` and ``validation`` hold word pairs (src, trg).
    """
    src, trg = (
        session.cut_lineage(
            normalize(text.set_precision(t, config.precision), config.normalize)
        )
        for t in (src, trg)
    )
    pairs = session.cut_lineage(build_seed(src, trg, config, dictionary))
    checker = None
    if validation is not None:
        gold, coverage = translate.gold_dictionary(validation, src, trg)
        checker = Validation(src, trg, gold, coverage.head()["coverage"])
    learned = learn_map(src, trg, pairs, config, checker, on_iteration)
    if dictionary is not None and config.init == "dictionary":
        learned.oov = seed.oov_pairs(dictionary, src, trg)
    return (
        apply_map(src, learned.linear.src),
        apply_map(trg, learned.linear.trg),
        learned,
    )


def map_job(
    spark: SparkSession,
    src_input: str,
    trg_input: str,
    src_output: str,
    trg_output: str,
    config: MapConfig,
    dictionary: str | None = None,
    validation: str | None = None,
    log: str | None = None,
    on_iteration=None,
) -> LearnedMap:
    """Learn a mapping between two vector files and write both in shared space.

    ``log`` is written in order at the end; until then each iteration's line is in the
    folder ``<log>-turns`` as soon as the iteration has ended. The result's ``oov`` holds
    the training pairs that were left out.
    """
    enc = config.encoding

    def pairs(path):
        return None if path is None else text.read_dictionary(spark, path, enc)

    def turn(row):
        if log is not None:
            sinks.append_training_log(sinks.training_log(spark, [row]), f"{log}-turns")
        if on_iteration is not None:
            on_iteration(row)

    tables = [text.read_word2vec(spark, p, encoding=enc) for p in (src_input, trg_input)]
    src, trg, learned = map_tables(
        *tables, config, pairs(dictionary), pairs(validation), turn
    )
    sinks.write_word2vec(src, src_output, enc)
    sinks.write_word2vec(trg, trg_output, enc)
    if log is not None:
        sinks.write_training_log(learned.log(), log)
    return learned


def evaluate_translation(
    src: DataFrame,
    trg: DataFrame,
    dictionary: DataFrame,
    retrieval: str = "nn",
    dot: bool = False,
    **options,
) -> DataFrame:
    """One row (coverage, accuracy) of word translation against ``dictionary``."""
    src, trg = (session.cut_lineage(translate.comparable(t, dot)) for t in (src, trg))
    gold, coverage = translate.gold_dictionary(dictionary, src, trg)
    gold = session.cut_lineage(gold)
    found = translate.translate(src, trg, gold, retrieval, **options)
    accuracy = translate.translation_accuracy(found, gold)
    return coverage.select(
        "coverage", F.lit(accuracy.head()["accuracy"]).cast("double").alias("accuracy")
    )


def translation_job(
    spark: SparkSession,
    src: str,
    trg: str,
    dictionary: str,
    retrieval: str = "nn",
    encoding: str = "utf-8",
    precision: str = "fp32",
    **options,
) -> DataFrame:
    tables = (
        text.read_word2vec(spark, p, encoding=encoding, precision=precision)
        for p in (src, trg)
    )
    raw = text.read_dictionary(spark, dictionary, encoding)
    return evaluate_translation(*tables, raw, retrieval, **options)


def evaluate_similarity(
    pairs: DataFrame,
    src: DataFrame,
    trg: DataFrame | None = None,
    backoff: float | None = None,
) -> DataFrame:
    """(dataset, scored, oov, coverage, pearson, spearman)."""
    scored = similarity.system_scores(similarity.pair_scores(pairs, src, trg), backoff)
    return similarity.correlations(session.cut_lineage(scored))


def similarity_job(
    spark: SparkSession,
    datasets,
    src: str,
    trg: str | None = None,
    lowercase: bool = False,
    backoff: float | None = None,
    encoding: str = "utf-8",
    precision: str = "fp32",
    sim: Iterable[str] | None = None,
    rel: Iterable[str] | None = None,
    all_: Iterable[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Per-dataset results and their averages.

    Of the vector files only the words of the datasets are parsed.
    """
    pairs = session.cut_lineage(text.read_similarity(spark, datasets, lowercase, encoding))

    def table(path):
        # the words of both columns: the order of a monolingual pair is not known
        words = pairs.select(F.explode(F.array("w1", "w2")).alias("word")).distinct()
        return text.read_word2vec(spark, path, 0, words, encoding, precision)

    results = session.cut_lineage(
        evaluate_similarity(
            pairs, table(src), None if trg is None else table(trg), backoff
        )
    )
    return results, similarity.summarise(results, sim, rel, all_)


def evaluate_analogy(questions: DataFrame, emb: DataFrame) -> DataFrame:
    """Each question with its answer; feed it to ``by_category`` or ``totals``."""
    emb = session.cut_lineage(normalize(emb, ["unit"]))
    resolved = session.cut_lineage(analogy.resolve_questions(questions, emb))
    return session.cut_lineage(analogy.solve_analogies(resolved, emb))


def analogy_job(
    spark: SparkSession,
    emb: str,
    questions: str,
    threshold: int = 0,
    lowercase: bool = False,
    encoding: str = "utf-8",
    precision: str = "fp32",
) -> tuple[DataFrame, DataFrame]:
    """Per-category and rolled-up accuracy and coverage.

    Lines that are not four words are set aside by the reader; the totals carry their
    number over the whole file as ``refused_lines``.
    """
    table = text.read_word2vec(
        spark, emb, threshold, encoding=encoding, precision=precision
    )
    read = session.cut_lineage(text.read_analogies(spark, questions, lowercase, encoding))
    asked = read.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    refused = read.where(F.col("_corrupt_record").isNotNull()).count()
    solved = evaluate_analogy(asked, table)
    totals = analogy.totals(solved).withColumn("refused_lines", F.lit(refused).cast("bigint"))
    return analogy.by_category(solved), totals
