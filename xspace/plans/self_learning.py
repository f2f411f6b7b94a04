"""Self-learning: alternate a map fit and dictionary induction until no gain."""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions import session, vectors
from ..operators import induction, mapping, pairs
from ..operators.mapping import LinearMap
from ..sources.sinks import training_log
from .config import MapConfig


@dataclass(frozen=True)
class LoopState:
    """Where the loop stands; all of it is a few numbers on the driver."""

    keep: float
    iteration: int = 1
    last_improvement: int = 0
    best: float = -100.0
    last_pass: bool = False

    @classmethod
    def start(cls, config: MapConfig) -> LoopState:
        return cls(keep=config.stochastic_initial, last_pass=not config.self_learning)

    def begin(self, config: MapConfig) -> LoopState:
        """Before a fit: after a stretch without gain keep more scores, or stop."""
        if self.iteration - self.last_improvement <= config.stochastic_interval:
            return self
        return replace(
            self,
            last_pass=self.last_pass or self.keep >= 1.0,
            keep=min(1.0, config.stochastic_multiplier * self.keep),
            last_improvement=self.iteration,
        )

    def finish(self, objective: float, config: MapConfig) -> LoopState:
        """After an induction: note a gain of at least the threshold."""
        gained = objective - self.best >= config.threshold
        return replace(
            self,
            best=objective if gained else self.best,
            last_improvement=self.iteration if gained else self.last_improvement,
            iteration=self.iteration + 1,
        )


@dataclass
class LearnedMap:
    linear: LinearMap
    dictionary: DataFrame
    log_rows: list[tuple] = field(default_factory=list)
    # training pairs (src, trg, w) with a word that a table lacks, where a dictionary was given
    oov: DataFrame | None = None

    def log(self) -> DataFrame:
        return training_log(self.dictionary.sparkSession, self.log_rows)


class Validation:
    """Accuracy and similarity of a source map on gold pairs, over all targets."""

    def __init__(self, src: DataFrame, trg: DataFrame, gold: DataFrame, coverage: float):
        gold = gold.select("src_idx", "trg_idx").distinct()
        wanted = gold.select(F.col("src_idx").alias("idx")).distinct()
        self.asked = session.cut_lineage(
            src.select("idx", "vec").join(wanted, "idx", "left_semi")
        )
        z = trg.select(F.col("idx").alias("trg_idx"), F.col("vec").alias("z"))
        self.gold = session.cut_lineage(gold.join(z, "trg_idx"))
        self.coverage = coverage
        self.scan = pairs.PairScan(self.asked, trg.select("idx", "vec"))

    def measure(self, src_map: np.ndarray | None) -> DataFrame:
        """One row (similarity, accuracy, coverage); NULL without gold pairs."""
        raw = self.scan.run([pairs.TopK("left")], left_map=src_map)
        best = pairs.reduce_top(raw, 1).select(F.col("idx").alias("src_idx"), "nbr")
        mapped = mapping.apply_map(self.asked, src_map).select(
            F.col("idx").alias("src_idx"), "vec"
        )
        per_source = (
            self.gold.join(mapped, "src_idx")
            .join(best, "src_idx")
            .groupBy("src_idx")
            .agg(
                F.max(vectors.dot("vec", "z")).alias("similarity"),
                F.expr("int(bool_or(trg_idx = nbr))").alias("hit"),
            )
        )
        return per_source.agg(
            F.avg("similarity").alias("similarity"),
            F.avg("hit").alias("accuracy"),
            F.lit(self.coverage).cast("double").alias("coverage"),
        )


def final_fit(gram: mapping.JointGram, config: MapConfig) -> LinearMap:
    if config.map_type == "orthogonal":
        return mapping.fit_orthogonal(gram)
    if config.map_type == "unconstrained":
        return mapping.fit_unconstrained(gram)
    return mapping.fit_advanced(
        gram,
        config.whiten,
        config.src_reweight,
        config.trg_reweight,
        config.src_dewhiten,
        config.trg_dewhiten,
        config.dim_reduction,
    )


def learn_map(
    src: DataFrame,
    trg: DataFrame,
    seed: DataFrame,
    config: MapConfig,
    validation: Validation | None = None,
    on_iteration=None,
) -> LearnedMap:
    """Fit the map from a seed dictionary, refining it first if configured.

    ``src`` and ``trg`` are normalised tables that are cheap to read again, such as
    checkpointed ones. Each round depends only on them and on the map, a
    width-sized matrix, so plans do not grow; the induced dictionary is
    checkpointed because the next fit and the objective both read it.
    """
    config.validate()
    dictionary, rows, state = seed, [], LoopState.start(config)
    inducer = scope = None
    if config.self_learning:
        # scanned twice a round: evenly spread and kept in memory
        tasks = session.parallelism(src.sparkSession)
        scope = []
        for table in (src, trg):
            table = induction.vocabulary_cutoff(
                table.select("idx", "vec"), config.vocabulary_cutoff
            )
            if config.vocabulary_cutoff > 0:
                table = table.repartition(tasks)
            scope.append(table.persist())
        inducer = induction.Inducer(
            *scope, config.direction, config.csls, spread=config.vocabulary_cutoff <= 0
        )
    clock = time.monotonic()
    try:
        while True:
            state = state.begin(config)
            # induced ids lie within the cut-off; only the seed may reach beyond it
            if dictionary is seed:
                gram = mapping.collect_joint_gram(src, trg, seed)
            else:
                gram = inducer.joint_gram(dictionary)
            if state.last_pass:
                break
            w = mapping.fit_orthogonal(gram).src
            found = session.cut_lineage(
                inducer.run(w, state.keep, config.seed, state.iteration)
            )
            goal = induction.objective(found).head()[0]
            dictionary = induction.as_dictionary(found)
            checked = (None, None, None)
            if validation is not None:
                checked = tuple(
                    None if x is None else 100 * x for x in validation.measure(w).head()
                )
            now = time.monotonic()
            rows.append(
                (
                    state.iteration,
                    100 * goal,
                    100 - 100 * state.keep,
                    *checked,
                    now - clock,
                )
            )
            if on_iteration is not None:
                on_iteration(rows[-1])
            clock = now
            state = state.finish(goal, config)
    finally:
        if scope is not None:
            inducer.release()
            for table in scope:
                table.unpersist()
    return LearnedMap(final_fit(gram, config), dictionary, rows)
