"""Rank of given queries at every target, by counting sources above them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import session, tiles

RANK_SCHEMA = "src_idx bigint, trg_idx bigint, rank bigint, sim double"
# Counting keeps one score and one count per (target, query) in a task.
STATE_CELLS = 1 << 22


def rank_cells(asked: DataFrame, trg: DataFrame, src: DataFrame) -> DataFrame:
    """One partition per (target group, query group): both, then all sources.

    Group sizes bound a task's state; only the sources pass through every cell,
    streamed.
    """
    spark = trg.sparkSession
    n_asked, n_trg = max(1, asked.count()), max(1, trg.count())
    query_groups = math.ceil(n_asked / 4096)
    per_group = max(1, STATE_CELLS // math.ceil(n_asked / query_groups))
    trg_groups = max(
        math.ceil(n_trg / per_group),
        math.ceil(session.parallelism(spark) / query_groups),
    )
    cells = trg_groups * query_groups

    def rows(df, part, cell):
        return df.selectExpr(
            f"tinyint({part}) AS part", "idx", "vec", f"explode({cell}) AS cell"
        )

    def group(n):
        return f"int(pmod(xxhash64(idx), {n}))"

    targets = f"q -> {group(trg_groups)} * {query_groups} + q"
    queries = f"t -> t * {query_groups} + {group(query_groups)}"
    everything = (
        rows(trg, 0, f"transform(sequence(0, {query_groups - 1}), {targets})")
        .unionAll(rows(asked, 1, f"transform(sequence(0, {trg_groups - 1}), {queries})"))
        .unionAll(rows(src, 2, f"sequence(0, {cells - 1})"))
    )
    return (
        everything.repartitionById(cells, "cell")
        .sortWithinPartitions("part")
        .select("part", "idx", "vec")
    )


def _runs(batches):
    """(part, ids, matrix) for each stretch of equal part within the batches."""
    for batch in batches:
        part = batch.column(0).to_numpy()
        for value in np.unique(part):
            a, b = np.searchsorted(part, [value, value + 1])
            piece = batch.slice(a, b - a)
            yield value, piece.column(1).to_numpy(), tiles.matrix(piece.column(2))


def best_ranks(batches):
    """Best (rank, sim, target) of each query over a cell's targets."""
    trg, asked, counter = [], [], None
    for part, ids, mat in _runs(batches):
        if part == 0:
            trg.append((ids, mat))
        elif part == 1:
            asked.append((ids, mat))
        elif trg and asked:
            if counter is None:
                counter = _Counter(_stack(trg), _stack(asked))
            counter.add(ids, mat)
    if counter is not None:
        yield counter.result()


def _stack(blocks):
    ids, mat = (np.concatenate(parts) for parts in zip(*blocks))
    order = np.argsort(ids)
    return ids[order], mat[order]


class _Counter:
    def __init__(self, trg, asked):
        self.trg_ids, self.trg = trg
        self.asked_ids, asked_mat = asked
        self.sims = self.trg @ asked_mat.T
        self.order = np.argsort(self.sims, axis=1)
        self.sorted = np.take_along_axis(self.sims, self.order, axis=1)
        self.above = np.zeros(self.sims.shape, dtype=np.int64)

    def add(self, ids, mat):
        # long runs of sources: each one costs a search per target row
        step = max(1, min(4096, 8 * tiles.TILE_CELLS // len(self.trg_ids)))
        for a in range(0, len(ids), step):
            self._add(ids[a : a + step], mat[a : a + step])

    def _add(self, ids, mat):
        scores = self.trg @ mat.T
        # a query's own row must score exactly as it did when it set the bar
        where = np.minimum(
            np.searchsorted(self.asked_ids, ids), len(self.asked_ids) - 1
        )
        own = np.flatnonzero(self.asked_ids[where] == ids)
        scores[:, own] = self.sims[:, where[own]]
        n = self.sims.shape[1]
        for row, (bars, values) in enumerate(zip(self.sorted, scores)):
            below = np.searchsorted(bars, values, side="left")
            passed = np.bincount(below, minlength=n + 1)
            # sources strictly above bar j are those with more than j bars below
            above = passed[::-1].cumsum()[::-1][1:]
            self.above[row, self.order[row]] += above
            self._ties(row, ids, values, bars, below)

    def _ties(self, row, ids, values, bars, below):
        # an equal score ranks higher only if it belongs to a lower source id
        tied = np.flatnonzero(
            (below < len(bars)) & (bars[np.minimum(below, len(bars) - 1)] == values)
        )
        if not len(tied):
            return
        # sources by (bar, id); a query's lower sources are those between two searches
        runs, sources = below[tied], ids[tied]
        by_run = np.lexsort((sources, runs))
        sources = sources[by_run]
        values_, begins = np.unique(runs[by_run], return_index=True)
        ends = np.append(begins[1:], len(sources))
        upper = np.searchsorted(bars, bars[values_], side="right")
        for a, b, begin, end in zip(values_, upper, begins, ends):
            places = self.order[row, a:b]
            lower = np.searchsorted(sources[begin:end], self.asked_ids[places], side="left")
            self.above[row, places] += lower

    def result(self):
        # lexicographic minimum of (rank, -sim, target) down each column
        best = np.lexsort(
            (
                np.broadcast_to(self.trg_ids[:, None], self.sims.shape),
                -self.sims,
                self.above,
            ),
            axis=0,
        )[0]
        columns = np.arange(len(self.asked_ids))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.asked_ids),
                pa.array(self.trg_ids[best]),
                pa.array(self.above[best, columns]),
                pa.array(self.sims[best, columns].astype(np.float64)),
            ],
            names=["src_idx", "trg_idx", "rank", "sim"],
        )
