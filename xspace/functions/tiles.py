"""Task-side NumPy helpers: score tiles and the reductions taken over them.

A task holds one vector block and lets the other side stream past it. Every tile
of scores is reduced at once; only per-row results leave the task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from . import hashing

TILE_CELLS = 1 << 21
# Held rows met at a time: tiles, candidates and their sorting stay as small for any table.
HELD_ROWS = 1 << 14
LAST_ID = np.iinfo(np.int64).max
SCAN_SCHEMA = "job int, idx bigint, nbr bigint, score double, aux double"


@dataclass(frozen=True)
class TopK:
    """Best ``k`` neighbours of each row of ``side`` by alpha*sim - penalty(neighbour).

    ``keep`` < 1 replaces a random share of the scores by 0 before the choice.
    The ``aux`` output column is the best plain similarity of the row.
    """

    side: str
    k: int = 1
    alpha: float = 1.0
    penalty: bool = False
    keep: float = 1.0
    key: int = 0


@dataclass(frozen=True)
class LogSumExp:
    """Log of sum(weight * exp(beta*sim)) over the other side, per row of ``side``.

    Emitted as a maximum (``score``) and a sum scaled by it (``aux``).
    """

    side: str
    beta: float = 1.0
    weighted: bool = False


def matrix(column) -> np.ndarray:
    """Rows of a list column as a 2-d array, without copying the values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def list_array(m: np.ndarray) -> pa.Array:
    offsets = pa.array(np.arange(len(m) + 1, dtype=np.int64) * m.shape[1], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(m).ravel()))


def map_vectors(df, change, vec_type: str):
    """Replace ``vec`` by ``change(matrix)``, batch by batch, keeping other columns.

    A map over batches runs once per row, while a column expression may be copied
    into every place that uses it.
    """
    fields = [
        f"`{f.name}` {vec_type if f.name == 'vec' else f.dataType.simpleString()}"
        for f in df.schema
    ]
    at = df.columns.index("vec")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                columns = list(batch.columns)
                columns[at] = change(matrix(columns[at]))
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, ", ".join(fields))


def top_rows(scores: np.ndarray, k: int) -> np.ndarray:
    """Column positions of the ``k`` best entries per row; ties go to lower columns."""
    if k == 1:
        return scores.argmax(axis=1)[:, None]
    n = scores.shape[1]
    if k >= n:
        return np.argsort(-scores, axis=1, kind="stable")
    part = np.argpartition(scores, n - k, axis=1)[:, n - k :]
    part.sort(axis=1)
    best = np.take_along_axis(scores, part, axis=1)
    order = np.argsort(-best, axis=1, kind="stable")
    part = np.take_along_axis(part, order, axis=1)
    kth = np.take_along_axis(scores, part[:, -1:], axis=1)
    for row in np.flatnonzero((scores >= kth).sum(axis=1) > k):
        # equal scores straddle the cut: settle them by position
        part[row] = np.argsort(-scores[row], kind="stable")[:k]
    return part


class HeldTopK:
    """Running best ``k`` per held row while the other side streams past.

    The more has been seen, the fewer new scores reach a row's ``k`` best, so a tile
    is only compared with the bar and the rare candidates are sorted in now and then.
    """

    def __init__(self, rows: int, k: int):
        self.k = k
        self.score = np.full((rows, k), -np.inf)
        self.nbr = np.full((rows, k), LAST_ID)
        self.best = np.full(rows, -np.inf)
        self.waiting: list[tuple] = []
        self.seen = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, best: np.ndarray):
        """``scores`` holds a streamed row per row and a held row per column."""
        np.maximum(self.best, best, out=self.best)
        if self.k == 1:
            self._add_best(scores, ids)
        elif self.seen < self.k:
            pos = top_rows(np.ascontiguousarray(scores.T), self.k)
            rows = np.arange(len(pos))[:, None]
            self.waiting.append(
                (np.repeat(rows, pos.shape[1]), scores[pos, rows].ravel(), ids[pos].ravel())
            )
            self._settle()
        else:
            at, rows = np.nonzero(scores >= self.score[:, -1].astype(scores.dtype))
            self.waiting.append((rows, scores[at, rows], ids[at]))
            if sum(len(w[0]) for w in self.waiting) >= self.nbr.size:
                self._settle()
        self.seen += len(ids)

    def _add_best(self, scores, ids):
        top, bar = scores.max(axis=0).astype(np.float64), self.score[:, 0]
        rows = np.flatnonzero(top >= bar)
        nbr = ids[scores[:, rows].argmax(axis=0)]
        wins = (top[rows] > bar[rows]) | (nbr < self.nbr[rows, 0])
        rows = rows[wins]
        self.score[rows, 0], self.nbr[rows, 0] = top[rows], nbr[wins]

    def _settle(self):
        if not self.waiting:
            return
        rows, score, nbr = (np.concatenate(parts) for parts in zip(*self.waiting))
        self.waiting = []
        order = np.argsort(rows, kind="stable")
        rows, score, nbr = rows[order], score[order], nbr[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        # a bounded number of newcomers per row at a time
        width = 2 * self.k
        for first in range(0, int(rank.max()) + 1 if len(rank) else 0, width):
            now = (rank >= first) & (rank < first + width)
            self._merge(rows[now], rank[now] - first, score[now], nbr[now])

    def _merge(self, rows, slot, score, nbr):
        n, k = self.nbr.shape
        width = int(slot.max()) + 1
        scores = np.full((n, k + width), -np.inf)
        ids = np.full((n, k + width), LAST_ID)
        scores[:, :k], ids[:, :k] = self.score, self.nbr
        scores[rows, k + slot], ids[rows, k + slot] = score, nbr
        order = np.argsort(-scores, axis=1, kind="stable")
        scores = np.take_along_axis(scores, order, axis=1)
        ids = np.take_along_axis(ids, order, axis=1)
        tied = (scores[:, 1:] == scores[:, :-1]) & (ids[:, 1:] < ids[:, :-1])
        for row in np.flatnonzero(tied.any(axis=1)):
            fixed = np.lexsort((ids[row], -scores[row]))
            scores[row], ids[row] = scores[row, fixed], ids[row, fixed]
        self.score, self.nbr = scores[:, :k].copy(), ids[:, :k].copy()

    def bar(self):
        """The least of each row's best; minus infinity while there are fewer than ``k``."""
        self._settle()
        return self.score[:, -1]

    def result(self):
        self._settle()
        return self.nbr, self.score, self.best


class _HeldLogSumExp:
    def __init__(self, rows: int):
        self.top = np.full(rows, -np.inf)
        self.total = np.zeros(rows)

    def add(self, top: np.ndarray, total: np.ndarray):
        new = np.maximum(self.top, top)
        self.total = self.total * np.exp(self.top - new) + total * np.exp(top - new)
        self.top = new


class _Top:
    """Best ``k`` of a few streamed rows, run by run of the held ones."""

    def __init__(self, k: int):
        self.k, self.parts = k, []

    def add(self, scores: np.ndarray, ids: np.ndarray, best: np.ndarray):
        pos = top_rows(scores, self.k)
        self.parts.append((ids[pos], np.take_along_axis(scores, pos, axis=1), best))

    def result(self):
        nbr, score = (np.concatenate(p, axis=1) for p in list(zip(*self.parts))[:2])
        best = np.max([p[2] for p in self.parts], axis=0)
        if len(self.parts) > 1:
            # runs are in order of id and each one's equals too, so ties stay settled
            pos = top_rows(score, self.k)
            nbr, score = np.take_along_axis(nbr, pos, axis=1), np.take_along_axis(score, pos, axis=1)
        return nbr, score, best


def _log_sum_exp(scores: np.ndarray, weights):
    top = scores.max(axis=1)
    terms = np.exp(scores - top[:, None])
    return top, terms @ weights if weights is not None else terms.sum(axis=1)


def _rows(job, ids, nbr, score, aux):
    n = len(ids)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, job, dtype=np.int32)),
            pa.array(np.asarray(ids, dtype=np.int64)),
            pa.array(np.asarray(nbr, dtype=np.int64)),
            pa.array(np.asarray(score, dtype=np.float64)),
            pa.array(np.asarray(aux, dtype=np.float64)),
        ],
        names=["job", "idx", "nbr", "score", "aux"],
    )


def top_batch(job, ids, nbr, score, best):
    k = nbr.shape[1]
    flat = nbr.ravel()
    found = flat != LAST_ID
    return _rows(
        job,
        np.repeat(ids, k)[found],
        flat[found],
        score.ravel()[found] + 0.0,  # a dropped negative score is -0.0
        np.repeat(best, k)[found],
    )


def mean_of_top(scores: np.ndarray, k: int) -> np.ndarray:
    n = scores.shape[1]
    if k >= n:
        return scores.mean(axis=1)
    return np.partition(scores, n - k, axis=1)[:, n - k :].mean(axis=1)


def scan_tiles(jobs, held, stream, held_is_left: bool, own_mean: int = 0):
    """Reduce all scores between a held block and a stream of blocks.

    ``held`` and the items of ``stream`` are (ids, matrix, extra) with ``extra`` a
    penalty or weight per row, or None. ``own_mean`` > 0 takes each streamed row's
    penalty to be half its mean of that many best similarities, read off the tile.
    """
    held_ids, held_mat, held_extra = _by_id(*held)
    rows = len(held_ids)
    runs = [slice(a, a + HELD_ROWS) for a in range(0, max(1, rows), HELD_ROWS)]
    held_side = "left" if held_is_left else "right"
    state = [
        [_state(job, len(held_ids[run])) for run in runs] if job.side == held_side else None
        for job in jobs
    ]
    step = max(1, TILE_CELLS // max(1, min(rows, HELD_ROWS)))
    for block in stream:
        ids, mat, extra = _by_id(*block)
        for a in range(0, len(ids), step):
            b = a + step
            part = None if extra is None else extra[a:b]
            if own_mean:
                part = _own_mean(mat[a:b], held_mat, runs, own_mean) / 2
            found = [
                None
                if kept is not None
                else _Top(job.k)
                if isinstance(job, TopK)
                else _HeldLogSumExp(len(ids[a:b]))
                for job, kept in zip(jobs, state)
            ]
            for r, run in enumerate(runs):
                sims = mat[a:b] @ held_mat[run].T
                for number, job in enumerate(jobs):
                    on_held = state[number] is not None
                    other = part if on_held else None if held_extra is None else held_extra[run]
                    if isinstance(job, TopK):
                        scores = _scores(
                            job, sims, other, on_held, ids[a:b], held_ids[run], held_is_left
                        )
                        best = sims.max(axis=0 if on_held else 1)
                        if on_held:
                            state[number][r].add(scores, ids[a:b], best)
                        else:
                            found[number].add(scores, held_ids[run], best)
                    else:
                        scaled = sims.astype(np.float64) * job.beta
                        top, total = _log_sum_exp(
                            scaled.T if on_held else scaled, other if job.weighted else None
                        )
                        (state[number][r] if on_held else found[number]).add(top, total)
            for number, kept in enumerate(found):
                if isinstance(kept, _Top):
                    yield top_batch(number, ids[a:b], *kept.result())
                elif kept is not None:
                    yield _rows(number, ids[a:b], ids[a:b], kept.top, kept.total)
    for number, kept in enumerate(state):
        for run, own in zip(runs, kept or ()):
            if isinstance(own, HeldTopK):
                yield top_batch(number, held_ids[run], *own.result())
            elif rows and np.isfinite(own.top[0]):
                yield _rows(number, held_ids[run], held_ids[run], own.top, own.total)


def _by_id(ids, mat, extra):
    """Rows in order of id; rows that are need no copy."""
    if (ids[1:] >= ids[:-1]).all():
        return ids, mat, extra
    order = np.argsort(ids, kind="stable")
    return ids[order], mat[order], None if extra is None else extra[order]


def _state(job, rows):
    return HeldTopK(rows, job.k) if isinstance(job, TopK) else _HeldLogSumExp(rows)


def _own_mean(mat, held_mat, runs, k):
    best = [_best_values(mat @ held_mat[run].T, k) for run in runs]
    return mean_of_top(np.concatenate(best, axis=1), k)


def _best_values(scores, k):
    n = scores.shape[1]
    # a copy: a view would keep the whole tile
    return scores if k >= n else np.partition(scores, n - k, axis=1)[:, n - k :].copy()


def _scores(job, sims, other, on_held, stream_ids, held_ids, held_is_left):
    scores = sims if job.alpha == 1.0 else sims * job.alpha
    if job.penalty:
        other = other.astype(sims.dtype, copy=False)
        scores = scores - (other[:, None] if on_held else other[None, :])
    if job.keep < 1.0:
        left_ids, right_ids = (
            (held_ids, stream_ids) if held_is_left else (stream_ids, held_ids)
        )
        left = hashing.id_keys(left_ids, hashing.ROW_STREAM, job.key)
        right = hashing.id_keys(right_ids, hashing.COL_STREAM, job.key)
        rows, cols = (right, left) if held_is_left else (left, right)
        kept = hashing.keep_mask(rows, cols, job.keep)
        scores = scores * kept
    return scores


def profile_rows(ids, mat, columns, first, in_order):
    """Whole similarity rows against a held block, a bounded number at a time."""
    step = max(1, TILE_CELLS // max(1, columns.shape[1]))
    for a in range(0, len(ids), step):
        sims = mat[a : a + step] @ columns
        if in_order:
            sims.sort(axis=1)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids[a : a + step]),
                pa.array(np.full(len(sims), first, dtype=np.int64)),
                list_array(sims.astype(np.float64, copy=False)),
            ],
            names=["idx", "first", "part"],
        )


def split_sides(batches, left_map, right_map):
    """First the held rows (side 0) as one block, then an iterator of the rest.

    Batches carry (side, idx, vec, extra) and arrive with side 0 in front.
    """
    held, pending = [], None
    batches = iter(batches)
    for batch in batches:
        side = batch.column(0).to_numpy()
        cut = int(np.searchsorted(side, 1))
        if cut:
            held.append(_block(batch.slice(0, cut), left_map))
        if cut < len(side):
            pending = _block(batch.slice(cut), right_map)
            break
    if not held or pending is None:
        return None, iter(())
    block = tuple(np.concatenate(parts) for parts in zip(*held))

    def rest():
        yield pending
        for batch in batches:
            if batch.num_rows:
                yield _block(batch, right_map)

    return block, rest()


def _block(batch, linear):
    mat = matrix(batch.column(2))
    if linear is not None:
        mat = mat @ linear.astype(mat.dtype)
    return (
        batch.column(1).to_numpy(),
        mat,
        batch.column(3).to_numpy(zero_copy_only=False),
    )
