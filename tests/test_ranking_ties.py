"""Ranks by counting, where very many vectors are equal."""

import time

import numpy as np
import pyarrow as pa

from xspace.functions import tiles
from xspace.operators.ranking import best_ranks


def batch(part, ids, mat):
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(ids), part, np.int8)), pa.array(ids), tiles.list_array(mat)],
        names=["part", "idx", "vec"],
    )


def test_many_equal_vectors_rank_by_id_and_fast():
    rng = np.random.default_rng(11)
    sources = rng.integers(-2, 3, (3000, 4)).astype(float)
    sources[500:2200] = sources[0]
    sources[2500:2700] = 0.0
    asked, targets = np.arange(0, 3000, 7), rng.integers(-2, 3, (60, 4)).astype(float)
    began = time.time()
    found = next(
        best_ranks(
            [
                batch(0, np.arange(len(targets)), targets),
                batch(1, asked, sources[asked]),
                *[batch(2, np.arange(a, a + 1000), sources[a : a + 1000]) for a in (0, 1000, 2000)],
            ]
        )
    ).to_pydict()
    assert time.time() - began < 10
    sims = targets @ sources.T
    order = np.lexsort((np.broadcast_to(np.arange(3000), sims.shape), -sims), axis=1)
    ranks = np.argsort(order, axis=1)
    assert found["src_idx"] == asked.tolist()
    for q, trg, rank in zip(asked, found["trg_idx"], found["rank"]):
        best = min((ranks[t, q], -sims[t, q], t) for t in range(len(targets)))
        assert (rank, trg) == (best[0], best[2])
