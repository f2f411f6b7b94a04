import os

import numpy as np
import pytest

from xspace.functions import session
from xspace.operators import profiles, seed

ACTIONS = ["unit", "center", "unit"]


@pytest.fixture
def small_limit(spark):
    """The narrow tables fit a task, their profiles do not."""
    spark.conf.set(session.BROADCAST_BYTES_KEY, "20000")
    yield
    spark.conf.unset(session.BROADCAST_BYTES_KEY)


def folder_bytes(spark):
    top = session.shared_folder(spark).removeprefix("file:")
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(top) for f in names)


def expected_profiles(x):
    values, basis = np.linalg.eigh(x.T @ x)
    rows = np.sort(x @ (basis / np.sqrt(values)) @ basis.T @ x.T, axis=1)
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    rows -= rows.mean(axis=0)
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def test_seed_and_scores_write_no_profiles(spark, vectors_of, rng, small_limit):
    x = rng.normal(size=(300, 4))
    z = x[rng.permutation(300)] @ np.linalg.qr(rng.normal(size=(4, 4)))[0]
    z += rng.normal(size=z.shape) * 0.01
    src, trg = vectors_of(x), vectors_of(z)
    sims = expected_profiles(x) @ expected_profiles(z).T
    before = folder_bytes(spark)
    found = seed.seed_unsupervised(src, trg, ACTIONS, csls=10).collect()
    own, other = (seed.similarity_profiles(t, ACTIONS) for t in (src, trg))
    plain = seed.profile_scores(own, other).collect()
    assert folder_bytes(spark) - before < 300 * 300 * 8  # less than one side's profiles
    near = [np.sort(s, axis=1)[:, -10:].mean(axis=1) / 2 for s in (sims, sims.T)]
    pairs = [(i, j) for i, j in enumerate((sims - near[1]).argmax(axis=1))]
    pairs += [(i, j) for j, i in enumerate((sims.T - near[0]).argmax(axis=1))]
    assert {(r["src_idx"], r["trg_idx"]): r["w"] for r in found} == {
        p: pairs.count(p) for p in pairs
    }
    assert {r["src_idx"]: r["trg_idx"] for r in plain} == dict(enumerate(sims.argmax(axis=1)))
    assert [r["score"] for r in sorted(plain)] == pytest.approx(sims.max(axis=1).tolist())


def test_rows_and_means_of_profiles_not_written(spark, vectors_of, rng, small_limit):
    x = rng.normal(size=(300, 4))
    before = folder_bytes(spark)
    made = profiles.Profiles(vectors_of(x)).then(["unit", "center"])
    means = made.column_means().collect()
    rows = sorted(made.then(["unit"]).written().collect())
    assert folder_bytes(spark) == before
    assert np.allclose([r["mean"] for r in means], 0) and len(means) == 300
    assert np.allclose([r["vec"] for r in rows], expected_profiles(x))
    ordered = profiles.Profiles(vectors_of(x), in_order=False).written().collect()
    root = np.array([r["vec"] for r in sorted(ordered)])
    assert np.allclose(root @ root, x @ x.T)


def test_best_profiles_without_all_pairs(spark, vectors_of, rng):
    x = rng.normal(size=(300, 4))
    x[200:220] = x[100:120]  # equal profiles: rounding says which is taken
    z = x @ np.linalg.qr(rng.normal(size=(4, 4)))[0]
    noisy = x + rng.normal(size=x.shape) * 0.1
    spark.conf.set(session.BROADCAST_BYTES_KEY, "60000")
    try:
        for other in (z, noisy):
            src, trg = (seed.similarity_profiles(vectors_of(m), ACTIONS) for m in (x, other))
            made = spark.sparkContext.accumulator(0)

            def counted(m, _):
                made.add(len(m))
                return m

            trg.steps = trg.steps + [(counted, None)]
            found = sorted(seed.profile_scores(src, trg).collect())
            if other is z:
                # one for its sketch, the rest to compare; each chunk of rows made all before
                assert made.value < 300 * 10
            sims = expected_profiles(x) @ expected_profiles(other).T
            assert [r["src_idx"] for r in found] == list(range(300))
            taken = sims[range(300), [r["trg_idx"] for r in found]]
            assert taken == pytest.approx(sims.max(axis=1))
            assert [r["score"] for r in found] == pytest.approx(sims.max(axis=1).tolist())
    finally:
        spark.conf.unset(session.BROADCAST_BYTES_KEY)


def test_neighbourhoods_without_all_pairs(spark, vectors_of, rng):
    x = rng.normal(size=(600, 3))
    z = x + rng.normal(size=x.shape) * 0.1
    spark.conf.set(session.BROADCAST_BYTES_KEY, "100000")
    try:
        src, trg = (seed.similarity_profiles(vectors_of(m), ACTIONS) for m in (x, z))
        made = spark.sparkContext.accumulator(0)

        def counted(m, _):
            made.add(len(m))
            return m

        for side in (src, trg):
            side.steps = side.steps + [(counted, None)]
        found = sorted(seed.profile_scores(src, trg, csls=10).collect())
        # three scans, each of which made all other rows for every 16 rows before
        assert made.value < 600 * 38
        sims = expected_profiles(x) @ expected_profiles(z).T
        near = [np.sort(s, axis=1)[:, -10:].mean(axis=1) / 2 for s in (sims, sims.T)]
        scores = sims - near[0][:, None] - near[1]
        assert [r["src_idx"] for r in found] == list(range(600))
        assert [r["trg_idx"] for r in found] == scores.argmax(axis=1).tolist()
        assert [r["score"] for r in found] == pytest.approx(scores.max(axis=1).tolist())
        best = seed._induced(src, trg, "forward", 10).collect()
        best = {r["src_idx"]: r["best"] for r in best}
        assert [best[i] for i in range(600)] == pytest.approx(sims.max(axis=1).tolist())
        means = {r["idx"]: r["value"] for r in seed.profile_means(src, src, 10).collect()}
        own = expected_profiles(x) @ expected_profiles(x).T
        assert [means[i] for i in range(600)] == pytest.approx(
            np.sort(own, axis=1)[:, -10:].mean(axis=1).tolist()
        )
    finally:
        spark.conf.unset(session.BROADCAST_BYTES_KEY)


def test_tables_that_are_shipped_in_blocks(spark, vectors_of, rng):
    x = rng.normal(size=(200, 6))
    turned = x @ np.linalg.qr(rng.normal(size=(6, 6)))[0]
    spark.conf.set(session.BROADCAST_BYTES_KEY, "6000")  # the table has 9,600 bytes
    try:
        before = folder_bytes(spark)
        made = profiles.Profiles(vectors_of(x)).then(["unit", "center"])
        assert len(made.table.blocks) == 4
        means = made.column_means().collect()
        rows = sorted(made.then(["unit"]).written().collect())
        ordered = sorted(profiles.Profiles(vectors_of(x), in_order=False).written().collect())
        own, other = (seed.similarity_profiles(vectors_of(m), ACTIONS) for m in (x, turned))
        found = sorted(seed.profile_scores(own, other).collect())
        assert folder_bytes(spark) - before < 200 * 200 * 8  # less than one side's profiles
        assert np.allclose([r["mean"] for r in means], 0) and len(means) == 200
        assert np.allclose([r["vec"] for r in rows], expected_profiles(x))
        root = np.array([r["vec"] for r in ordered])
        assert np.allclose(root @ root, x @ x.T)
        assert [r["trg_idx"] for r in found] == list(range(200))
        assert [r["score"] for r in found] == pytest.approx([1] * 200)
    finally:
        spark.conf.unset(session.BROADCAST_BYTES_KEY)
