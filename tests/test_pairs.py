import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from xspace.functions import hashing, session, tiles
from xspace.operators import induction, pairs, seed, translate


def best_of(scores, k):
    """Per row: column ids by score descending, then id ascending."""
    return [
        sorted(range(scores.shape[1]), key=lambda j: (-row[j], j))[:k] for row in scores
    ]


@pytest.fixture
def tables(vectors_of, rng):
    x, z = rng.integers(-3, 4, (23, 3)) * 1.0, rng.integers(-3, 4, (31, 3)) * 1.0
    z[5] = z[9]  # a tie for every row
    return x, z, vectors_of(x), vectors_of(z)


@pytest.mark.parametrize("k", [1, 3, 40])
@pytest.mark.parametrize("side", ["left", "right"])
def test_top_neighbours_with_penalty(tables, route, k, side):
    x, z, left, right = tables
    pen_x, pen_z = np.arange(len(x)) % 3 * 1.0, np.arange(len(z)) % 4 * 1.0
    left = left.withColumn("extra", (F.col("idx") % 3).cast("double"))
    right = right.withColumn("extra", (F.col("idx") % 4).cast("double"))
    got = pairs.top_neighbours(left, right, k, 2.0, True, side).collect()
    scores = 2 * x @ z.T - pen_z if side == "left" else 2 * z @ x.T - pen_x
    expected = best_of(scores, k)
    found = {(r["idx"], r["rank"]): (r["nbr"], r["score"]) for r in got}
    assert len(found) == len(got) == sum(map(len, expected))
    for i, row in enumerate(expected):
        for rank, j in enumerate(row, 1):
            assert found[i, rank] == (j, scores[i, j])


def test_results_do_not_depend_on_layout(tables, route, spark):
    _, _, left, right = tables
    once = induction.induce(left, right, "union", csls=4, keep=0.5).collect()
    again = induction.induce(
        left.repartition(1), right.orderBy(F.desc("idx")), "union", csls=4, keep=0.5
    ).collect()
    key = lambda r: (r["direction"], r["src_idx"], r["trg_idx"])
    assert sorted(map(key, once)) == sorted(map(key, again))


@pytest.mark.parametrize("k", [2, 50])
def test_topk_mean_pads_with_the_minimum(tables, route, k):
    x, z, left, right = tables
    for side, sims in (("left", x @ z.T), ("right", z @ x.T)):
        got = dict(pairs.topk_mean(left, right, k, side).collect())
        low = sims.min()
        for i, row in enumerate(sims):
            top = sorted(row, reverse=True)[:k]
            top += [low] * (k - len(top))
            assert got[i] == pytest.approx(sum(top) / k)


def test_topk_mean_of_nothing_is_zero(tables):
    _, _, left, right = tables
    assert {r[1] for r in pairs.topk_mean(left, right, 0).collect()} == {0.0}


@pytest.mark.parametrize("direction", ["forward", "backward", "union"])
@pytest.mark.parametrize("csls", [0, 3, 60])
def test_induction_against_plain_scores(tables, route, direction, csls):
    x, z, left, right = tables
    sims = x @ z.T

    def near(s):
        rows = []
        for row in s:
            top = sorted(row, reverse=True)[:csls]
            rows.append(sum(top + [s.min()] * (csls - len(top))) / csls)
        return np.array(rows)

    pen_z, pen_x = (near(sims.T) / 2, near(sims) / 2) if csls else (0, 0)
    expected = {}
    if direction != "backward":
        for i, row in enumerate(sims - pen_z):
            expected["forward", i] = (max(row), max(sims[i]))
    if direction != "forward":
        for j, row in enumerate(sims.T - pen_x):
            expected["backward", j] = (max(row), max(sims[:, j]))
    got = induction.induce(left, right, direction, csls).collect()
    assert len(got) == len(expected)
    for r in got:
        i = r["src_idx"] if r["direction"] == "forward" else r["trg_idx"]
        score, best = expected[r["direction"], i]
        assert r["score"] == pytest.approx(score)
        assert r["best"] == pytest.approx(best)


def test_ties_go_to_the_lower_id(vectors_of, route):
    left, right = vectors_of([[1.0, 0.0]] * 4), vectors_of([[1.0, 0.0]] * 60)
    got = induction.induce(left, right, "union").collect()
    assert {r["trg_idx"] for r in got if r["direction"] == "forward"} == {0}
    assert {r["src_idx"] for r in got if r["direction"] == "backward"} == {0}


def test_source_map_is_applied_in_the_scan(tables, route, rng):
    x, z, left, right = tables
    w = rng.normal(size=(3, 3))
    got = pairs.top_neighbours(left, right, left_map=w).collect()
    scores = x @ w @ z.T
    assert {r["idx"]: r["nbr"] for r in got} == dict(enumerate(scores.argmax(axis=1)))


def test_dropped_scores_are_zero_and_win_over_negative_ones(vectors_of, route):
    left, right = vectors_of([[-1.0, 0.0]] * 30), vectors_of([[1.0, 0.0]] * 40)
    got = induction.induce(left, right, "forward", keep=0.5).collect()
    assert {r["score"] for r in got} == {0.0}
    assert {r["best"] for r in got} == {-1.0}
    full = induction.induce(left, right, "forward", keep=1.0).collect()
    assert {r["score"] for r in full} == {-1.0}


def test_share_of_kept_scores():
    rows = hashing.id_keys(np.arange(700), hashing.ROW_STREAM, 3)
    cols = hashing.id_keys(np.arange(900), hashing.COL_STREAM, 3)
    for keep in (0.1, 0.4, 0.8):
        mask = hashing.keep_mask(rows, cols, keep)
        assert abs(mask.mean() - keep) < 0.004
        assert abs(np.corrcoef(mask[:, 1], mask[:, 2])[0, 1]) < 0.15
    other = hashing.keep_mask(hashing.id_keys(np.arange(700), hashing.ROW_STREAM, 4), cols, 0.4)
    assert 0.4 < (other == hashing.keep_mask(rows, cols, 0.4)).mean() < 0.6


def test_mix_is_the_same_as_a_column_and_in_numpy(spark):
    got = spark.range(1000).select(F.expr(hashing.mix_sql("id")).alias("h")).collect()
    expected = hashing.mix_array(np.arange(1000, dtype=np.uint32))
    assert [r["h"] for r in got] == expected.tolist()


def test_log_partition_survives_large_temperatures(tables, route):
    x, z, left, right = tables
    got = dict(pairs.log_partition(left, right, 300.0).collect())
    scaled = 300.0 * (x @ z.T)
    top = scaled.max(axis=0)
    expected = top + np.log(np.exp(scaled - top).sum(axis=0))
    assert [got[j] for j in range(len(z))] == pytest.approx(expected.tolist())


def test_inverse_sample_draws_with_replacement(tables):
    _, _, left, _ = tables
    drawn = translate.inverse_sample(left, 500, seed=1)
    counts = {r["idx"]: r["extra"] for r in drawn.collect()}
    assert sum(counts.values()) == 500
    assert len(counts) == 23 and max(counts.values()) > 1
    again = translate.inverse_sample(left.repartition(1), 500, seed=1).collect()
    assert {r["idx"]: r["extra"] for r in again} == counts


def test_top_rows_settles_ties_across_the_cut():
    scores = np.array([[1.0, 2.0, 2.0, 2.0, 0.0], [0.0, 0.0, 0.0, 0.0, 0.0]])
    assert tiles.top_rows(scores, 2).tolist() == [[1, 2], [0, 1]]


@pytest.mark.parametrize("in_order", [False, True])
def test_square_root_similarity(vectors_of, route, rng, in_order):
    x = rng.normal(size=(40, 4))
    single = vectors_of(x).withColumn("vec", F.col("vec").cast("array<float>"))
    assert seed.sqrt_similarity(single, in_order).count() == 40
    values, basis = np.linalg.eigh(x @ x.T)
    root = (basis * np.sqrt(np.clip(values, 0, None))) @ basis.T
    got = seed.sqrt_similarity(vectors_of(x), in_order).collect()
    rows = np.array([r["vec"] for r in sorted(got, key=lambda r: r["idx"])])
    assert np.allclose(rows, np.sort(root, axis=1) if in_order else root)


@pytest.mark.parametrize("listed", [1, 3, 100])
def test_rank_by_counting(vectors_of, rng, monkeypatch, listed):
    from xspace.operators import ranking

    # small groups: several cells, each with its share of the targets; short lists leave
    # most queries to be counted, long ones none
    monkeypatch.setattr(ranking, "STATE_CELLS", 40)
    monkeypatch.setattr(translate, "LISTED", listed)
    x, z = rng.integers(-2, 3, (29, 3)) * 1.0, rng.integers(-2, 3, (17, 3)) * 1.0
    queries = [0, 3, 4, 11, 28]
    src, trg = vectors_of(x), vectors_of(z)
    wanted = src.where(F.col("idx").isin(queries)).select(F.col("idx").alias("src_idx"))
    got = translate.translate(src, trg, wanted, "invnn").collect()
    sims = z @ x.T
    for r in got:
        q = r["src_idx"]
        ranked = []
        for t, row in enumerate(sims):
            above = sum(
                1 for i, s in enumerate(row) if s > row[q] or (s == row[q] and i < q)
            )
            ranked.append((above, -row[q], t))
        assert (r["score"], r["trg_idx"]) == (min(ranked)[0], min(ranked)[2])
    assert sorted(r["src_idx"] for r in got) == queries


def test_sizes_with_an_empty_first_table(vectors_of, rng):
    some = vectors_of(rng.normal(size=(5, 4)))
    none, full = pairs.measure(some.limit(0), some)
    assert (none.rows, none.bytes) == (0, 0) and (full.rows, full.bytes) == (5, 5 * 4 * 8)


def test_listed_queries_are_not_counted(vectors_of, rng, monkeypatch):
    from xspace.operators import ranking

    counted = []
    cells = ranking.rank_cells
    monkeypatch.setattr(
        ranking, "rank_cells", lambda asked, *t: counted.append(asked.count()) or cells(asked, *t)
    )
    x = rng.normal(size=(60, 6))
    x[50:] *= 0.001  # near the origin: on no target's list
    src, trg = vectors_of(x), vectors_of(rng.normal(size=(40, 6)))
    wanted = src.select(F.col("idx").alias("src_idx"))
    got = {r["src_idx"]: r for r in translate.translate(src, trg, wanted, "invnn").collect()}
    assert len(got) == 60 and len(counted) == 1 and 10 <= counted[0] <= 20
    sims = trg.orderBy("idx").toPandas()["vec"].apply(np.array).to_list() @ x.T
    ranks = np.argsort(np.argsort(-sims, axis=1, kind="stable"), axis=1)
    for q, r in got.items():
        best = min((ranks[t, q], -sims[t, q], t) for t in range(40))
        assert (r["score"], r["trg_idx"]) == (best[0], best[2])


@pytest.mark.parametrize("parts", [4, 40, 160])
def test_partial_states_do_not_grow_with_partitions(spark, vectors_of, rng, parts):
    x, z = rng.normal(size=(12, 4)), rng.normal(size=(400, 4))
    held, stream = vectors_of(x), vectors_of(z).repartition(parts)
    spark.conf.set(session.BROADCAST_BYTES_KEY, "1000")
    try:
        scan = pairs.PairScan(held, stream)
        raw = scan.run([tiles.TopK("left", 5), tiles.LogSumExp("left")])
        counts = dict(raw.groupBy("job").count().collect())
        tasks = session.parallelism(spark)
        assert counts[0] <= 12 * 5 * tasks and counts[1] <= 12 * tasks
        top = pairs.reduce_top(raw.where("job = 0"), 5).collect()
    finally:
        spark.conf.unset(session.BROADCAST_BYTES_KEY)
    assert {(r["idx"], r["rank"]): r["nbr"] for r in top} == {
        (i, k): j for i, row in enumerate(best_of(x @ z.T, 5)) for k, j in enumerate(row, 1)
    }


def scanned(jobs, held, block, own_mean=0):
    rows = tiles.scan_tiles(jobs, held, iter([block]), False, own_mean)
    return pa.Table.from_batches(list(rows)).to_pylist()


def test_held_rows_are_met_in_runs(rng, monkeypatch):
    x, z = rng.integers(-3, 4, (40, 3)) * 1.0, rng.integers(-3, 4, (23, 3)) * 1.0
    order = rng.permutation(23)
    held, block = (order, z[order], np.zeros(23)), (np.arange(40), x, np.zeros(40))
    jobs = [
        tiles.TopK("left"),
        tiles.TopK("left", 30),
        tiles.TopK("right", 4, penalty=True),
        tiles.LogSumExp("left", 0.5),
        tiles.LogSumExp("right", 0.5),
    ]
    whole = scanned(jobs, held, block, 6)
    monkeypatch.setattr(tiles, "HELD_ROWS", 5)
    monkeypatch.setattr(tiles, "TILE_CELLS", 35)
    parts = scanned(jobs, held, block, 6)
    assert len(parts) == len(whole)

    def settled(rows):
        keyed = sorted(rows, key=lambda r: (r["job"], r["idx"], -round(r["score"], 9), r["nbr"]))
        tops = [(r["job"], r["idx"], r["nbr"]) for r in keyed if r["job"] < 2]
        near = [(r["idx"], round(r["score"], 9), r["nbr"]) for r in keyed if r["job"] == 2]
        logs = [r["score"] + np.log(r["aux"]) for r in keyed if r["job"] > 2]
        return tops, near, logs

    (a, b, c), (d, e, f) = settled(whole), settled(parts)
    assert a == d and b == e and c == pytest.approx(f)


def test_tiles_do_not_grow_with_the_held_table(rng, monkeypatch):
    cells, scores = [], tiles._scores
    monkeypatch.setattr(
        tiles, "_scores", lambda job, sims, *a: cells.append(sims.size) or scores(job, sims, *a)
    )
    z = rng.normal(size=(70000, 2))
    held = (np.arange(len(z)), z, np.zeros(len(z)))
    block = (np.arange(200), rng.normal(size=(200, 2)), np.zeros(200))
    rows = scanned([tiles.TopK("left"), tiles.TopK("right")], held, block)
    assert max(cells) <= tiles.TILE_CELLS and len(rows) == 200 + 70000
