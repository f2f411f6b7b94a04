import math

import numpy as np
import pytest

from xspace.operators import induction, translate
from xspace.plans.config import PRESETS, MapConfig
from xspace.plans.self_learning import LoopState, Validation, learn_map


def walk(config, objectives):
    """Keep probability of each iteration until the loop says it is the last."""
    state, kept = LoopState.start(config), []
    for objective in objectives:
        state = state.begin(config)
        if state.last_pass:
            return kept
        kept.append(state.keep)
        state = state.finish(objective, config)
    return kept


def test_schedule_without_gain_after_the_first_iteration():
    config = MapConfig(self_learning=True)
    kept = walk(config, [1.0] * 400)
    # the 256th pass only fits the final map
    assert [kept.count(p) for p in (0.1, 0.2, 0.4, 0.8, 1.0)] == [51] * 5
    assert len(kept) == 255


def test_schedule_restarts_on_a_gain_of_the_threshold():
    config = MapConfig(
        self_learning=True, stochastic_interval=2, threshold=0.5, stochastic_initial=0.4
    )
    # gains at 1, 2 and 5; 2.4 and 2.9 are too small
    kept = walk(config, [1.0, 2.0, 2.4, 2.4, 2.9, 2.9] + [2.9] * 20)
    assert kept[:5] == [0.4, 0.4, 0.4, 0.4, 0.8]
    assert kept[5] == 0.8
    assert kept[-1] == 1.0


def test_without_self_learning_the_first_pass_is_the_last():
    assert walk(MapConfig(), [1.0, 2.0]) == []


def test_presets_and_overrides():
    assert len(PRESETS) == 9
    for name in PRESETS:
        MapConfig.preset(name)
    blind = MapConfig.preset("unsupervised")
    assert (blind.init, blind.unsupervised_vocab, blind.csls) == ("unsupervised", 4000, 10)
    assert blind == MapConfig.preset("acl2018")
    assert (blind.vocabulary_cutoff, blind.direction, blind.seed) == (20000, "union", 0)
    assert blind.normalize == ("unit", "center", "unit")
    old = MapConfig.preset("aaai2018")
    assert (old.src_reweight, old.trg_reweight, old.self_learning) == (0.0, 1.0, False)
    first = MapConfig.preset("acl2017")
    assert (first.init, first.map_type, first.direction) == ("numerals", "orthogonal", "forward")
    assert (first.stochastic_initial, first.stochastic_interval) == (1.0, 1)
    assert MapConfig.preset("acl2017_seed").init == "dictionary"
    assert not MapConfig.preset("emnlp2016").self_learning
    assert MapConfig.preset("supervised", csls=3, whiten=True).csls == 3
    assert MapConfig.preset("identical").with_options(seed=4).seed == 4


@pytest.mark.parametrize(
    "bad",
    [
        dict(src_dewhiten="src"),
        dict(direction="sideways"),
        dict(init="guess"),
        dict(map_type="cubic"),
        dict(precision="fp16"),
        dict(normalize=("length",)),
    ],
)
def test_options_that_do_not_fit(bad):
    with pytest.raises(ValueError):
        MapConfig(**bad).validate()


@pytest.fixture
def planted(vectors_of, spark, rng):
    n, d = 60, 6
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    order = rng.permutation(n)
    z = np.empty_like(x)
    z[order] = x @ q
    seed = spark.createDataFrame(
        [(i, int(order[i]), 1) for i in range(12)],
        "src_idx bigint, trg_idx bigint, w bigint",
    )
    return vectors_of(x), vectors_of(z), seed, order, q


@pytest.mark.parametrize("direction", ["forward", "backward", "union"])
def test_learning_recovers_a_rotation(planted, route, direction):
    if route == "grid" and direction != "union":
        pytest.skip("the union covers both directions of the grid")
    src, trg, seed, order, q = planted
    config = MapConfig(
        self_learning=True,
        map_type="orthogonal",
        direction=direction,
        csls=3,
        stochastic_initial=0.5,
        stochastic_interval=1,
    )
    learned = learn_map(src, trg, seed, config)
    assert np.allclose(learned.linear.src, q)
    pairs = {(r["src_idx"], r["trg_idx"]): r["w"] for r in learned.dictionary.collect()}
    weight = 2 if direction == "union" else 1
    assert pairs == {(i, int(j)): weight for i, j in enumerate(order)}
    iterations = [row[0] for row in learned.log_rows]
    assert iterations == list(range(1, len(iterations) + 1))
    assert learned.log_rows[-1][1] == pytest.approx(100)
    assert learned.log().count() == len(iterations)


def test_learning_is_repeatable_under_another_layout(planted):
    src, trg, seed, *_ = planted
    config = MapConfig(
        self_learning=True, vocabulary_cutoff=50, stochastic_initial=0.3, stochastic_interval=1
    )
    one = learn_map(src, trg, seed, config)
    two = learn_map(src.repartition(1), trg.repartition(5), seed, config)
    assert [r[1] for r in one.log_rows] == pytest.approx([r[1] for r in two.log_rows])


def test_validation_measures(planted, spark):
    src, trg, seed, order, q = planted
    wrong = spark.createDataFrame([(3, int(order[4]))], "src_idx bigint, trg_idx bigint")
    gold = seed.select("src_idx", "trg_idx").where("src_idx < 3").unionAll(wrong)
    row = Validation(src, trg, gold, 0.8).measure(q).head()
    assert row["accuracy"] == pytest.approx(0.75)
    assert row["coverage"] == 0.8
    x, z = (
        {r["idx"]: np.array(r["vec"]) for r in t.collect()} for t in (src, trg)
    )
    last = x[3] @ q @ z[int(order[4])]
    assert row["similarity"] == pytest.approx((3 + last) / 4)


def test_objective_is_the_mean_over_directions(planted):
    src, trg, *_ = planted
    x = np.array([r["vec"] for r in src.orderBy("idx").collect()])
    z = np.array([r["vec"] for r in trg.orderBy("idx").collect()])
    sims = x @ z.T
    forward, backward = sims.max(axis=1).mean(), sims.max(axis=0).mean()
    for name, expected in (
        ("forward", forward),
        ("backward", backward),
        ("union", (forward + backward) / 2),
    ):
        # neither hubness correction nor dropout enters the objective
        found = induction.induce(src, trg, name, csls=5, keep=0.4)
        assert math.isclose(induction.objective(found).head()[0], expected)


def test_empty_gold_gives_null(planted, spark):
    src, trg, *_ = planted
    raw = spark.createDataFrame([("nope", "none")], "src string, trg string")
    gold, coverage = translate.gold_dictionary(raw, src, trg)
    assert tuple(coverage.head()) == (0, 1, 0.0)
    row = translate.translation_accuracy(translate.translate(src, trg, gold), gold).head()
    assert tuple(row) == (0, 0, None)
    none = raw.where("false")
    assert translate.gold_dictionary(none, src, trg)[1].head()["coverage"] is None
