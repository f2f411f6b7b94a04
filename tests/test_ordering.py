import numpy as np
import pytest

from xspace.functions import ordering
from xspace.operators import similarity


@pytest.fixture(autouse=True)
def small_buckets(monkeypatch):
    monkeypatch.setattr(ordering, "BUCKET_ROWS", 4)


def test_redensify_keeps_order(spark):
    df = spark.range(100).where("id % 7 < 3").selectExpr("id AS idx", "id AS old")
    got = sorted((r["old"], r["idx"]) for r in ordering.redensify(df).collect())
    assert [i for _, i in got] == list(range(len(got)))


def test_carry_forward_crosses_buckets(spark):
    df = spark.range(40).selectExpr(
        "id AS n", "CASE WHEN id IN (3, 4, 22) THEN concat('h', id) END AS h"
    )
    got = {r["n"]: r["out"] for r in ordering.carry_forward(df, "n", "h", "out").collect()}
    expected, last = {}, None
    for n in range(40):
        last = f"h{n}" if n in (3, 4, 22) else last
        expected[n] = last
    assert got == expected


def average_rank(values):
    values = np.asarray(values)
    return [(values < v).sum() + ((values == v).sum() + 1) / 2 for v in values]


def test_average_ranks(spark, rng):
    rows = [(g, float(v)) for g in "ab" for v in rng.integers(0, 15, 60)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {
        (r["g"], r["v"]): r["rank"]
        for r in ordering.average_ranks(df, ["g"], "v", "rank").collect()
    }
    for g in "ab":
        values = [v for h, v in rows if h == g]
        for v, rank in zip(values, average_rank(values)):
            assert got[g, v] == rank


def test_correlations(spark, rng):
    rows = []
    for name in ("one", "two"):
        gold = rng.integers(0, 8, 40)
        for k, g in enumerate(gold):
            system = None if k % 9 == 0 else float(g + rng.integers(0, 5))
            rows.append((name, k, float(g), system))
    df = spark.createDataFrame(
        rows, "dataset string, line_no int, gold double, system double"
    )
    for r in similarity.correlations(df).collect():
        used = [(g, s) for d, _, g, s in rows if d == r["dataset"] and s is not None]
        gold, system = map(np.array, zip(*used))
        assert r["scored"] == len(used) and r["oov"] == 40 - len(used)
        assert r["coverage"] == pytest.approx(len(used) / 40)
        assert r["pearson"] == pytest.approx(np.corrcoef(gold, system)[0, 1])
        ranks = np.corrcoef(average_rank(gold), average_rank(system))[0, 1]
        assert r["spearman"] == pytest.approx(ranks)


def test_averages_need_two_datasets_and_known_names(spark):
    schema = "dataset string, coverage double, pearson double, spearman double"
    rows = [("a", 1.0, 0.5, 0.4), ("b", 0.5, 0.1, 0.2)]
    two = spark.createDataFrame(rows, schema)
    got = {r["name"]: tuple(r)[1:] for r in similarity.summarise(two, ["a"], ["x"]).collect()}
    assert got == {"sim": (1.0, 0.5, 0.4), "all": pytest.approx((0.75, 0.3, 0.3))}
    one = spark.createDataFrame(rows[:1], schema)
    assert similarity.summarise(one, ["a"]).count() == 0
