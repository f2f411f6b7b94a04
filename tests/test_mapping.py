import numpy as np
import pytest
from pyspark.sql import functions as F

from xspace.operators import lookup, mapping
from xspace.operators.normalize import normalize


def rows_of(df):
    return np.array([r["vec"] for r in sorted(df.collect(), key=lambda r: r["idx"])])


@pytest.fixture
def paired(spark, vectors_of, rng):
    x, z = rng.normal(size=(40, 5)), rng.normal(size=(30, 5))
    z[:20] += x[10:30]
    pairs = [(i + 10, i, 1 + i % 3) for i in range(20)] + [(0, 29, 2), (1, 29, 1)]
    bag = spark.createDataFrame(pairs, "src_idx bigint, trg_idx bigint, w bigint")
    left = np.repeat([p[0] for p in pairs], [p[2] for p in pairs])
    right = np.repeat([p[1] for p in pairs], [p[2] for p in pairs])
    return x, z, vectors_of(x), vectors_of(z), bag, x[left], z[right]


@pytest.mark.parametrize("limit", [None, "100"])
def test_joint_gram_counts_multiplicity(spark, paired, limit, monkeypatch):
    _, _, src, trg, bag, xd, zd = paired
    if limit:
        # too large to broadcast, and long enough to need salts
        spark.conf.set("spark.xspace.broadcastBytes", limit)
        monkeypatch.setattr(lookup, "FEW_ROWS", 0)
    gram = mapping.collect_joint_gram(src, trg, bag)
    spark.conf.unset("spark.xspace.broadcastBytes")
    assert np.allclose(gram.xx, xd.T @ xd)
    assert np.allclose(gram.zz, zd.T @ zd)
    assert np.allclose(gram.xz, xd.T @ zd)


def stepwise(x, z, xd, zd, p, q, src_back, trg_back, dims):
    """The advanced map one step after the other, on the data itself."""

    def whitening(m):
        _, s, vt = np.linalg.svd(m, full_matrices=False)
        return vt.T @ np.diag(1 / s) @ vt

    a, b = whitening(xd), whitening(zd)
    u, s, vt = np.linalg.svd((xd @ a).T @ (zd @ b))
    back = {
        "src": u.T @ np.linalg.inv(a) @ u,
        "trg": vt @ np.linalg.inv(b) @ vt.T,
        None: np.eye(len(s)),
    }
    xs = (x @ a @ u) * s**p @ back[src_back]
    zs = (z @ b @ vt.T) * s**q @ back[trg_back]
    return xs[:, :dims] @ zs[:, :dims].T


@pytest.mark.parametrize("src_back", [None, "src", "trg"])
@pytest.mark.parametrize("trg_back", [None, "src", "trg"])
def test_fused_map_equals_the_steps(paired, src_back, trg_back):
    x, z, src, trg, bag, xd, zd = paired
    gram = mapping.collect_joint_gram(src, trg, bag)
    for p, q, k in ((0.0, 0.0, 5), (0.5, 1.0, 5)):
        fit = mapping.fit_advanced(gram, True, p, q, src_back, trg_back, k)
        got = rows_of(mapping.apply_map(src, fit.src)) @ rows_of(
            mapping.apply_map(trg, fit.trg)
        ).T
        expected = stepwise(x, z, xd, zd, p, q, src_back, trg_back, k)
        assert np.allclose(got, expected)


def test_reduction_keeps_leading_dimensions(paired):
    x, z, src, trg, bag, xd, zd = paired
    gram = mapping.collect_joint_gram(src, trg, bag)
    fit = mapping.fit_advanced(gram, True, 0.5, 0.5, dim_reduction=2)
    assert fit.src.shape == fit.trg.shape == (5, 2)
    expected = stepwise(x, z, xd, zd, 0.5, 0.5, None, None, 2)
    assert np.allclose(x @ fit.src @ (z @ fit.trg).T, expected)


def test_least_squares_and_rotation(paired):
    _, _, src, trg, bag, xd, zd = paired
    gram = mapping.collect_joint_gram(src, trg, bag)
    assert np.allclose(
        mapping.fit_unconstrained(gram).src, np.linalg.lstsq(xd, zd, rcond=None)[0]
    )
    w = mapping.fit_orthogonal(gram).src
    assert np.allclose(w.T @ w, np.eye(5))
    u, _, vt = np.linalg.svd(zd.T @ xd)
    assert np.allclose(w, (u @ vt).T)


def test_too_few_pairs_are_named(spark, vectors_of, rng):
    src, trg = vectors_of(rng.normal(size=(9, 6))), vectors_of(rng.normal(size=(9, 6)))
    bag = spark.createDataFrame(
        [(i, i, 1) for i in range(3)], "src_idx bigint, trg_idx bigint, w bigint"
    )
    gram = mapping.collect_joint_gram(src, trg, bag)
    with pytest.raises(ValueError, match="spans 3 of 6"):
        mapping.fit_advanced(gram, True, src_dewhiten="src")
    with pytest.raises(ValueError, match="independent pairs"):
        mapping.fit_unconstrained(gram)
    assert np.isfinite(mapping.fit_advanced(gram, True).src).all()
    with pytest.raises(ValueError, match="no dictionary pair"):
        mapping.collect_joint_gram(src, trg, bag.where("false"))


def test_map_as_table(spark):
    fit = mapping.LinearMap(np.array([[1.0, 2.0], [3.0, 4.0]]))
    got = {(r["i"], r["j"]): r["v"] for r in fit.to_df(spark).collect()}
    assert got == {(0, 0): 1.0, (0, 1): 2.0, (1, 0): 3.0, (1, 1): 4.0}


def test_single_precision_is_kept(spark, vectors_of, rng):
    emb = vectors_of(rng.normal(size=(6, 3)))
    emb = emb.withColumn("vec", F.col("vec").cast("array<float>"))
    for df in (mapping.apply_map(emb, np.eye(3)), normalize(emb, ["unit", "center"])):
        assert df.schema["vec"].dataType.simpleString() == "array<float>"
        assert df.count() == 6


@pytest.mark.parametrize(
    "action", ["unit", "center", "unitdim", "centeremb", "none", "other"]
)
def test_normalisation(vectors_of, rng, action):
    m = rng.normal(size=(12, 4))
    m[3], m[:, 2] = 0, 0
    rows, dims = np.linalg.norm(m, axis=1), np.linalg.norm(m, axis=0)
    expected = {
        "unit": m / np.where(rows == 0, 1, rows)[:, None],
        "center": m - m.mean(axis=0),
        "unitdim": m / np.where(dims == 0, 1, dims),
        "centeremb": m - m.mean(axis=1)[:, None],
    }.get(action, m)
    assert np.allclose(rows_of(normalize(vectors_of(m), [action])), expected)


def test_row_wise_operators_take_streams(spark, vectors_of, rng, tmp_path):
    m = rng.normal(size=(10, 3))
    vectors_of(m).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("idx bigint, word string, vec array<double>")
    emb = stream.parquet(str(tmp_path / "in"))
    mapped = mapping.apply_map(normalize(emb, ["unit", "centeremb"]), 2 * np.eye(3))
    query = (
        mapped.writeStream.format("memory")
        .queryName("mapped")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    expected = 2 * (unit - unit.mean(axis=1)[:, None])
    assert np.allclose(rows_of(spark.table("mapped")), expected)


def test_lookup_splits_frequent_keys(spark):
    facts = spark.range(3000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 7 ELSE id % 50 END AS key"
    )
    table = spark.range(60).where("id != 9").selectExpr("id AS key", "id * 2 AS value")
    plain = facts.join(table, "key", "left").select("id", "key", "value")
    got = lookup.lookup(facts, table, "key", "left").select("id", "key", "value")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        map(tuple, plain.collect()), key=repr
    )
    inner = lookup.lookup(facts, table, "key")
    assert inner.count() == facts.where("key != 9").count()
