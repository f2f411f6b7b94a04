import numpy as np
import pytest

from xspace.operators import analogy, seed, translate
from xspace.plans import jobs
from xspace.plans.config import MapConfig
from xspace.sources import text


def write_vectors(path, words, m):
    lines = [f"{len(m)} {m.shape[1]}"]
    lines += [w + " " + " ".join("%.17g" % x for x in row) for w, row in zip(words, m)]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.fixture
def languages(tmp_path, rng):
    n, d = 80, 8
    x = rng.normal(size=(n, d)) * np.linspace(2, 0.5, d)
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    z = x @ q + 0.01 * rng.normal(size=(n, d))
    kinds = ["{0}", "id{0}", "s{0}"]
    src = [kinds[i % 3].format(i) for i in range(n)]
    trg = [w.replace("s", "t") for w in src]
    order = rng.permutation(n)
    paths = {
        "src": write_vectors(tmp_path / "src.txt", src, x),
        "trg": write_vectors(tmp_path / "trg.txt", [trg[i] for i in order], z[order]),
    }
    train = tmp_path / "train.txt"
    train.write_text("".join(f"{src[i]} {trg[i]}\n" for i in range(0, n, 2)))
    test = tmp_path / "test.txt"
    test.write_text("".join(f"{src[i]}\t{trg[i]}\n" for i in range(1, n, 2)) + "zzz t2\n")
    return paths, str(train), str(test), tmp_path


SETTINGS = {
    "supervised": {},
    "semi_supervised": dict(csls=5, stochastic_initial=1.0, stochastic_interval=1),
    "identical": dict(csls=5, stochastic_initial=1.0, stochastic_interval=1),
    "unsupervised": dict(csls=5, stochastic_initial=1.0, stochastic_interval=1),
    "aaai2018": dict(dim_reduction=6),
    "acl2017": {},
    "acl2017_seed": dict(precision="fp64"),
    "emnlp2016": {},
}


@pytest.mark.parametrize("preset", list(SETTINGS))
def test_mapping_job_for_each_preset(spark, languages, preset):
    paths, train, test, folder = languages
    outputs = [str(folder / f"{preset}-{side}") for side in ("src", "trg")]
    log = str(folder / f"{preset}-log")
    config = MapConfig.preset(preset, **SETTINGS[preset])
    learned = jobs.map_job(
        spark,
        paths["src"],
        paths["trg"],
        *outputs,
        config,
        dictionary=train,
        validation=test,
        log=log,
    )
    row = jobs.translation_job(spark, *outputs, test, "csls", neighborhood=5).head()
    assert row["coverage"] == pytest.approx(40 / 41)
    assert row["accuracy"] == 1.0
    lines = [r[0].split("\t") for r in spark.read.text(log).collect()]
    assert len(lines) == len(learned.log_rows) == (0 if not config.self_learning else len(lines))
    if config.self_learning:
        assert [len(f) for f in lines] == [6] * len(lines)
        assert lines[-1][3] == "100.000000"
    width = text.read_word2vec(spark, outputs[0]).selectExpr("size(vec)").head()[0]
    assert width == (6 if preset == "aaai2018" else 8)


def test_iterations_are_logged_as_they_end_and_unknown_pairs_returned(spark, languages):
    paths, train, test, folder = languages
    config = MapConfig.preset("semi_supervised", **SETTINGS["semi_supervised"])
    with open(train, "a") as file:
        file.write("zzz t2\n")

    def run(name, on_iteration=None):
        out = [str(folder / f"{name}-{side}") for side in ("src", "trg")]
        log = str(folder / f"{name}-log")
        return jobs.map_job(
            spark, paths["src"], paths["trg"], *out, config,
            dictionary=train, validation=test, log=log, on_iteration=on_iteration,
        )

    learned = run("whole")
    assert [tuple(r) for r in learned.oov.collect()] == [("zzz", "t2", 1)]
    turns = spark.read.text(str(folder / "whole-log-turns")).orderBy("iteration").collect()
    assert [r["iteration"] for r in turns] == list(range(1, len(learned.log_rows) + 1))
    assert {r["value"] for r in turns} == {r[0] for r in spark.read.text(str(folder / "whole-log")).collect()}

    def stop(row):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        run("killed", stop)
    left = spark.read.text(str(folder / "killed-log-turns")).collect()
    assert [r["iteration"] for r in left] == [1] and left[0]["value"].startswith("1	")


@pytest.mark.parametrize("retrieval", translate.METHODS)
def test_retrieval_methods_from_files(spark, languages, retrieval):
    paths, _, test, folder = languages
    row = jobs.translation_job(
        spark, paths["src"], paths["src"], test, retrieval, precision="fp64"
    ).head()
    # a table against itself: only words common to both sides can be looked up
    assert row["accuracy"] == 1.0 and row["coverage"] < 1


def test_unknown_names_are_refused(spark, vectors_of, rng):
    emb = vectors_of(rng.normal(size=(4, 3)))
    with pytest.raises(ValueError, match="method"):
        translate.translate(emb, emb, emb.selectExpr("idx AS src_idx"), "best")
    with pytest.raises(ValueError, match="dictionary"):
        jobs.build_seed(emb, emb, MapConfig())
    with pytest.raises(ValueError, match="preset"):
        MapConfig.preset("magic")


def test_seeds_weigh_copies_and_report_unknown_words(spark, vectors_of):
    words = ["a", "b", "7", "a"]
    src = vectors_of(np.eye(4), words)
    trg = vectors_of(np.eye(4), ["x", "7", "b", "٣"])
    schema = "src string, trg string"
    raw = spark.createDataFrame([("a", "x"), ("a", "x"), ("q", "x"), ("a", "y")], schema)
    assert [tuple(r) for r in seed.seed_from_pairs(raw, src, trg).collect()] == [(3, 0, 2)]
    assert sorted(map(tuple, seed.oov_pairs(raw, src, trg).collect())) == [
        ("a", "y", 1),
        ("q", "x", 1),
    ]
    same = {(r["src_idx"], r["trg_idx"]) for r in seed.seed_identical(src, trg).collect()}
    assert same == {(1, 2), (2, 1)}
    numerals = seed.seed_numerals(src, trg).collect()
    assert [(r["src_idx"], r["trg_idx"]) for r in numerals] == [(2, 1)]
    assert [r["src"] for r in translate.oov_words(raw, src, trg).collect()] == ["q"]
    assert seed.unsupervised_size(src, trg.where("idx < 3"), 0) == 3
    assert seed.unsupervised_size(src, trg, 2) == 2


def test_normalisation_job(spark, tmp_path, rng):
    m = rng.normal(size=(9, 3))
    source = write_vectors(tmp_path / "in.txt", [f"w{i}" for i in range(9)], m)
    jobs.normalize_job(spark, source, str(tmp_path / "out"), ["unit", "center"])
    got = text.read_word2vec(spark, str(tmp_path / "out")).orderBy("idx").collect()
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    expected = unit - unit.mean(axis=0)
    assert np.allclose([r["vec"] for r in got], expected, atol=1e-6)


def test_similarity_job(spark, tmp_path, rng):
    m = rng.normal(size=(20, 4))
    words = [f"w{i}" for i in range(20)]
    source = write_vectors(tmp_path / "v.txt", words, m)
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    files = []
    for name in ("one", "two"):
        pairs = [(i, int(rng.integers(20)), rng.normal()) for i in range(20)]
        lines = [f"W{i}\tw{j}\t{unit[i] @ unit[j] + 0.1 * e:.12f}" for i, j, e in pairs]
        (tmp_path / f"{name}.txt").write_text("\n".join(lines + ["w1\tnope\t1"]) + "\n")
        files.append(str(tmp_path / f"{name}.txt"))
    each, total = jobs.similarity_job(
        spark, files, source, lowercase=True, sim=["one"], precision="fp64"
    )
    rows = {r["dataset"]: r for r in each.collect()}
    assert set(rows) == {"one", "two"}
    assert all(r["oov"] == 1 and r["pearson"] > 0.9 for r in rows.values())
    means = {r["name"]: r["pearson"] for r in total.collect()}
    assert means["sim"] == pytest.approx(rows["one"]["pearson"])
    both = (rows["one"]["pearson"] + rows["two"]["pearson"]) / 2
    assert set(means) == {"sim", "all"} and means["all"] == pytest.approx(both)
    filled, _ = jobs.similarity_job(spark, files[:1], source, lowercase=True, backoff=0.0)
    assert filled.head()["coverage"] == 1.0


def test_analogy_job(spark, tmp_path):
    base = np.eye(6)[:, :6]
    step = np.array([0.3, 0.3, 0.3, 0.3, 0.3, 0.9])
    m = np.vstack([base[:5], base[:5] + step])
    words = [f"b{i}" for i in range(5)] + [f"d{i}" for i in range(5)]
    source = write_vectors(tmp_path / "v.txt", words, m)
    lines = [": sem one"]
    lines += [f"B{i} d{i} b{j} d{j}" for i in range(5) for j in range(5) if i != j]
    lines += [": gram two", "b0 d0 b1 nope", "b0 d0 b1", ": gram three", "b1 d1 b2 d2"]
    (tmp_path / "q.txt").write_text("\n".join(lines) + "\n")
    each, total = jobs.analogy_job(spark, source, str(tmp_path / "q.txt"), lowercase=True)
    rows = {r["category"]: r for r in each.collect()}
    assert rows["sem one"]["answered"] == 20 and rows["sem one"]["accuracy"] == 1.0
    assert (rows["gram two"]["oov"], rows["gram two"]["accuracy"]) == (1, None)
    kinds = {
        r["is_syntactic"]: r["coverage"]
        for r in total.collect()
        if r["level"] == "kind"
    }
    assert kinds == {False: 1.0, True: 0.5}
    assert {r["refused_lines"] for r in total.collect()} == {1}


def test_own_words_score_minus_one(spark, vectors_of):
    # every other word scores below -1, so the lowest of the question's own wins
    emb = vectors_of(
        [[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [0.6, -0.8], [0.8, -0.6], [0.7, -0.71]]
    )
    schema = "line_no bigint, category string, is_syntactic boolean, a string, b string, c string, d string"
    asked = spark.createDataFrame(
        [(1, "x", False, "w0", "w1", "w2", "w3"), (2, "x", False, "w0", "w1", "w9", "w3")],
        schema,
    )
    resolved = analogy.resolve_questions(asked, emb)
    solved = {r["line_no"]: r for r in analogy.solve_analogies(resolved, emb).collect()}
    assert solved[1]["answer"] == 0
    assert solved[2]["known"] is False and solved[2]["answer"] is None
