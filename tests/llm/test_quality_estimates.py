"""The covariance-determinant verdicts against NumPy, group by group."""

import math
import random

import numpy as np
import pytest

pytest.importorskip("xspace.llm.queries")

from xspace.llm import quality  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string"


def prose(rng, n, vocabulary=400):
    return ". ".join(" ".join(f"w{int(rng.random() ** 2 * vocabulary)}" for _ in range(12)) for _ in range(n))


def corpus():
    rng, rows = random.Random(11), []
    for i in range(420):
        t = prose(rng, rng.randint(4, 30))
        if i % 9 == 0:
            t = " ".join(w + "$$#" for w in t.split())
        if i % 13 == 0:
            t = t.upper()
        lang = ("en", "en", "en", "de", None)[i % 5]
        # one source with most rows, small ones, one row alone
        source = "hot" if i % 3 else f"s{i % 4}" if i else "alone"
        rows.append((i, t, lang, source))
    rows += [(500, None, "en", "hot"), (501, "few words", "en", "hot"), (502, " ".join(["a b c d e f g h"] * 200), "en", "hot"), (None, rows[1][1], None, None), (1, *rows[1][1:])]
    return rows


def vector(text):
    ws = (text or "").encode().split()
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    chars = sum(len(w.decode()) for w in ws)
    grams = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    twice = {i for i, g in enumerate(grams) if grams.count(g) > 1} if len(set(grams)) < len(grams) else set()
    repeat = len({i + k for i in twice for k in range(8)})
    if len(ws) < 20 or 100 * repeat > 30 * len(ws):
        return None
    x = [
        math.log(chars / len(ws)), math.log(1 + 100 * sum(c in "#*$%&|<>" for c in text) / chars),
        math.log(1 + 10 * sum(c.isupper() for c in text) / chars), (len(lines) - len(set(lines))) / len(lines), repeat / len(ws),
        math.log(len(ws) / (1 + sum(c in ".?!" for c in text))),
    ]
    return [math.floor(quality.GRID * v + 0.5) for v in x]


def estimate(x, floors, share=0.75, steps=4):
    """Centre and covariance of one group by concentration steps."""
    d = len(floors)
    factor = share / quality.chi2_cdf(quality.chi2_quantile(share, d), d + 2)
    at = lambda q: np.array([np.sort(c)[math.ceil(q * len(x)) - 1] for c in x.T], float)
    m = at(0.5) / quality.GRID
    s = np.diag(((at(0.75) - at(0.25)) / 1.349 / quality.GRID) ** 2 + floors**2)
    for _ in range(steps):
        d2 = distance(x, m, s)
        bins = np.floor(np.log2(1 + d2) * quality.STEPS_PER_DOUBLING)
        cut = np.sort(bins)[math.ceil(share * len(x)) - 1]
        near = x[bins <= cut] / quality.GRID
        m = near.mean(axis=0)
        s = factor * np.cov(near.T, bias=True) + np.diag(floors**2)
    return m, s


def distance(x, m, s):
    y = x / quality.GRID - m
    return np.einsum("ij,ij->i", y @ np.linalg.inv(s), y)


def shrunk(own, up, n, constant=200):
    w, off = n / (n + constant), own[0] - up[0]
    return w * own[0] + (1 - w) * up[0], w * own[1] + (1 - w) * up[1] + w * (1 - w) * np.outer(off, off)


@pytest.fixture(scope="module")
def expected():
    rows = corpus()
    floors = np.array([s[2] for s in quality.STATISTICS])
    vectors = [vector(t) for _, t, _, _ in rows]
    usable = [k for k, v in enumerate(vectors) if v]
    x = lambda ks: np.array([vectors[k] for k in ks])
    top, limit, out = estimate(x(usable), floors), quality.chi2_quantile(0.9999, 6), {}
    for lang in {rows[k][2] for k in usable}:
        own = [k for k in usable if rows[k][2] == lang]
        by_lang = shrunk(estimate(x(own), floors), top, len(own))
        for source in {rows[k][3] for k in own}:
            few = [k for k in own if rows[k][3] == source]
            d2 = distance(x(few), *shrunk(estimate(x(few), floors), by_lang, len(few)))
            out |= dict(zip(few, zip(d2, d2 <= limit)))
    return sorted(((r[0], *out.get(k, (None, False))) for k, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize("shipped", [True, False])
def test_verdicts_equal_numpy(spark, expected, shipped):
    if not shipped:
        spark.conf.set("spark.xspace.broadcastBytes", "100")
    try:
        got = quality.quality_rules(spark.createDataFrame(corpus(), SCHEMA).repartition(3)).collect()
    finally:
        spark.conf.unset("spark.xspace.broadcastBytes")
    got = sorted(((r.doc_id, r.distance2, r.kept) for r in got), key=repr)
    assert len(got) == len(expected)
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or 0.0)
    for a, b in zip(sorted(got, key=order), sorted(expected, key=order)):
        assert a[0] == b[0] and a[2] == b[2] and (a[1] is None) == (b[1] is None)
        assert a[1] is None or abs(a[1] - b[1]) < 1e-6 * (1 + b[1])
    assert sum(not k for _, d, k in got if d is not None) > 20
