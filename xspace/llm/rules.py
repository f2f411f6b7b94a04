"""Quality classifier: a sparse ensemble of rules over text statistics."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import learnable, settle
from .quality import text_counts

# Statistics of the rules: name and SQL over the counts; a text without words has 0 everywhere.
STATISTICS = {
    "n_words": "double(n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "stops": "n_stops / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
    "distinct": "n_distinct / greatest(n_words, 1)",
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_stops"]

Rule = tuple[tuple[str, bool, float], ...]  # (statistic, above, threshold) joined by "and"


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, statistics...) of every whole text, by DataFrame functions."""
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    spread = source.withColumn(
        "n_distinct",
        F.size(F.array_distinct(F.split(F.coalesce(F.lower("_text"), F.lit("")), r"[\x20\x09-\x0D.,]+"))),
    )
    counts = text_counts(spread, "_text", keep=("_id", "n_distinct"))
    return counts.select(F.col("_id").alias("id"), *[F.expr(sql).alias(name) for name, sql in STATISTICS.items()])


# -- rules from trees --------------------------------------------------------------


def _grow(x, target, weight, cuts, names, depth: int, least: int, path: Rule, found: dict) -> np.ndarray:
    """Values of a regression tree at the rows; every node but the root adds its path to ``found``."""
    value = np.full(len(x), np.average(target, weights=weight) if weight.sum() else 0.0)
    if path:
        found[_simplified(path)] = None
    if depth == 0 or len(x) < 2 * least:
        return value
    best, split = 0.0, None
    total, mass = (target * weight).sum(), weight.sum()
    for j, name in enumerate(names):
        for cut in cuts[name]:
            above = x[:, j] > cut
            n = int(above.sum())
            if n < least or len(x) - n < least:
                continue
            s, w = (target[above] * weight[above]).sum(), weight[above].sum()
            if w <= 0 or mass - w <= 0:
                continue
            gain = s * s / w + (total - s) ** 2 / (mass - w) - total**2 / mass
            if gain > best + 1e-12:
                best, split = gain, (j, name, cut)
    if split is None:
        return value
    j, name, cut = split
    above = x[:, j] > cut
    for side in (True, False):
        here = above == side
        value[here] = _grow(x[here], target[here], weight[here], cuts, names, depth - 1, least, (*path, (name, side, float(cut))), found)
    return value


def _simplified(path: Rule) -> Rule:
    """Of several bounds of one statistic on one side only the tightest."""
    tight: dict = {}
    for name, above, cut in path:
        old = tight.get((name, above))
        tight[name, above] = cut if old is None else (max if above else min)(old, cut)
    return tuple(sorted((name, above, cut) for (name, above), cut in tight.items()))


def grow_rules(x: np.ndarray, y: np.ndarray, names, trees=24, depth=3, cuts_per_statistic=24, seed=0) -> list[Rule]:
    """Paths of boosted trees, each grown on a random half of the rows to the ensemble's residuals."""
    rng = np.random.default_rng(seed)
    shares = np.linspace(0, 1, cuts_per_statistic + 2)[1:-1]
    cuts = {n: np.unique(np.quantile(x[:, j], shares)) for j, n in enumerate(names)}
    found: dict[Rule, None] = {}
    margin = np.zeros(len(y))
    for _ in range(trees):
        part = rng.permutation(len(y))[: max(2, len(y) // 2)]
        p = 1 / (1 + np.exp(-margin))
        curve = np.maximum(p * (1 - p), 1e-3)
        tree: dict[Rule, None] = {}
        step = _grow(x[part], ((y - p) / curve)[part], curve[part], cuts, names, depth, max(3, len(part) // 200), (), tree)
        found |= tree
        margin[part] += 0.3 * np.clip(step, -4, 4)
    return list(found)


def holds(rules: list[Rule], x: np.ndarray, names) -> np.ndarray:
    place = {n: j for j, n in enumerate(names)}
    out = np.ones((len(x), len(rules)))
    for k, rule in enumerate(rules):
        for name, above, cut in rule:
            out[:, k] *= (x[:, place[name]] > cut) == above
    return out


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 1500) -> tuple[np.ndarray, float]:
    """Weights and intercept of L1-penalised logistic regression, by accelerated proximal gradient."""
    n, k = r.shape
    w = v = np.zeros(k)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    b = c = np.log(share / (1 - share))
    top = np.linalg.norm(np.hstack([r, np.ones((n, 1))]), 2) ** 2 / (4 * n) if k else 0.25
    t = 1.0
    for _ in range(rounds):
        off = 1 / (1 + np.exp(-(r @ v + c))) - y
        new = v - r.T @ off / n / top
        new = np.sign(new) * np.maximum(np.abs(new) - penalty / top, 0)
        new_b = c - off.mean() / top
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    return w, float(b)


class RuleEnsemble:
    """Weighted rules; ``score`` is a Spark column over the statistics."""

    def __init__(self, rules: list[Rule], weights: list[float], intercept: float):
        self.rules, self.weights, self.intercept = rules, weights, intercept

    def score(self) -> Column:
        def holds_(rule: Rule) -> Column:
            parts = [F.col(n) > cut if above else F.col(n) <= cut for n, above, cut in rule]
            return reduce(lambda a, c: a & c, parts)

        terms = [F.when(holds_(r), F.lit(float(w))).otherwise(0.0) for r, w in zip(self.rules, self.weights)]
        total = reduce(lambda a, c: a + c, terms, F.lit(self.intercept))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def train(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
          most_rows: int = 20_000, penalty: float = 2e-3) -> RuleEnsemble:
    """Fit on at most ``most_rows`` labelled rows that are not held out, chosen by a hash of their ids.

    Rows without a label or without statistics are left out. Without any row every
    score is 0.5; with one class alone it is that class's share, cut to 0.001 .. 0.999.
    """
    names = list(STATISTICS)
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
    known = stats.join(marked.where(learnable("id") & F.col("y").isNotNull()), "id")
    rows = known.orderBy(F.xxhash64("id"), "id", "y").limit(most_rows).select("y", *names).toPandas()
    if rows.empty:
        return RuleEnsemble([], [], 0.0)
    x, y = rows[names].to_numpy(float), rows["y"].to_numpy(float)
    rules = grow_rules(x, y, names)
    weights, intercept = lasso_logistic(holds(rules, x, names), y, penalty)
    used = np.flatnonzero(np.abs(weights) > 1e-6)
    return RuleEnsemble([rules[k] for k in used], [float(weights[k]) for k in used], intercept)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every text; null and empty texts have statistics of 0.

    Repeated rows score alike; an empty table gives no rows.
    """
    stats = settle(statistics(docs, id_col, text_col))
    model = train(stats, labels, id_col=id_col)
    scored = stats.select("id", model.score().alias("score"))
    return scored.select(
        F.col("id").alias(id_col),
        (~learnable("id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
