"""Quality rules: robust multivariate outliers per language and source.

Only DataFrame functions. Each text becomes a few counts; transformed shares of them
form a vector; per group of (language, source) a minimum covariance determinant (MCD)
estimate gives the centre and shape of ordinary texts, and texts too far from it by
Mahalanobis distance are rejected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import session
from ..operators.lookup import lookup
from .common import JOIN_BYTES, settle, words_of

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"

# The vector: name, SQL over the counts, and the spread below which differences of a
# statistic are not held against a text (it also keeps the covariance regular where
# most texts of a group share one value).
STATISTICS = (
    ("word_length", "ln(word_chars / n_words)", 0.15),
    ("symbols", "ln(1 + 100 * n_symbols / word_chars)", 0.25),
    ("upper", "ln(1 + 10 * n_upper / word_chars)", 0.10),
    ("dup_lines", "n_dup_lines / n_lines", 0.10),
    ("repeats", "n_repeat_words / n_words", 0.10),
    ("sentence", "ln(n_words / (1 + n_stops))", 0.50),
)
GRID = 1024  # statistics are kept as multiples of 1 / GRID, so that sums are exact
STEPS_PER_DOUBLING = 32  # of the histogram of distances


# -- counts ------------------------------------------------------------------------


def _dropped(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def text_counts(docs: DataFrame, text_col: str = "text", keep=()) -> DataFrame:
    """Counts of every whole text, all long: those of the base rules and of the vector."""
    start = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    split = start.withColumn("_w", words_of(F.col("_t")))
    # windows of WINDOW words, by hash
    hashed = split.withColumn(
        "_h",
        F.expr(
            f"CASE WHEN size(_w) >= {WINDOW} THEN transform(sequence(0, size(_w) - {WINDOW}),"
            f" i -> xxhash64(slice(_w, i + 1, {WINDOW}))) END"
        ),
    )
    line = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = hashed.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.aggregate("_w", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        _dropped(F.col("_t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.length("_t") - F.length(F.regexp_replace("_t", r"\p{Lu}", ""))).cast("long").alias("n_upper"),
        _dropped(F.col("_t"), ".?!").cast("long").alias("n_stops"),
        line.alias("_l"),
        # windows matter only where some window comes twice
        F.expr(
            "CASE WHEN size(array_distinct(_h)) < size(_h)"
            " THEN sort_array(transform(_h, (x, i) -> struct(x AS h, i AS i))) END"
        ).alias("_s"),
    )
    twice = counted.withColumn(
        "_p",
        F.expr(
            "sort_array(filter(transform(_s, (x, k) -> IF("
            " (k > 0 AND _s[greatest(k - 1, 0)].h = x.h)"
            " OR (k < size(_s) - 1 AND _s[least(k + 1, size(_s) - 1)].h = x.h), x.i, -1)), p -> p >= 0))"
        ),
    )
    covered = (
        f"aggregate(transform(_p, (p, k) -> IF(k = size(_p) - 1, {WINDOW},"
        f" least({WINDOW}, _p[least(k + 1, size(_p) - 1)] - p))), 0L, (a, x) -> a + x)"
    )
    return twice.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr(f"CASE WHEN _p IS NULL OR size(_p) = 0 THEN 0L ELSE {covered} END").alias(
            "n_repeat_words"
        ),
        "n_upper",
        "n_stops",
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


# -- estimates ---------------------------------------------------------------------


def chi2_cdf(x: float, k: int) -> float:
    """Chi-squared distribution function, by its series."""
    a, half = k / 2, x / 2
    if half <= 0:
        return 0.0
    term = total = 1 / a
    n = 1
    while term > total * 1e-15:
        term *= half / (a + n)
        total += term
        n += 1
    return min(1.0, total * math.exp(-half + a * math.log(half) - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 10.0 * k + 200
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


# A text's vector is kept as its monomials 1, x_i, x_i * x_j (j <= i), in grid units: their
# sums are a group's moments, and a squared distance is their product with one coefficient
# row. Matrices are arrays, row after row. A level is 2 for (language, source), 1 for the
# language, 0 for the whole table.
LEVELS = {2: "_g", 1: "_g1", 0: "_g0"}


def _keys() -> list[Column]:
    """``_g``: (lang, source), ``_g1``: its language, ``_g0``: the whole table."""
    key = lambda level, *cols: F.coalesce(F.to_json(F.struct(F.lit(level).alias("n"), *cols)), F.lit(""))
    return [key(2, "lang", "source").alias("_g"), key(1, "lang").alias("_g1"), key(0).alias("_g0")]


def monomials(x: list[Column]) -> Column:
    one = F.lit(1).cast("long")
    return F.array(one, *x, *[x[i] * x[j] for i in range(len(x)) for j in range(i + 1)])


def _matrix(dims: int, cell: str) -> str:
    """Array of ``cell`` (SQL over row i and column j) for every i and j."""
    return f"flatten(transform(sequence(0, {dims - 1}), i -> transform(sequence(0, {dims - 1}), j -> {cell})))"


def _moments(sums: str, dims: int, floors, factor: float) -> dict[str, str]:
    """Centre ``m`` and covariance ``s`` from the summed monomials."""
    n, t = f"{sums}[0]", lambda i: f"{sums}[1 + {i}]"
    p = f"{sums}[{1 + dims} + CAST(greatest(i, j) * (greatest(i, j) + 1) / 2 AS int) + least(i, j)]"
    floor = f"IF(i = j, pow(array({', '.join(f'{f}D' for f in floors)})[i], 2), 0D)"
    cov = f"{factor!r}D * ({p} - {t('i')} * {t('j')} / {n}) / {n} / {GRID**2}D + {floor}"
    return {"m": f"transform(sequence(0, {dims - 1}), i -> {t('i')} / {n} / {GRID}D)", "s": _matrix(dims, cov)}


def with_coefficients(estimate: DataFrame, dims: int) -> DataFrame:
    """Add ``coef`` (of the squared distance, per monomial) and ``log_det`` to rows of m and s.

    The inverse is made in place by one Gauss-Jordan step per row; its pivots give the
    determinant.
    """
    at = lambda i, j: f"st.a[{i} * {dims} + {j}]"
    cell = (
        f"CASE WHEN i = k AND j = k THEN 1 / {at('k', 'k')} WHEN i = k THEN {at('k', 'j')} / {at('k', 'k')}"
        f" WHEN j = k THEN -{at('i', 'k')} / {at('k', 'k')}"
        f" ELSE {at('i', 'j')} - {at('i', 'k')} * {at('k', 'j')} / {at('k', 'k')} END"
    )
    swept = (
        f"aggregate(sequence(0, {dims - 1}), named_struct('a', s, 'l', 0D), (st, k) ->"
        f" named_struct('a', {_matrix(dims, cell)}, 'l', st.l + ln({at('k', 'k')})))"
    )
    pull = f"aggregate(sequence(0, {dims - 1}), 0D, (z, j) -> z + inv.a[i * {dims} + j] * m[j])"
    squares = f"flatten(transform(sequence(0, {dims - 1}), i -> transform(sequence(0, i), j -> IF(i = j, 1D, 2D) * inv.a[i * {dims} + j] / {GRID**2}D)))"
    pulled = estimate.withColumn("inv", F.expr(swept)).withColumn("pull", F.expr(f"transform(sequence(0, {dims - 1}), i -> {pull})"))
    constant = f"array(aggregate(sequence(0, {dims - 1}), 0D, (z, i) -> z + pull[i] * m[i]))"
    coef = f"concat({constant}, transform(pull, v -> -2D / {GRID}D * v), {squares})"
    return pulled.withColumn("coef", F.expr(coef)).withColumn("log_det", F.col("inv.l")).drop("inv", "pull")


def distance2(coef: str, mono: str = "mono") -> Column:
    """Squared Mahalanobis distance: the product of coefficients and monomials."""
    product = f"aggregate(zip_with({coef}, {mono}, (c, v) -> c * v), 0D, (z, v) -> z + v)"
    return F.expr(f"IF({coef} IS NULL OR {mono} IS NULL, NULL, greatest(0D, {product}))")


def _near(rows: DataFrame, side: DataFrame, on: str, few: bool) -> DataFrame:
    """Join rows to one row per group: shipped if their counted number is small, else with
    frequent groups spread over salts."""
    return rows.join(F.broadcast(side), on, "left") if few else lookup(rows, side, on, "left")


def _of_level(table: DataFrame, level: int, *columns: Column) -> DataFrame:
    return table.where(F.col("level") == level).select(F.col("key").alias(LEVELS[level]), *columns)


def _each_level(cells: DataFrame) -> DataFrame:
    """Rows of (_g, _g1, _g0) counted for each of the three: (level, key, ...)."""
    keys = F.array(*[F.struct(F.lit(k).alias("level"), F.col(c).alias("key")) for k, c in LEVELS.items()])
    return cells.withColumn("_k", F.explode(keys)).select("_k.level", "_k.key", *[c for c in cells.columns if c not in LEVELS.values()])


def _start(rows: DataFrame, dims: int, floors) -> DataFrame:
    """Per level and group the medians and the squared quartile spreads: a diagonal first estimate."""
    each = rows.select(*LEVELS.values(), F.posexplode(F.slice("mono", 2, dims)).alias("j", "v"))
    hist = each.groupBy(*LEVELS.values(), "j", "v").agg(F.count(F.lit(1)).alias("n"))
    hist = _each_level(hist).groupBy("level", "key", "j", "v").agg(F.sum("n").alias("n"))
    by_key = Window.partitionBy("level", "key", "j")
    run = hist.withColumn("below", F.sum("n").over(by_key.orderBy("v"))).withColumn("all", F.sum("n").over(by_key))
    quartile = lambda q: F.min(F.when(F.col("below") >= q * F.col("all"), F.col("v")))
    q = run.groupBy("level", "key", "j").agg(
        F.max("all").alias("n"), quartile(0.5).alias("q2"), ((quartile(0.75) - quartile(0.25)) / 1.349).alias("w")
    )
    rows_ = q.groupBy("level", "key").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("j", "q2", "w"))).alias("q"))
    floor = f"pow(array({', '.join(f'{f}D' for f in floors)})[i], 2)"
    return rows_.select(
        "level", "key", "n",
        F.expr(f"transform(q, c -> c.q2 / {GRID}D)").alias("m"),
        F.expr(_matrix(dims, f"IF(i = j, pow(q[i].w / {GRID}D, 2) + {floor}, 0D)")).alias("s"),
    )


def mcd(rows: DataFrame, floors, share: float = 0.75, steps: int = 4) -> DataFrame:
    """Per group ``_g`` of rows (_g, x: grid vector) the MCD centre m{j}, Cholesky factor l{i}_{j} and log_det."""
    dims = len(floors)
    keyed = rows.select("_g", F.lit("").alias("_g1"), F.lit("").alias("_g0"), monomials([F.col("x")[j] for j in range(dims)]).alias("mono"))
    found = _of_level(mcd_levels(keyed, floors, share, steps, few=False), 2, F.col("m"), F.col("s"), F.col("log_det"))
    i, j = f"CAST(q DIV {dims} AS int)", f"CAST(q % {dims} AS int)"
    rest = f"(s[q] - aggregate(zip_with(slice(l, {i} * {dims} + 1, {j}), slice(l, {j} * {dims} + 1, {j}), (a, b) -> a * b), 0D, (z, v) -> z + v))"
    cell = f"CASE WHEN {j} > {i} THEN 0D WHEN {i} = {j} THEN sqrt({rest}) ELSE {rest} / l[{j} * {dims} + {j}] END"
    factor = f"aggregate(sequence(0, {dims * dims - 1}), CAST(array() AS array<double>), (l, q) -> concat(l, array({cell})))"
    return found.withColumn("l", F.expr(factor)).select(
        "_g",
        *[F.col("m")[k].alias(f"m{k}") for k in range(dims)],
        *[F.col("l")[a * dims + b].alias(f"l{a}_{b}") for a in range(dims) for b in range(a + 1)],
        "log_det",
    )


def mcd_levels(rows: DataFrame, floors, share: float, steps: int, few: bool) -> DataFrame:
    """(level, key, n, m, s, coef, log_det): the MCD estimate of every group of every level.

    ``rows``: the keys of ``LEVELS`` and mono. Concentration steps from a robust start:
    take the ``share`` of a group's rows nearest by its present estimate, estimate again
    from them alone. A step is one pass: rows are added up by (language, source) and bin
    of distance (fixed logarithmic bins), and the bins that make the share are chosen
    and added up from there, for languages and the table too. So the subset depends on
    the rows alone, no group is a key that raw rows are sent by, and a group's rows
    never meet in one task. The cut falls between bins: a group's subset holds at least
    the share.
    """
    dims = len(floors)
    inside = chi2_quantile(share, dims)
    factor = share / chi2_cdf(inside, dims + 2)
    found = settle(with_coefficients(_start(rows, dims, floors), dims))
    many = 1 + dims + dims * (dims + 1) // 2
    sums = [f"s{k}" for k in range(many)]
    for _ in range(steps):
        placed = rows
        for level, key in LEVELS.items():
            placed = _near(placed, _of_level(found, level, F.col("coef").alias(f"coef{level}")), key, few)
        far = lambda level: F.floor(F.log2(1 + distance2(f"coef{level}")) * STEPS_PER_DOUBLING).cast("int")
        bins = F.array(*[F.struct(F.lit(k).alias("level"), far(k).alias("bin")) for k in LEVELS])
        binned = placed.select(*LEVELS.values(), "mono", F.explode(bins).alias("b")).select(*LEVELS.values(), "mono", "b.*")
        cells = binned.groupBy(*LEVELS.values(), "level", "bin").agg(*[F.sum(F.col("mono")[k]).alias(c) for k, c in enumerate(sums)])
        key = F.when(F.col("level") == 2, F.col("_g")).when(F.col("level") == 1, F.col("_g1")).otherwise(F.col("_g0"))
        cells = cells.groupBy("level", key.alias("key"), "bin").agg(*[F.sum(c).cast("double").alias(c) for c in sums])
        by_key = Window.partitionBy("level", "key")
        before = F.coalesce(F.sum("s0").over(by_key.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        chosen = cells.withColumn("_before", before).withColumn("_all", F.sum("s0").over(by_key)).where(F.col("_before") < share * F.col("_all"))
        added = chosen.groupBy("level", "key").agg(F.max("_all").cast("long").alias("n"), F.array(*[F.sum(c) for c in sums]).alias("_s"))
        moments = added.select("level", "key", "n", *[F.expr(sql).alias(c) for c, sql in _moments("_s", dims, floors, factor).items()])
        found = settle(with_coefficients(moments, dims))
    return found


def _shrunk(own: DataFrame, wider: DataFrame, dims: int, constant: float) -> DataFrame:
    """Moments of the mixture of each group (weight n / (n + constant)) and of its wider one ``up``."""
    w = f"(n / (n + {float(constant)!r}D))"
    up = wider.select(F.col("key").alias("up"), F.col("m").alias("um"), F.col("s").alias("us"))
    mixed = f"{w} * s[i * {dims} + j] + (1 - {w}) * us[i * {dims} + j] + {w} * (1 - {w}) * (m[i] - um[i]) * (m[j] - um[j])"
    return own.join(up, "up").select(
        "key", "n",
        F.expr(f"zip_with(m, um, (a, b) -> {w} * a + (1 - {w}) * b)").alias("m"), F.expr(_matrix(dims, mixed)).alias("s"),
    )


def estimates(rows: DataFrame, floors, share: float, steps: int, constant: float) -> DataFrame:
    """(_g, coef, log_det) per (language, source) of rows (_g, _g1, _g0, mono): the MCD, shrunk
    to its language's, itself shrunk to the table's."""
    dims = len(floors)
    groups = settle(rows.select(*LEVELS.values()).distinct())
    found = mcd_levels(rows, floors, share, steps, is_few(groups))
    level = lambda k: found.where(F.col("level") == k).select("key", "n", "m", "s")
    ways = groups.select(F.col("_g").alias("key"), F.col("_g1").alias("up"))
    to_table = groups.select(F.col("_g1").alias("key"), F.col("_g0").alias("up")).distinct()
    by_language = _shrunk(level(1).join(to_table, "key"), level(0), dims, constant)
    by_source = _shrunk(level(2).join(ways, "key"), by_language, dims, constant)
    return settle(with_coefficients(by_source, dims).select(F.col("key").alias("_g"), "coef", "log_det"))


def is_few(groups: DataFrame) -> bool:
    """A settled table of groups whose estimates may be shipped to every task."""
    return groups.count() * 1024 <= min(JOIN_BYTES, session.broadcast_limit(groups.sparkSession))


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    cutoff: float = 0.9999,
    share: float = 0.75,
    steps: int = 4,
    shrink: float = 200,
) -> DataFrame:
    """Counts and verdict for every row of ``docs`` (with columns lang and source).

    (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    distance2, log_det). A text fails the base rules with fewer than 20 words or more
    than 30 % of words in repeated windows of eight; other texts are kept if their
    squared Mahalanobis distance is at most the chi-squared quantile ``cutoff``.
    Estimates use the texts that pass the base rules. The estimate of a source of n of
    them counts n / (n + ``shrink``), the rest is its language's, itself shrunk so to
    that of the whole table: every text is judged, and nothing flips at a count.
    Null text has no words and fails; null language and source are groups of their
    own; repeated rows are judged each for itself; an empty table gives no rows.
    """
    names = [
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_stops",
    ]
    renamed = docs.select(
        F.col(id_col).alias("_id"), F.col("lang"), F.col("source"), F.col(text_col).alias("_text")
    )
    counts = text_counts(renamed, "_text", keep=("_id", "lang", "source"))
    dims, floors = len(STATISTICS), [s[2] for s in STATISTICS]
    usable = ~base_failed()
    grid = F.array(*[F.expr(f"CAST(round({GRID} * {sql}) AS bigint)") for _, sql, _ in STATISTICS])
    counted = settle(counts.select("_id", *names[:5], *_keys(), F.when(usable, grid).alias("x")))
    rows = counted.where("x IS NOT NULL").select(*LEVELS.values(), monomials([F.col("x")[j] for j in range(dims)]).alias("mono"))
    roots = estimates(settle(rows), floors, share, steps, shrink)
    judged = _judged(counted, roots, dims)
    limit = chi2_quantile(cutoff, dims)
    return judged.select(
        F.col("_id").alias(id_col),
        *names[:5],
        base_failed().alias("base_failed"),
        (F.col("x").isNotNull() & (F.col("d2").isNull() | (F.col("d2") <= limit))).alias("kept"),
        F.col("d2").alias("distance2"),
        "log_det",
    )


def _judged(counted: DataFrame, roots: DataFrame, dims: int) -> DataFrame:
    """Add ``d2`` and ``log_det``; rows without a vector have no distance."""
    met = _near(counted, roots, "_g", is_few(roots))
    mono = F.when(F.col("x").isNotNull(), monomials([F.col("x")[j] for j in range(dims)]))
    return met.withColumn("mono", mono).withColumn("d2", distance2("coef"))
