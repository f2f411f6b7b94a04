"""The same queries in SQL, over the given tables only.

Self-contained statements: each is a chain of common table expressions that
derives the tables of ``tables.py`` and computes the operator the plain way.
"""

from __future__ import annotations

from ..functions import hashing
from .tables import word

# name -> (names it reads, SQL)
PARTS: dict[str, tuple[str, str]] = {}


def part(name: str, needs: str, sql: str) -> None:
    PARTS[name] = (needs, sql)


def statement(needs: str, select: str) -> str:
    """``select`` with the common table expressions it needs, in order."""
    order: list[str] = []

    def visit(name):
        if name not in order:
            for other in PARTS[name][0].split():
                visit(other)
            order.append(name)

    for name in needs.split():
        visit(name)
    ctes = ", ".join(f"{n} AS MATERIALIZED ({PARTS[n][1]})" for n in order)
    return f"WITH {ctes} {select}"


def unit(v: str) -> str:
    """Unit vectors of a column; zero vectors stay. Norms come from a subquery."""
    return (
        f"CASE WHEN nrm = 0 THEN {v} ELSE list_transform({v}, lambda x: x / nrm) END"
    )


def norm(v: str) -> str:
    return f"sqrt(list_dot_product({v}, {v}))"


def plus(a: str, b: str, scale: str) -> str:
    """a + scale*b, element by element."""
    return (
        f"list_transform(list_zip({a}, {b}), lambda p: p[1] + ({scale}) * p[2])"
    )


def long(table: str, keys: str = "idx", value: str = "round(vec[k], 6) + 0.0") -> str:
    return (
        f"SELECT {keys}, (k - 1)::INT AS pos, {value} AS value "
        f"FROM (SELECT {keys}, vec, unnest(range(1, len(vec) + 1)) AS k FROM {table})"
    )


part("n", "", "SELECT count(*)::BIGINT AS n FROM embeddings")
part(
    "e",
    "",
    f"SELECT i, {unit('v')} AS v FROM (SELECT i, v, {norm('v')} AS nrm FROM "
    "(SELECT vec_id::BIGINT AS i, embedding::DOUBLE[] AS v FROM embeddings))",
)


def sql_word(prefix: str, i: str = "i") -> str:
    return word(prefix, i).replace("string(", "CAST(").replace(
        f"CAST({i})", f"CAST({i} AS VARCHAR)"
    )


S, T = sql_word("s"), sql_word("t")
TRG = "(i * 7 + 3) % (SELECT n FROM n)"
ROTATE = (
    "list_transform(range(0, len({v})), lambda j: (CASE WHEN j % 3 = 0 THEN -1.0 ELSE 1.0 END)"
    " * {v}[((j * 5 + 3) % len({v})) + 1])"
)
part("src", "e", f"SELECT i, i AS idx, {S} AS word, v AS vec FROM e")
part(
    "rot",
    "e n",
    f"SELECT i, {TRG} AS idx, {T} AS word, {ROTATE.format(v='v')} AS vec FROM e",
)
part(
    "pair",
    "e n",
    "SELECT a.i, a.v, b.v AS u FROM e a JOIN e b ON b.i = (a.i + 1) % (SELECT n FROM n)",
)
PULL = "CASE i % 3 WHEN 0 THEN 1.2::DOUBLE WHEN 1 THEN 0.6::DOUBLE ELSE 0.95::DOUBLE END"
part(
    "trg",
    "pair n",
    f"SELECT i, {TRG} AS idx, {T} AS word, {unit('m')} AS vec FROM "
    f"(SELECT *, {norm('m')} AS nrm FROM (SELECT i, {plus('v', 'u', PULL)} AS m FROM pair))",
)
part(
    "uneven",
    "e",
    "SELECT i AS idx, list_transform(v, lambda x, k: CASE WHEN k = 8 THEN 0.0 "
    "ELSE x * (i % 5) END) AS vec FROM e",
)


def dictionary(cases) -> str:
    return " UNION ALL ".join(
        f"SELECT i * {len(cases)} + {k} AS line_no, {a} AS src, {b} AS trg FROM e WHERE {when}"
        for k, (when, a, b) in enumerate(cases)
    )


UNKNOWN = "'zzz' || i"
part(
    "train",
    "e",
    dictionary(
        [
            ("true", S, T),
            ("i % 8 = 2", S, T),
            ("i % 25 = 0", UNKNOWN, T),
            ("i % 25 = 1", S, UNKNOWN),
        ]
    ),
)
part(
    "goldraw",
    "e n",
    dictionary(
        [
            ("i % 5 != 4", S, T),
            ("i % 5 = 0", S, sql_word("t", "(i + 1) % (SELECT n FROM n)")),
            ("i % 5 IN (0, 4)", S, UNKNOWN),
            ("i % 50 = 0", UNKNOWN, T),
        ]
    ),
)
part(
    "seeds",
    "train src rot",
    "SELECT s.idx AS src_idx, t.idx AS trg_idx, count(*)::BIGINT AS w FROM train d "
    "JOIN src s ON s.word = d.src JOIN rot t ON t.word = d.trg GROUP BY 1, 2",
)
part(
    "gold",
    "goldraw src trg",
    "SELECT DISTINCT s.idx AS src_idx, t.idx AS trg_idx FROM goldraw d "
    "JOIN src s ON s.word = d.src JOIN trg t ON t.word = d.trg",
)
part(
    "cover",
    "goldraw gold src",
    "SELECT count(*) FILTER (known) AS covered, count(*) FILTER (NOT known) AS oov, "
    "count(*) FILTER (known) / count(*) AS coverage FROM (SELECT d.src, "
    "bool_or(g.src_idx IS NOT NULL) AS known FROM (SELECT DISTINCT src FROM goldraw) d "
    "LEFT JOIN src s ON s.word = d.src LEFT JOIN gold g ON g.src_idx = s.idx GROUP BY 1)",
)
part(
    "sim",
    "src trg",
    "SELECT s.idx AS i, t.idx AS j, list_dot_product(s.vec, t.vec) AS sim FROM src s, trg t",
)
part("asked", "gold", "SELECT DISTINCT src_idx AS i FROM gold")
part(
    "near",
    "sim",
    "SELECT j, avg(sim) AS mean FROM (SELECT j, sim, row_number() OVER "
    "(PARTITION BY j ORDER BY sim DESC) AS k FROM sim) WHERE k <= 10 GROUP BY j",
)
part(
    "nearsrc",
    "sim",
    "SELECT i, avg(sim) AS mean FROM (SELECT i, sim, row_number() OVER "
    "(PARTITION BY i ORDER BY sim DESC) AS k FROM sim) WHERE k <= 10 GROUP BY i",
)


def best(scores: str, by: str = "i", other: str = "j") -> str:
    """First row per ``by`` of the highest score, ties to the lower ``other``."""
    return (
        f"SELECT {by}, {other}, score FROM (SELECT *, row_number() OVER (PARTITION BY {by} "
        f"ORDER BY score DESC, {other}) AS k FROM ({scores})) WHERE k = 1"
    )


def translated(scores: str) -> str:
    return (
        f"SELECT i AS src_idx, j AS trg_idx, round(score, 6) + 0.0 AS score "
        f"FROM ({best(scores)})"
    )


part(
    "fwd", "sim", f"SELECT i, j, score FROM ({best('SELECT i, j, sim AS score FROM sim')})"
)
part(
    "bwd",
    "sim",
    f"SELECT i, j, score FROM ({best('SELECT i, j, sim AS score FROM sim', 'j', 'i')})",
)
part(
    "cslsfwd",
    "sim near",
    best("SELECT s.i, s.j, sim - mean / 2 AS score FROM sim s JOIN near k ON k.j = s.j"),
)
part(
    "cslsbwd",
    "sim nearsrc",
    best(
        "SELECT s.i, s.j, sim - mean / 2 AS score FROM sim s JOIN nearsrc k ON k.i = s.i",
        "j",
        "i",
    ),
)
# -- similarity datasets ---------------------------------------------------------
part(
    "f4",
    "e n",
    "SELECT CASE WHEN a.i % 2 = 0 THEN 'simA' ELSE 'relB' END AS dataset, a.i AS line_no, "
    f"CASE WHEN a.i % 7 = 3 THEN upper({sql_word('s', 'a.i')}) ELSE {sql_word('s', 'a.i')} END AS w1, "
    f"CASE WHEN a.i % 15 = 0 THEN 'zzz' || a.i ELSE {sql_word('s', 'b.i')} END AS w2, "
    "round(5 + 10 * list_dot_product(a.v, b.v) + 0.3::DOUBLE * (a.i % 7), 1) AS gold "
    "FROM e a JOIN e b ON b.i = (a.i * 3 + 1) % (SELECT n FROM n)",
)
part(
    "f4cos",
    "f4 src",
    "SELECT dataset, line_no, gold, CASE WHEN x.vec IS NOT NULL AND y.vec IS NOT NULL THEN "
    "list_dot_product(x.vec, y.vec) END AS cos FROM f4 LEFT JOIN src x ON x.word = lower(w1) "
    "LEFT JOIN src y ON y.word = w2",
)


def ranks(column: str) -> str:
    over = "PARTITION BY dataset"
    return (
        f"rank() OVER ({over} ORDER BY {column}) + (count(*) OVER "
        f"({over}, {column}) - 1) / 2.0"
    )


def spearman(scored: str) -> str:
    return (
        "SELECT dataset, corr(g, s) AS spearman FROM (SELECT dataset, "
        f"{ranks('gold')} AS g, {ranks('system')} AS s FROM ({scored})) GROUP BY dataset"
    )


SCORED = "SELECT dataset, gold, cos AS system FROM f4cos WHERE cos IS NOT NULL"
part(
    "f4res",
    "f4cos",
    "SELECT c.dataset, coverage, pearson, spearman FROM (SELECT dataset, count(cos) / count(*) "
    "AS coverage, corr(gold, cos) AS pearson FROM f4cos GROUP BY dataset) c "
    f"JOIN ({spearman(SCORED)}) s ON s.dataset = c.dataset",
)
# -- analogies -------------------------------------------------------------------
N = "(SELECT n FROM n)"
PULLED = "list_transform(list_zip(b.v, c.v), lambda p: 0.2::DOUBLE * p[1] + p[2])"
part(
    "vocab",
    "e n",
    "SELECT i AS idx, 'b' || i AS word, v AS vec FROM e UNION ALL "
    f"SELECT i + {N}, 'd' || i, {unit('m')} FROM (SELECT *, {norm('m')} AS nrm FROM ("
    f"SELECT b.i, CASE WHEN b.i % 7 = 1 THEN {plus(PULLED, 'r.v', '-0.5::DOUBLE')} "
    f"ELSE {plus('b.v', 'r.v', '0.7::DOUBLE')} END AS m FROM e b "
    "JOIN e r ON r.i = (SELECT n FROM n) - 1 - b.i % 10 "
    f"JOIN e c ON c.i = (b.i + 3) % {N}))",
)
part(
    "quest",
    "e n",
    "SELECT (i % 10) * ((SELECT n FROM n) + 2) + 1 + i AS line_no, "
    "(CASE WHEN i % 10 >= 5 THEN 'gram' ELSE 'sem' END) || (i % 10) AS category, "
    "i % 10 >= 5 AS is_syntactic, 'b' || i AS a, 'd' || i AS b, 'b' || (i + 10) AS c, "
    "CASE WHEN i % 37 = 36 THEN 'zzz' || i ELSE 'd' || (i + 10) END AS d "
    f"FROM e WHERE i < {N} - 10",
)


def resolved(name: str, vocabulary: str) -> None:
    joins = " ".join(
        f"LEFT JOIN {vocabulary} v{c} ON v{c}.word = q.{c}" for c in "abcd"
    )
    ids = ", ".join(f"v{c}.idx AS {c}_idx" for c in "abcd")
    part(
        f"{name}q",
        f"quest {vocabulary}",
        f"SELECT q.*, {ids}, va.idx IS NOT NULL AND vb.idx IS NOT NULL AND vc.idx IS NOT "
        "NULL AND vd.idx IS NOT NULL AS known, va.vec AS av, vb.vec AS bv, vc.vec AS cv "
        f"FROM quest q {joins}",
    )
    moved = plus(plus("cv", "av", "-1"), "bv", "1")
    part(
        f"{name}s",
        f"{name}q {vocabulary}",
        "SELECT line_no, a_idx, b_idx, c_idx, v.idx AS j, list_dot_product(x, v.vec) AS sim "
        f"FROM (SELECT *, {moved} AS x FROM {name}q WHERE known), {vocabulary} v",
    )
    own = "CASE WHEN j IN (a_idx, b_idx, c_idx) THEN -1.0 ELSE sim END"
    answers = best(f"SELECT line_no, j, {own} AS score FROM {name}s", "line_no", "j")
    part(
        f"{name}a",
        f"{name}q {name}s",
        "SELECT q.category, q.is_syntactic, q.line_no, q.known, a.j AS answer, "
        f"q.known AND a.j = q.d_idx AS correct FROM {name}q q LEFT JOIN ({answers}) a "
        "ON a.line_no = q.line_no",
    )


part("vocabcut", "vocab n", "SELECT * FROM vocab WHERE idx < (SELECT n FROM n) * 3 // 2")
resolved("full", "vocab")
resolved("cut", "vocabcut")
REPORT = (
    "count(*) FILTER (known) AS answered, count(*) FILTER (NOT known) AS oov, "
    "count(*) FILTER (correct) AS correct, round(count(*) FILTER (known) / count(*), 6) "
    "AS coverage, round(count(*) FILTER (correct) / nullif(count(*) FILTER (known), 0), 6) "
    "AS accuracy"
)


def analogy_totals(name: str) -> str:
    return (
        "SELECT CASE WHEN grouping(is_syntactic) = 1 THEN 'total' WHEN grouping(category) = 1 "
        f"THEN 'kind' ELSE 'category' END AS level, is_syntactic, category, {REPORT} "
        f"FROM {name}a GROUP BY ROLLUP (is_syntactic, category)"
    )


# -- seeded draws ----------------------------------------------------------------


def mix(x: str) -> str:
    """The 32-bit mix of ``hashing`` as nested unsigned arithmetic."""
    for shift, factor in ((16, hashing.MIX_A), (13, hashing.MIX_B)):
        x = f"((xor({x}, {x} >> {shift}) * {factor}::UBIGINT) & {hashing.MASK}::UBIGINT)"
    return f"xor({x}, {x} >> 16)"


def keys(i: str, stream: int, key: int) -> str:
    return mix(f"xor({i}::UBIGINT, {hashing.mix_int(stream ^ key)}::UBIGINT)")


def dropped(backward: bool) -> str:
    """Scores after a seeded draw keeps each with probability 0.3."""
    key = hashing.stream_key(5, 2, backward)
    row, col = (
        keys("i", hashing.ROW_STREAM, key),
        keys("j", hashing.COL_STREAM, key),
    )
    cell = mix("h")
    kept = f"CASE WHEN {cell} < {int(0.3 * 2**32)} THEN sim ELSE 0.0 END"
    return (
        f"SELECT i, j, {kept} AS score FROM (SELECT s.i, s.j, sim, xor(r, c) AS h FROM sim s "
        f"JOIN (SELECT DISTINCT i, {row} AS r FROM sim) x ON x.i = s.i "
        f"JOIN (SELECT DISTINCT j, {col} AS c FROM sim) y ON y.j = s.j)"
    )


def draw(counter: str, key: int) -> str:
    high, low = keys(counter, hashing.ROW_STREAM, key), keys(counter, hashing.COL_STREAM, key)
    return f"(({high} * 2097152::UBIGINT + ({low} >> 11))::DOUBLE / 9007199254740992.0)"


part(
    "draws",
    "n",
    "SELECT floor(" + draw("t", hashing.stream_key(3)) + " * (SELECT n FROM n))::BIGINT AS i, "
    "count(*) AS w FROM (SELECT unnest(range(0, (SELECT n FROM n))) AS t) GROUP BY 1",
)


def softmax(weights: str) -> str:
    shifted = (
        f"SELECT j, max(10 * sim) AS top FROM sim s {weights} GROUP BY j"
    )
    weight = "w" if weights else "1"
    z = (
        f"SELECT s.j, any_value(top) + ln(sum({weight} * exp(10 * sim - top))) AS z FROM sim s "
        f"{weights} JOIN ({shifted}) t ON t.j = s.j GROUP BY s.j"
    )
    return translated(
        f"SELECT s.i, s.j, 10 * sim - z AS score FROM sim s JOIN ({z}) z ON z.j = s.j "
        "WHERE s.i IN (SELECT i FROM asked)"
    )


# -- long-form mathematics -------------------------------------------------------
UNNESTED = "SELECT idx, unnest(range(0, len(vec))) AS pos, unnest(vec) AS x FROM {t}"


def normalised(table: str, actions: list[str]) -> str:
    """Long-form normalisation, one layer per action."""
    rows = UNNESTED.format(t=table)
    for action in actions:
        if action == "unit":
            s = "sqrt(sum(x * x) OVER (PARTITION BY idx))"
            x = f"CASE WHEN {s} = 0 THEN x ELSE x / {s} END"
        elif action == "unitdim":
            s = "sqrt(sum(x * x) OVER (PARTITION BY pos))"
            x = f"CASE WHEN {s} = 0 THEN x ELSE x / {s} END"
        elif action == "center":
            x = "x - avg(x) OVER (PARTITION BY pos)"
        else:
            x = "x - avg(x) OVER (PARTITION BY idx)"
        rows = f"SELECT idx, pos, {x} AS x FROM ({rows})"
    return rows


def normalised_cells(table: str, actions: list[str]) -> str:
    return (
        "SELECT idx, pos::INT AS pos, round(x, 6) + 0.0 AS value "
        f"FROM ({normalised(table, actions)})"
    )


SIX = "printf('%.6g', {x})"
part(
    "srclines",
    "src",
    "SELECT idx, word, list_transform(vec, lambda x: printf('%.6g', x)) AS texts FROM src",
)
part(
    "srcread",
    "srclines",
    "SELECT idx, word, list_transform(texts, lambda t: t::DOUBLE) AS vec FROM srclines",
)
part("sorted", "src", "SELECT idx, list_sort(vec) AS vec FROM src")
DIMS = (
    "(SELECT unnest(range(0, (SELECT max(len(embedding)) FROM embeddings)))::INT AS {c})"
)
CELL_GRID = f"{DIMS.format(c='i')} a, {DIMS.format(c='j')} b"
IDENTITY = f"SELECT i, j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM {CELL_GRID}"
ZERO = f"SELECT i, j, 0.0::DOUBLE AS gap FROM {CELL_GRID}"
part("sl", "src", UNNESTED.format(t="src"))
part("tl", "trg", UNNESTED.format(t="trg"))
part(
    "bag",
    "train src trg",
    "SELECT s.idx AS s, t.idx AS t, count(*) AS w FROM train d JOIN src s ON s.word = d.src "
    "JOIN trg t ON t.word = d.trg GROUP BY 1, 2",
)


def gram_block(name: str, left: str, lk: str, right: str, rk: str) -> str:
    return (
        f"SELECT '{name}' AS block, a.pos::INT AS i, b.pos::INT AS j, round(sum(w * a.x * b.x), 6) "
        f"+ 0.0 AS v FROM bag JOIN {left} a ON a.idx = bag.{lk} JOIN {right} b ON b.idx = bag.{rk} "
        "GROUP BY a.pos, b.pos"
    )


def induced(table: str, direction: str | None = None) -> str:
    lead = f"'{direction}' AS direction, " if direction else ""
    return (
        f"SELECT {lead}i AS src_idx, j AS trg_idx, round(score, 6) + 0.0 AS score FROM ({table})"
    )


PLANTED = f"SELECT i AS src_idx, {TRG} AS trg_idx"
FOLLOW = (
    "round(list_dot_product(v, v), 6) AS own, round(list_dot_product(v, u), 6) + 0.0 AS following"
)
W_CELL = "((k - 1) * 3 + c * 7) % 11 - 5"

ORACLES = {
    "s1_read_word2vec": statement("srcread", long("srcread", "idx, word", "vec[k]")),
    "s2_threshold": statement(
        "srcread n",
        long("(SELECT * FROM srcread WHERE idx < (SELECT n FROM n) // 2)", "idx, word", "vec[k]"),
    ),
    "s3_vocabulary_filter": statement(
        "srcread f4",
        "SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, word, "
        f"round({norm('vec')}, 4) AS norm FROM srcread WHERE word IN (SELECT w2 FROM f4)",
    ),
    "s6_read_dictionary": statement("train", "SELECT line_no, src, trg FROM train"),
    "s7_read_similarity": statement(
        "f4", "SELECT lower(dataset) AS dataset, line_no, lower(w1) AS w1, w2, gold FROM f4"
    ).replace("lower(dataset)", "dataset"),
    "s8_read_analogies": statement(
        "quest n",
        "SELECT line_no, category, is_syntactic, a, b, c, d, NULL::VARCHAR AS _corrupt_record "
        "FROM quest UNION ALL SELECT DISTINCT (line_no // ((SELECT n FROM n) + 2) + 1) * "
        "((SELECT n FROM n) + 2) - 1, category, is_syntactic, NULL, NULL, NULL, NULL, "
        "'three words ' || category FROM quest",
    ),
    "s9_write_word2vec": statement(
        "trg",
        "SELECT idx + 1 AS line_no, word || ' ' || list_aggregate(list_transform(vec, "
        "lambda x: printf('%.6g', x)), 'string_agg', ' ') AS value FROM trg UNION ALL "
        "SELECT 0, count(*) || ' ' || max(len(vec)) FROM trg",
    ),
    "s10_training_log": statement(
        "cover",
        "SELECT unnest([1, 2])::INT AS iteration, 100.0::DOUBLE AS objective, 0.0::DOUBLE AS "
        "drop_prob, 100.0::DOUBLE AS val_similarity, 100.0::DOUBLE AS val_accuracy, "
        "round(100 * coverage, 4) AS val_coverage FROM cover",
    ),
    "s11_word_index": statement(
        "src trg n",
        "SELECT word, max(idx) AS idx FROM (SELECT word, idx FROM src UNION ALL "
        "SELECT word, idx + (SELECT n FROM n) FROM trg) GROUP BY word",
    ),
    "s12_metric_reports": statement(
        "cover gold fwd asked f4res fulla",
        "SELECT 'translation' AS report, round(coverage, 6) AS coverage, (SELECT "
        "round(avg((g.src_idx IS NOT NULL)::INT), 6) FROM asked a JOIN fwd f ON f.i = a.i LEFT "
        "JOIN gold g ON g.src_idx = f.i AND g.trg_idx = f.j) AS value FROM cover UNION ALL "
        "SELECT 'pearson ' || dataset, round(coverage, 6), round(pearson, 6) FROM f4res UNION "
        "ALL SELECT 'spearman ' || dataset, round(coverage, 6), round(spearman, 6) FROM f4res "
        "UNION ALL SELECT 'analogy', round(avg(known::INT), 6), round(count(*) FILTER (correct) "
        "/ count(*) FILTER (known), 6) FROM fulla",
    ),
    "n1_unit": statement("uneven", normalised_cells("uneven", ["unit"])),
    "n2_center": statement("uneven", normalised_cells("uneven", ["center"])),
    "n3_unitdim": statement("uneven", normalised_cells("uneven", ["unitdim"])),
    "n4_centeremb": statement("uneven", normalised_cells("uneven", ["centeremb"])),
    "n5_action_list": statement(
        "uneven", normalised_cells("uneven", ["unit", "center", "unit"])
    ),
    "n6_normalize_job": statement(
        "srcread",
        "SELECT idx + 1 AS line_no, any_value(word) || ' ' || string_agg(printf('%.6g', x), ' ' "
        "ORDER BY pos) AS value FROM (" + normalised("srcread", ["center", "unit"]) + ") "
        "JOIN (SELECT idx, word FROM srcread) w USING (idx) GROUP BY idx UNION ALL "
        "SELECT 0, count(*) || ' ' || max(len(vec)) FROM srcread",
    ),
    "d1_seed_pairs": statement("seeds", "SELECT src_idx, trg_idx, w FROM seeds"),
    "d2_oov_pairs": statement(
        "train src rot",
        "SELECT src, trg, count(*) AS w FROM train WHERE src NOT IN (SELECT word FROM src) "
        "OR trg NOT IN (SELECT word FROM rot) GROUP BY 1, 2",
    ),
    "d3_seed_identical": statement(
        "src rot",
        "SELECT s.idx AS src_idx, t.idx AS trg_idx, 1::BIGINT AS w FROM src s JOIN rot t "
        "ON s.word = t.word",
    ),
    "d4_seed_numerals": statement(
        "src rot",
        "SELECT s.idx AS src_idx, t.idx AS trg_idx, 1::BIGINT AS w FROM src s JOIN rot t "
        "ON s.word = t.word WHERE regexp_full_match(s.word, '[0-9]+')",
    ),
    "d5_unsupervised_vocabulary": statement(
        "src rot n",
        "SELECT 'src' AS side, idx, word FROM src WHERE idx < (SELECT n FROM n) * 3 // 4 UNION "
        "ALL SELECT 'trg', idx, word FROM rot WHERE idx < (SELECT n FROM n) * 3 // 4",
    ),
    "d6_sqrt_similarity": statement("pair", f"SELECT i AS idx, {FOLLOW} FROM pair"),
    "d7_sort_profile": statement("sorted", long("sorted")),
    "d8_normalize_profile": statement(
        "sorted", normalised_cells("sorted", ["unit", "center", "unit"])
    ),
    "d7_sorted_profiles": statement(
        "e n",
        "SELECT i, n AS values, true AS ascending, 1.0::DOUBLE AS own, 0.0::DOUBLE AS gap "
        "FROM e, n",
    ),
    "d8_normalized_profiles": statement(
        "e",
        "SELECT unnest(['length', 'mean']) AS kind, i AS idx, unnest([1.0::DOUBLE, 0.0::DOUBLE]) "
        "AS value FROM e",
    ),
    "d9_profile_scores_csls": statement(
        "e n", f"{PLANTED}, 1.0::DOUBLE AS score FROM e"
    ),
    "d9_profile_scores": statement(
        "e n", f"{PLANTED}, 1.0::DOUBLE AS score FROM e"
    ),
    "d10_seed_unsupervised": statement("e n", f"{PLANTED}, 2::BIGINT AS w FROM e"),
    "m1_joint_gram": statement(
        "bag sl tl",
        gram_block("xx", "sl", "s", "sl", "s")
        + " UNION ALL "
        + gram_block("zz", "tl", "t", "tl", "t")
        + " UNION ALL "
        + gram_block("xz", "sl", "s", "tl", "t"),
    ),
    "m2_orthogonal": statement(
        "rot", long("(SELECT i AS idx, vec FROM rot)")
    ),
    "m3_unconstrained": statement(
        "rot",
        long("(SELECT i AS idx, list_transform(vec, lambda x: 1.5 * x) AS vec FROM rot)"),
    ),
    "m4_whitening": f"SELECT unnest(['xx', 'zz']) AS block, i, j, v FROM ({IDENTITY})",
    "m5_svd_alignment": ZERO,
    "m6_reweighting": ZERO,
    "m7_dewhitening": "SELECT undone, block, i, j, gap FROM (SELECT unnest(['src', 'trg']) AS "
    "undone) u, (SELECT unnest(['xx', 'zz']) AS block) k, (" + ZERO + ") z",
    "m7_dewhitening_by_side": "SELECT undone, block, i, j, gap FROM (SELECT unnest(['own', 'other']) "
    "AS undone) u, (SELECT unnest(['xx', 'zz']) AS block) k, (" + ZERO + ") z",
    "m8_dim_reduction": "SELECT * FROM (SELECT unnest(['xx', 'zz']) AS block, i, j, v FROM "
    f"({IDENTITY}) UNION ALL SELECT 'xz', i, j, gap FROM ({ZERO})) WHERE greatest(i, j) < "
    "(SELECT max(len(embedding)) // 4 FROM embeddings)",
    "m9_advanced": statement("pair", f"SELECT i, {FOLLOW} FROM pair"),
    "m10_apply_map": statement(
        "src",
        "SELECT idx, c::INT AS pos, round(sum(vec[k] * ((" + W_CELL + ") / 10.0::DOUBLE)), 6) + "
        "0.0 AS value FROM (SELECT idx, vec, unnest(range(1, len(vec) + 1)) AS k FROM src), "
        "(SELECT unnest(range(0, (SELECT max(len(embedding)) // 4 FROM embeddings))) AS c) "
        "GROUP BY idx, c",
    ),
    "k1_block_scores": statement(
        "sim",
        "SELECT i AS idx, j AS nbr, k::INT AS rank, round(score, 6) + 0.0 AS score FROM (SELECT "
        "*, row_number() OVER (PARTITION BY i ORDER BY score DESC, j) AS k FROM (SELECT i, j, "
        "2 * sim - (j % 3) * 0.1::DOUBLE AS score FROM sim)) WHERE k <= 3",
    ),
    "k2_vocabulary_cutoff": statement(
        "sim n",
        induced(
            best(
                "SELECT i, j, sim AS score FROM sim WHERE i < (SELECT n FROM n) // 2 "
                "AND j < (SELECT n FROM n) // 2"
            )
        ),
    ),
    "k3_best_similarity": statement(
        "sim", "SELECT i AS idx, round(max(sim), 6) + 0.0 AS value FROM sim GROUP BY i"
    ),
    "k4_topk_mean": statement(
        "near nearsrc",
        "SELECT 'left' AS side, i AS idx, round(mean, 6) + 0.0 AS value FROM nearsrc UNION ALL "
        "SELECT 'right', j, round(mean, 6) + 0.0 FROM near",
    ),
    "k5_csls": statement(
        "cslsfwd cslsbwd",
        induced("SELECT * FROM cslsfwd", "forward")
        + " UNION ALL "
        + induced("SELECT * FROM cslsbwd", "backward"),
    ),
    "k6_dropout": statement(
        "sim",
        induced(best(dropped(False)), "forward")
        + " UNION ALL "
        + induced(best(dropped(True), "j", "i"), "backward"),
    ),
    "k7_induce_forward": statement("fwd", induced("SELECT * FROM fwd")),
    "k8_induce_backward": statement("bwd", induced("SELECT * FROM bwd")),
    "k9_induce_union": statement(
        "cslsfwd cslsbwd",
        "SELECT i AS src_idx, j AS trg_idx, count(*) AS w FROM (SELECT i, j FROM cslsfwd UNION "
        "ALL SELECT i, j FROM cslsbwd) GROUP BY 1, 2",
    ),
    "k10_objective": statement(
        "fwd bwd",
        "SELECT direction, round(objective, 6) AS objective FROM (SELECT 'forward' AS direction, "
        "avg(score) AS objective FROM fwd UNION ALL SELECT 'backward', avg(score) FROM bwd UNION "
        "ALL SELECT 'union', ((SELECT avg(score) FROM fwd) + (SELECT avg(score) FROM bwd)) / 2)",
    ),
    "k12_self_learning": statement("e n", f"{PLANTED}, 1::BIGINT AS w FROM e"),
    "k12_self_learning_union": statement("e n", f"{PLANTED}, 2::BIGINT AS w FROM e"),
    "k13_validation": statement(
        "sim gold fwd cover",
        "SELECT (SELECT round(avg(m), 6) FROM (SELECT max(sim) AS m FROM gold g JOIN sim s ON "
        "s.i = g.src_idx AND s.j = g.trg_idx GROUP BY g.src_idx)) AS similarity, (SELECT "
        "round(avg(h), 6) FROM (SELECT max((f.j = g.trg_idx)::INT) AS h FROM gold g JOIN fwd f "
        "ON f.i = g.src_idx GROUP BY g.src_idx)) AS accuracy, round(coverage, 6) AS coverage "
        "FROM cover",
    ),
    "t1_gold_dictionary": statement(
        "gold cover",
        "SELECT 'gold' AS kind, src_idx, trg_idx, NULL::DOUBLE AS coverage FROM gold UNION ALL "
        "SELECT 'covered, oov', covered, oov, round(coverage, 6) FROM cover",
    ),
    "t2_translate_nn": statement(
        "sim asked",
        translated("SELECT i, j, sim AS score FROM sim WHERE i IN (SELECT i FROM asked)"),
    ),
    "t3_translate_invnn": statement(
        "sim asked",
        "SELECT i AS src_idx, j AS trg_idx, rank::DOUBLE AS score FROM (SELECT *, row_number() "
        "OVER (PARTITION BY i ORDER BY rank, sim DESC, j) AS k FROM (SELECT i, j, sim, "
        "row_number() OVER (PARTITION BY j ORDER BY sim DESC, i) - 1 AS rank FROM sim) WHERE i "
        "IN (SELECT i FROM asked)) WHERE k = 1",
    ),
    "t4_translate_invsoftmax": statement("sim asked", softmax("")),
    "t5_inverse_sample": statement(
        "sim asked draws", softmax("JOIN draws d ON d.i = s.i")
    ),
    "t6_translate_csls": statement(
        "sim asked near",
        translated(
            "SELECT s.i, s.j, 2 * sim - mean AS score FROM sim s JOIN near k ON k.j = s.j "
            "WHERE s.i IN (SELECT i FROM asked)"
        ),
    ),
    "t7_dot_or_cosine": statement(
        "sim",
        "SELECT 'cosine' AS mode, * FROM ("
        + translated("SELECT i, j, sim AS score FROM sim")
        + ") UNION ALL SELECT 'dot', * FROM ("
        + translated(
            "SELECT i, j, sim * (1 + (j % 7) / 10.0::DOUBLE) AS score FROM sim"
        )
        + ")",
    ),
    "t8_translation_accuracy": statement(
        "asked fwd gold",
        "SELECT count(*) AS queries, count(g.src_idx) AS correct, round(count(g.src_idx) / "
        "count(*), 6) AS accuracy FROM asked a JOIN fwd f ON f.i = a.i LEFT JOIN gold g ON "
        "g.src_idx = f.i AND g.trg_idx = f.j",
    ),
    "w1_pair_cosine": statement(
        "f4cos f4 src trg",
        "SELECT 'one table' AS mode, dataset, line_no, round(cos, 6) + 0.0 AS cos FROM f4cos "
        "UNION ALL SELECT 'two tables', dataset, line_no, CASE WHEN x.vec IS NOT NULL AND y.vec "
        "IS NOT NULL THEN round(list_dot_product(x.vec, y.vec), 6) + 0.0 END FROM f4 LEFT JOIN "
        "src x ON x.word = lower(w1) LEFT JOIN trg y ON y.word = w2",
    ),
    "w2_backoff": statement(
        "f4cos",
        "SELECT dataset, line_no, round(coalesce(cos, 0.25), 6) + 0.0 AS system FROM f4cos",
    ),
    "w3_coverage": statement(
        "f4cos",
        "SELECT 'none' AS backoff, dataset, count(cos) AS scored, count(*) - count(cos) AS oov, "
        "round(count(cos) / count(*), 6) AS coverage FROM f4cos GROUP BY dataset UNION ALL "
        "SELECT 'fixed', dataset, count(*), 0, 1.0 FROM f4cos GROUP BY dataset",
    ),
    "w4_pearson": statement(
        "f4cos",
        "SELECT dataset, round(corr(gold, cos), 6) AS pearson FROM f4cos GROUP BY dataset",
    ),
    "w5_spearman": statement(
        "f4cos",
        "SELECT dataset, round(spearman, 6) AS spearman FROM ("
        + spearman("SELECT dataset, gold, coalesce(cos, 0.0) AS system FROM f4cos")
        + ")",
    ),
    "w6_dataset_name": statement(
        "f4", "SELECT dataset, count(*) AS lines FROM f4 GROUP BY dataset"
    ),
    "w7_averages": statement(
        "f4res",
        "SELECT name, round(avg(coverage), 6) AS coverage, round(avg(pearson), 6) AS pearson, "
        "round(avg(spearman), 6) AS spearman FROM (SELECT CASE dataset WHEN 'simA' THEN 'sim' "
        "ELSE 'rel' END AS name, * FROM f4res UNION ALL SELECT 'all', * FROM f4res) GROUP BY name",
    ),
    "a1_category_kind": statement(
        "quest",
        "SELECT category, starts_with(category, 'gram') AS is_syntactic, count(*) AS questions "
        "FROM quest GROUP BY category",
    ),
    "a2_lowercase": statement(
        "quest", "SELECT line_no, upper(category) AS category, a, b, c, d FROM quest"
    ),
    "a3_resolve_questions": statement(
        "fullq", "SELECT line_no, known, a_idx, b_idx, c_idx, d_idx FROM fullq"
    ),
    "a4_offset_retrieval": statement(
        "fulls",
        "SELECT line_no, j AS nbr, round(score, 6) + 0.0 AS score FROM ("
        + best("SELECT line_no, j, sim AS score FROM fulls", "line_no", "j")
        + ")",
    ),
    "a5_exclusion": statement("fulla", "SELECT line_no, answer FROM fulla WHERE known"),
    "a6_by_category": statement(
        "fulla",
        f"SELECT category, is_syntactic, {REPORT} FROM fulla GROUP BY category, is_syntactic",
    ),
    "a7_totals": statement("fulla", analogy_totals("full")),
    "a8_vocabulary_limit": statement("cuta", analogy_totals("cut")),
}
