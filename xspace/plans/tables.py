"""Tables derived from an ``embeddings`` table, with known answers.

They stand in for two languages: a source and a target space related by a fixed
rotation, or sharing a space with retrieval errors, together with dictionaries,
similarity datasets and analogies over the same words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import session, vectors


def written(build):
    """A derived table is checkpointed when first asked for."""
    name = build.__name__

    def table(self) -> DataFrame:
        if name not in self._written:
            self._written[name] = session.cut_lineage(build(self))
        return self._written[name]

    table.__doc__ = build.__doc__
    return table


def word(prefix: str, i: str = "i") -> str:
    """Numerals, words common to both sides, and words of one side only."""
    return (
        f"CASE WHEN ({i}) % 4 = 0 THEN string({i})"
        f" WHEN ({i}) % 4 = 1 THEN concat('id', {i})"
        f" ELSE concat('{prefix}', {i}) END"
    )


def plus(a: str, b: str, scale: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> x + y * {scale})"


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
        self.n = self.raw.count()
        self.width = self.raw.selectExpr("size(embedding)").head()[0]
        self._written: dict[str, DataFrame] = {}

    def base(self) -> DataFrame:
        """(i, v): the given vectors in double precision, at unit length."""
        doubles = session.spread(self.raw).selectExpr(
            "vec_id AS i", "CAST(embedding AS array<double>) AS v"
        )
        return doubles.selectExpr("i", f"{vectors.unit_sql('v')} AS v")

    def ids(self) -> DataFrame:
        return session.spread(self.raw.selectExpr("vec_id AS i"))

    def trg_idx(self, i: str = "i") -> str:
        return f"(({i}) * 7 + 3) % {self.n}"

    def _with_next(self) -> DataFrame:
        """``base`` with the vector ``u`` of the following row."""
        base = self.base()
        following = base.selectExpr(f"(i + {self.n - 1}) % {self.n} AS i", "v AS u")
        return base.join(following, "i")

    # -- embedding tables --------------------------------------------------------

    @written
    def source(self) -> DataFrame:
        return self.base().selectExpr("i AS idx", f"{word('s')} AS word", "v AS vec")

    def _target(self, rows: DataFrame, vec: str) -> DataFrame:
        return rows.selectExpr(
            f"{self.trg_idx()} AS idx", f"{word('t')} AS word", f"{vec} AS vec"
        )

    def _rotate(self, v: str) -> str:
        # a signed permutation of the dimensions
        sign = "CASE WHEN j % 3 = 0 THEN -1D ELSE 1D END"
        return (
            f"transform(sequence(0, {self.width - 1}), "
            f"j -> {sign} * {v}[int((j * 5 + 3) % {self.width})])"
        )

    @written
    def rotated(self) -> DataFrame:
        """The source turned; row i becomes row 7i+3 modulo the row count."""
        return self._target(self.base(), self._rotate("v"))

    @written
    def rotated_noisy(self) -> DataFrame:
        mixed = self._with_next().selectExpr("i", f"{plus('v', 'u', '0.3D')} AS m")
        unit = mixed.selectExpr("i", f"{vectors.unit_sql('m')} AS m")
        return self._target(unit, self._rotate("m"))

    @written
    def shared(self) -> DataFrame:
        """Targets in the source's space, pulled towards the next row."""
        pull = "CASE i % 3 WHEN 0 THEN 1.2D WHEN 1 THEN 0.6D ELSE 0.95D END"
        mixed = self._with_next().selectExpr("i", f"{plus('v', 'u', pull)} AS m")
        return self._target(mixed, vectors.unit_sql("m"))

    def uneven(self) -> DataFrame:
        """Rows of different length, some zero, with one dimension all zero."""
        vec = "transform(v, (x, j) -> CASE WHEN j = 7 THEN 0D ELSE x * (i % 5) END)"
        return self.base().selectExpr("i AS idx", f"{word('s')} AS word", f"{vec} AS vec")

    # -- dictionaries ------------------------------------------------------------

    def _lines(self, cases) -> DataFrame:
        """(line_no, src, trg): for each row the listed pairs whose condition holds."""
        slots = ", ".join(
            f"CASE WHEN {when} THEN struct(i * {len(cases)} + {k} AS line_no, "
            f"{src} AS src, {trg} AS trg) END"
            for k, (when, src, trg) in enumerate(cases)
        )
        pairs = self.ids().selectExpr(f"explode(array({slots})) AS p")
        return pairs.where("p IS NOT NULL").select("p.*")

    def training_pairs(self) -> DataFrame:
        unknown = "concat('zzz', i)"
        return self._lines(
            [
                ("true", word("s"), word("t")),
                ("i % 8 = 2", word("s"), word("t")),
                ("i % 25 = 0", unknown, word("t")),
                ("i % 25 = 1", word("s"), unknown),
            ]
        )

    def gold_pairs(self) -> DataFrame:
        unknown = "concat('zzz', i)"
        return self._lines(
            [
                ("i % 5 != 4", word("s"), word("t")),
                ("i % 5 = 0", word("s"), word("t", f"(i + 1) % {self.n}")),
                ("i % 5 IN (0, 4)", word("s"), unknown),
                ("i % 50 = 0", unknown, word("t")),
            ]
        )

    # -- similarity datasets -----------------------------------------------------

    def similarity_pairs(self) -> DataFrame:
        """(dataset, line_no, w1, w2, gold): every row i paired with row 3i+1."""
        base = self.base().selectExpr("*", f"(i * 3 + 1) % {self.n} AS j")
        rows = base.join(self.base().selectExpr("i AS j", "v AS u"), "j")
        scored = rows.withColumn("cos", vectors.dot("v", "u"))
        return scored.selectExpr(
            "CASE WHEN i % 2 = 0 THEN 'simA' ELSE 'relB' END AS dataset",
            "i AS line_no",
            f"CASE WHEN i % 7 = 3 THEN upper({word('s')}) ELSE {word('s')} END AS w1",
            f"CASE WHEN i % 15 = 0 THEN concat('zzz', i) ELSE {word('s', 'j')} END AS w2",
            "round(5 + 10 * cos + 0.3D * (i % 7), 1) AS gold",
        )

    # -- analogies ---------------------------------------------------------------

    @written
    def analogy_vocabulary(self) -> DataFrame:
        """Words b0.. and d0.. where d is b moved by a step shared by its category."""
        base = self.base()
        steps = self.base().where(f"i >= {self.n - 10}")
        steps = steps.selectExpr(f"{self.n - 1} - i AS l", "v AS r")
        third = base.selectExpr(f"(i + {self.n - 3}) % {self.n} AS i", "v AS u")
        rows = base.withColumn("l", base["i"] % 10).join(steps, "l").join(third, "i")
        pulled = "zip_with(v, u, (x, y) -> 0.2D * x + y)"
        moved = rows.selectExpr(
            "i",
            f"CASE WHEN i % 7 = 1 THEN {plus(pulled, 'r', '-0.5D')}"
            f" ELSE {plus('v', 'r', '0.7D')} END AS m",
        )
        return base.selectExpr(
            "i AS idx", "concat('b', i) AS word", "v AS vec"
        ).unionAll(
            moved.selectExpr(
                f"i + {self.n}", "concat('d', i)", vectors.unit_sql("m")
            )
        )

    def analogy_questions(self) -> DataFrame:
        """(line_no, category, is_syntactic, a, b, c, d); some d are unknown words."""
        asked = self.ids().where(f"i < {self.n - 10}")
        return asked.selectExpr(
            f"(i % 10) * {self.n + 2} + 1 + i AS line_no",
            "concat(if(i % 10 >= 5, 'gram', 'sem'), i % 10) AS category",
            "i % 10 >= 5 AS is_syntactic",
            "concat('b', i) AS a",
            "concat('d', i) AS b",
            "concat('b', i + 10) AS c",
            "if(i % 37 = 36, concat('zzz', i), concat('d', i + 10)) AS d",
        )

    def analogy_lines(self) -> DataFrame:
        """(line_no, value): the questions as text, a header opening each category.

        The last line of each category has three words only.
        """
        questions, span = self.analogy_questions(), self.n + 2
        headers = questions.selectExpr(
            "category", f"(line_no div {span}) * {span} AS line_no"
        ).distinct()
        return (
            questions.selectExpr("line_no", "concat_ws(' ', a, b, c, d) AS value")
            .unionAll(headers.selectExpr("line_no", "concat(': ', category)"))
            .unionAll(
                headers.selectExpr(
                    f"line_no + {span - 1}", "concat('three words ', category)"
                )
            )
        )
