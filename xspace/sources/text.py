"""Text sources: word vectors, dictionaries, similarity sets, analogy sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import ordering, session
from ..operators.analogy import is_syntactic
from .encodings import decoded, encoding_of
from .lines import line_ranges, numbered_lines

# Fixed value: Unicode white space plus the ASCII separators.
BLANK = "(?U)[\\s\\x1c-\\x1f]+"
BLANK_SQL = BLANK.replace("\\", "\\\\")
ANALOGY_HEADER = ": "


def ordered_lines(
    spark: SparkSession,
    paths,
    encoding: str = "utf-8",
    per_file: bool = False,
    most: int | None = None,
) -> DataFrame:
    """(file, line_no, value): text lines numbered from 0 in file order.

    Files are read by byte ranges, and where ``most`` is given only those that hold the
    first ``most`` lines. Several files count on from each other unless ``per_file``.
    """
    known = encoding_of(encoding)
    ranges = line_ranges(spark, paths, per_file, most, encoding)
    if ranges is not None:
        lines = numbered_lines(spark, ranges)
    elif known.unit == 1:
        lines = _written_lines(spark, paths, per_file)
    else:
        raise ValueError(f"compressed files in encoding {encoding!r} cannot be cut into lines")
    lines = lines.select("file", "line_no", F.col("value").cast("binary").alias("value"))
    if known.charset is not None:
        return lines.withColumn("value", F.decode("value", known.charset))
    if not known.plain and known.unit == 1:  # the reader has decoded wide units
        lines = decoded(lines, known)
    return lines.withColumn("value", F.col("value").cast("string"))


def _written_lines(spark: SparkSession, paths, per_file: bool) -> DataFrame:
    """Lines of compressed files, and of file systems that only Spark can open.

    Lines are counted per input split and the counts summed up in split order, so
    numbering is a join with one small row per split and never a global sort. The
    lines are written once with the split they came in: a later action, with other
    executors or settings, would split the files anew and no longer fit the counts.
    """
    split = ["file", "start"]
    raw = session.cut_lineage(
        spark.read.text(paths).select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("mid"),
        )
    )
    counts = raw.groupBy(*split).agg(
        F.min("mid").alias("first"), F.count("*").alias("n")
    )
    order = (
        Window.partitionBy("file").orderBy("start")
        if per_file
        else Window.orderBy(*split)
    )
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *split,
        "first",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
    )
    line_no = F.col("mid") - F.col("first") + F.col("offset")
    known = _require(line_no.isNotNull(), F.lit("a split without an offset"), line_no)
    return raw.join(session.cut_lineage(starts), split, "left").select(
        "file", known.alias("line_no"), "value"
    )


def _require(ok: Column, message: Column, value: Column) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(message))


# -- word vectors ----------------------------------------------------------------


def read_word2vec(
    spark: SparkSession,
    path: str,
    threshold: int = 0,
    vocabulary: DataFrame | None = None,
    encoding: str = "utf-8",
    precision: str = "fp64",
    mode: str = "FAILFAST",
) -> DataFrame:
    """(idx, word, vec) from a ``count dim`` header and ``word v1 .. vdim`` lines."""
    most = threshold + 1 if threshold > 0 else None
    lines = ordered_lines(spark, path, encoding, most=most)
    return parse_word2vec_lines(lines, threshold, vocabulary, precision, mode)


def parse_word2vec_lines(
    lines: DataFrame,
    threshold: int = 0,
    vocabulary: DataFrame | None = None,
    precision: str = "fp64",
    mode: str = "FAILFAST",
) -> DataFrame:
    """The same from a (line_no, value) table.

    Lines beyond the header's count are ignored; ``threshold`` keeps the first
    rows, ``vocabulary`` (word) keeps its words and renumbers them; the numbers of
    other words are not parsed, whatever they are. FAILFAST raises
    on a short file or a malformed line, PERMISSIVE puts it in ``_corrupt_record``.
    """
    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError("mode must be FAILFAST or PERMISSIVE")
    count, dim = _header(lines)
    wanted = min(count, threshold) if threshold > 0 else count
    if mode == "FAILFAST":
        last = lines.agg(F.max("line_no")).head()[0]
        if last < wanted:
            raise ValueError(f"header promises {count} rows, the file has {last}")
    stored = {"fp32": "array<float>", "fp64": "array<double>"}.get(precision)
    if stored is None:
        raise ValueError("precision must be fp32 or fp64")
    numbers = (
        f"transform(split(trim(regexp_replace(substring(value, instr(value, ' ') + 1), "
        f"'{BLANK_SQL}', ' ')), ' '), t -> try_cast(t AS double))"
    )
    wanted_line = f"line_no BETWEEN 1 AND {wanted}"
    named = lines.where(wanted_line).selectExpr(
        "line_no - 1 AS idx", "substring_index(value, ' ', 1) AS word", "value", "line_no"
    )
    if vocabulary is not None:
        named = named.join(vocabulary.select("word"), "word", "left_semi")
    parsed = named.selectExpr("idx", "word", f"{numbers} AS vec", "value", "line_no")
    good = (
        f"instr(value, ' ') > 0 AND size(vec) = {dim} AND NOT exists(vec, x -> x IS NULL)"
    )
    if mode == "FAILFAST":
        # the line test is repeated because the optimiser may check vectors earlier
        error = "raise_error(concat('malformed vector line: ', left(value, 80)))"
        vec = f"CASE WHEN {wanted_line} AND NOT ({good}) THEN {error} ELSE vec END"
        out = parsed.selectExpr("idx", "word", f"CAST({vec} AS {stored}) AS vec")
    else:
        out = parsed.selectExpr(
            "idx",
            "word",
            f"CAST(CASE WHEN {good} THEN vec END AS {stored}) AS vec",
            f"CASE WHEN NOT ({good}) THEN value END AS _corrupt_record",
        )
    return out if vocabulary is None else ordering.redensify(out).select(*out.columns)


def _header(lines: DataFrame) -> tuple[int, int]:
    first = lines.where(F.col("line_no") == 0).select("value").head()
    try:
        count, dim = (int(x) for x in first[0].split()[:2])
    except (TypeError, ValueError):
        raise ValueError("the first line must hold the row count and width") from None
    return count, dim


def filter_vocabulary(emb: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Keep the words of ``vocabulary`` (word), in order, numbered densely again."""
    kept = emb.join(vocabulary.select("word"), "word", "left_semi")
    return ordering.redensify(kept).select(*emb.columns)


def set_precision(emb: DataFrame, precision: str) -> DataFrame:
    stored = {"fp32": "array<float>", "fp64": "array<double>"}[precision]
    return emb.withColumn("vec", F.col("vec").cast(stored))


# -- dictionaries ----------------------------------------------------------------


def read_dictionary(spark: SparkSession, path, encoding: str = "utf-8") -> DataFrame:
    """(line_no, src, trg) from lines of two words."""
    return parse_dictionary_lines(ordered_lines(spark, path, encoding))


def parse_dictionary_lines(lines: DataFrame) -> DataFrame:
    """Two tokens per line, separated by any white space; anything else is an error."""
    tokens = _tokens(F.col("value"))
    message = F.concat(F.lit("not two words: "), F.col("value"))
    pair = _require(F.size(tokens) == 2, message, tokens)
    return lines.select("line_no", pair.alias("t")).select(
        "line_no", F.col("t")[0].alias("src"), F.col("t")[1].alias("trg")
    )


def _tokens(value: Column) -> Column:
    return F.filter(F.split(value, BLANK), lambda t: t != "")


# -- similarity datasets ---------------------------------------------------------


def read_similarity(
    spark: SparkSession, paths, lowercase: bool = False, encoding: str = "utf-8"
) -> DataFrame:
    """(dataset, line_no, w1, w2, gold) from one tab-separated file per dataset."""
    lines = ordered_lines(spark, paths, encoding, per_file=True)
    named = lines.withColumn("dataset", dataset_name(F.col("file")))
    return parse_similarity_lines(named, lowercase)


def dataset_name(path: Column) -> Column:
    """Base name without its last extension; a leading dot is no extension."""
    base = F.url_decode(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\+", "%2B"))
    return F.regexp_replace(base, r"(?<=[^.])\.[^.]*$", "")


def parse_similarity_lines(lines: DataFrame, lowercase: bool = False) -> DataFrame:
    """From (dataset, line_no, value); ``lowercase`` applies to the whole line."""
    value = F.lower("value") if lowercase else F.col("value")
    fields = F.split(value, "\t")
    message = F.concat(F.lit("not word, word, score: "), F.col("value"))
    three = _require(F.size(fields) == 3, message, fields)
    checked = lines.select("dataset", "line_no", "value", three.alias("f"))
    gold = F.trim(F.col("f")[2]).try_cast("double")
    return checked.select(
        "dataset",
        "line_no",
        F.col("f")[0].alias("w1"),
        F.col("f")[1].alias("w2"),
        _require(gold.isNotNull(), message, gold).alias("gold"),
    )


# -- analogies -------------------------------------------------------------------


def read_analogies(
    spark: SparkSession, path, lowercase: bool = False, encoding: str = "utf-8"
) -> DataFrame:
    """Questions of an analogy file; see ``parse_analogy_lines``."""
    return parse_analogy_lines(ordered_lines(spark, path, encoding), lowercase)


def parse_analogy_lines(lines: DataFrame, lowercase: bool = False) -> DataFrame:
    """(line_no, category, is_syntactic, a, b, c, d, _corrupt_record).

    A line starting with ``": "`` opens a category that holds until the next one. A
    question without four words is kept with its text in ``_corrupt_record``; a
    question before any category is an error.
    """
    value = F.col("value")
    header = F.startswith(value, F.lit(ANALOGY_HEADER))
    marked = lines.select(
        "line_no",
        "value",
        F.when(header, F.expr("substring(value, 3)")).alias("_header"),
    )
    placed = ordering.carry_forward(marked, "line_no", "_header", "category")
    questions = placed.where(F.col("_header").isNull())
    tokens = _tokens(F.lower(value) if lowercase else value)
    message = F.concat(F.lit("question before any category, line "), F.col("line_no"))
    four = F.size("t") == 4
    return questions.select(
        "line_no",
        _require(F.col("category").isNotNull(), message, F.col("category")).alias(
            "category"
        ),
        tokens.alias("t"),
        "value",
    ).select(
        "line_no",
        "category",
        is_syntactic(F.col("category")).alias("is_syntactic"),
        *[F.when(four, F.col("t")[i]).alias(c) for i, c in enumerate("abcd")],
        F.when(~four, F.col("value")).alias("_corrupt_record"),
    )
