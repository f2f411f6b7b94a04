"""Text sinks: word vectors and the training log."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import tiles
from .encodings import encoded, encoding_of

LOG_SCHEMA = (
    "iteration int, objective double, drop_prob double, val_similarity double, "
    "val_accuracy double, val_coverage double, seconds double"
)


def _six_digits(m):
    # C-style %.6g per value: no column expression drops trailing zeros that way
    line = " ".join(["%.6g"] * m.shape[1])
    return pa.array([line % tuple(row) for row in m.tolist()], pa.string())


def format_word2vec_lines(emb: DataFrame) -> DataFrame:
    """(line_no, value): the header, then each word with its values at 6 digits."""
    texts = tiles.map_vectors(emb.select("idx", "word", "vec"), _six_digits, "string")
    rows = texts.select(
        (F.col("idx") + 1).alias("line_no"),
        F.concat_ws(" ", "word", "vec").alias("value"),
    )
    header = emb.agg(
        F.lit(0).cast("bigint").alias("line_no"),
        F.concat_ws(
            " ", F.count("*").cast("string"), F.max(F.size("vec")).cast("string")
        ).alias("value"),
    )
    return header.unionAll(rows)


def write_word2vec(emb: DataFrame, path: str, encoding: str = "utf-8") -> None:
    """Write a folder of text parts that, read in name order, form one file."""
    known = encoding_of(encoding)
    ordered = format_word2vec_lines(emb).orderBy("line_no")
    if known.charset is not None:
        ordered = ordered.withColumn("value", F.encode("value", known.charset))
    elif not known.plain:
        ordered = encoded(ordered.withColumn("value", F.col("value").cast("binary")), known)
    written = ordered.select(F.col("value").cast("string").alias("value")).write
    written.text(path, lineSep=known.line_break())


def training_log(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """The iterations of a self-learning run as a table."""
    return spark.createDataFrame(rows, LOG_SCHEMA)


def format_training_log(log: DataFrame) -> DataFrame:
    """(iteration, value): tab-separated report lines, in percent.

    The validation columns are one empty field when nothing was validated.
    """

    def fixed(c):
        return F.format_string("%.6f", F.col(c))

    validated = F.concat_ws(
        "\t", fixed("val_similarity"), fixed("val_accuracy"), fixed("val_coverage")
    )
    middle = F.when(F.col("val_accuracy").isNotNull(), validated).otherwise("")
    return log.select(
        "iteration",
        F.concat_ws(
            "\t",
            F.col("iteration").cast("string"),
            fixed("objective"),
            middle,
            fixed("seconds"),
        ).alias("value"),
    )


def write_training_log(log: DataFrame, path: str) -> None:
    # a log has one row per iteration: a single ordered part
    lines = format_training_log(log).orderBy("iteration").coalesce(1)
    lines.select("value").write.text(path)


def append_training_log(log: DataFrame, path: str) -> None:
    """Write each row of ``log`` to its own folder ``iteration=...`` under ``path``, at once.

    A turn's row is there as soon as the turn has ended, whatever becomes of the run.
    """
    lines = format_training_log(log).withColumn("iteration", F.format_string("%06d", "iteration"))
    lines.coalesce(1).write.partitionBy("iteration").mode("append").text(path)
