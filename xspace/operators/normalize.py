"""Normalisation of embedding tables (idx, word, vec)."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import tiles

# Whole-row arithmetic over Arrow batches: chains of array lambdas are interpreted
# element by element and measured several times slower.


def _unit(m, _):
    norms = np.sqrt((m * m).sum(axis=1))
    norms[norms == 0] = 1
    return m / norms[:, None]


def _center(m, totals):
    rows, sums, _ = totals
    return m - sums / rows


def _unitdim(m, totals):
    norms = np.sqrt(totals[2])
    return m / np.where(norms == 0, 1, norms)


def _centeremb(m, _):
    return m - m.mean(axis=1)[:, None]


ACTIONS = {
    "unit": _unit,
    "center": _center,
    "unitdim": _unitdim,
    "centeremb": _centeremb,
}
# These need sums over the whole table first.
COLUMN_ACTIONS = ("center", "unitdim")


def normalize(df: DataFrame, actions: Iterable[str]) -> DataFrame:
    """Apply the actions left to right; ``none`` and unknown names do nothing.

    All actions run in one pass over the rows. ``center`` and ``unitdim`` each add
    one aggregation job when called, whose result is as wide as a vector; the other
    actions are row-wise, so they also take streams.
    """
    steps: list[tuple] = []
    for action in actions:
        if action in ACTIONS:
            totals = None
            if action in COLUMN_ACTIONS:
                totals = collect_sums(column_sums(df, steps))
            steps += steps_of(action, totals)
    if not steps:
        return df

    def change(m):
        return tiles.list_array(applied(m, steps).astype(m.dtype))

    return tiles.map_vectors(df, change, df.schema["vec"].dataType.simpleString())


def steps_of(action: str, totals) -> list[tuple]:
    """The step of an action, given the sums it needs; unknown names have none."""
    return [(ACTIONS[action], totals)] if action in ACTIONS else []


def applied(m, steps):
    m = m.astype(np.float64)
    for step, totals in steps:
        m = step(m, totals)
    return m


def column_sums(df: DataFrame, steps: list[tuple], at_once: int | None = None) -> DataFrame:
    """(pos, n, total, squares): rows, sums and sums of squares per dimension after ``steps``.

    A task adds up its rows, ``at_once`` at a time, and sends one array; the arrays are
    then added by dimension, so no reducer holds more than its share of the width.
    """

    def add_up(batches):
        rows, total, squares = 0, 0.0, 0.0
        for batch in batches:
            for a in range(0, batch.num_rows, at_once or batch.num_rows or 1):
                part = batch.slice(a, at_once or batch.num_rows)
                m = applied(tiles.matrix(part.column(0)), steps)
                rows += len(m)
                total = total + m.sum(axis=0)
                squares = squares + (m * m).sum(axis=0)
        if rows:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows]),
                    tiles.list_array(total[None, :]),
                    tiles.list_array(squares[None, :]),
                ],
                names=["n", "total", "squares"],
            )

    parts = df.select("vec").mapInArrow(
        add_up, "n bigint, total array<double>, squares array<double>"
    )
    cells = parts.selectExpr("n", "posexplode(arrays_zip(total, squares)) AS (pos, t)")
    return cells.groupBy("pos").agg(
        F.sum("n").alias("n"),
        F.sum("t.total").alias("total"),
        F.sum("t.squares").alias("squares"),
    )


def collect_sums(sums: DataFrame):
    """(rows, sums, sums of squares), as wide as a vector, on the driver."""
    table = sums.toArrow().sort_by("pos")
    if not table.num_rows:
        return 1, 0.0, np.float64(0.0)
    return (
        table["n"][0].as_py(),
        table["total"].to_numpy(),
        table["squares"].to_numpy(),
    )
