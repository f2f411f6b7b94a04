"""What filters remove in every order, by a Gray-code walk over their subsets.

Rows shrink to counts per part and failure mask (which filters a document fails). The
walk switches one filter at a time, keeps for each mask how many of the active filters
it fails, and updates the running survivors from the masks that enter or leave. The
2^k stored states answer every step of every order by a difference of two of them.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import settle, words_of

MOST_FILTERS = 7  # 5,040 orders; each part returns orders x filters rows
PARTS_AT_ONCE = 64
STEP_COLUMNS = ("kept", "removed", "redundant", "unique_fails")


def gray_walk(cells: np.ndarray) -> np.ndarray:
    """Survivors of each subset of filters: states[part, subset, count].

    ``cells[part, mask, count]`` holds what is counted of the documents that fail
    exactly the filters in ``mask``.
    """
    masks = np.arange(cells.shape[1])
    failing = np.zeros(len(masks), dtype=np.int64)  # active filters that a mask fails
    running = cells.sum(axis=1)
    states = np.empty_like(cells)
    states[:, 0] = running
    subset = 0
    for step in range(1, len(masks)):
        bit = step & -step  # the place in which this Gray code differs from the last
        subset ^= bit
        touched = masks[(masks & bit) > 0]
        if subset & bit:
            leaving = touched[failing[touched] == 0]
            failing[touched] += 1
            running = running - cells[:, leaving].sum(axis=1)
        else:
            failing[touched] -= 1
            entering = touched[failing[touched] == 0]
            running = running + cells[:, entering].sum(axis=1)
        states[:, subset] = running
    return states


class Orders:
    """The steps of every order of ``k`` filters, as subsets before and after each."""

    def __init__(self, names: str):
        self.names, k = names, len(names)
        self.full = (1 << k) - 1
        self.order, self.step, self.bit, self.before = [], [], [], []
        for order in permutations(range(k)):
            active = 0
            for at, f in enumerate(order):
                self.order.append("".join(names[i] for i in order))
                self.step.append(at + 1)
                self.bit.append(f)
                self.before.append(active)
                active |= 1 << f
        self.bit, self.before = np.array(self.bit), np.array(self.before)
        self.after = self.before | (1 << self.bit)
        # in how many orders exactly the filters of a subset come before a given other
        self.ways = np.array([factorial(n) * factorial(max(k - 1 - n, 0)) for n in (s.bit_count() for s in range(1 << k))])

    def report(self, states: np.ndarray) -> list[np.ndarray]:
        """Columns of ``STEP_COLUMNS``, one of each mark lost, and shapley: [part, step]."""
        n = states[:, :, 0]
        each = 1 << np.arange(len(self.names))
        fails = n[:, [0]] - n[:, each]
        unique = n[:, self.full ^ each] - n[:, [self.full]]
        shapley = np.stack(
            [((n[:, without] - n[:, without | bit]) * self.ways[without]).sum(axis=1)
             for bit in each for without in [np.flatnonzero((np.arange(len(self.ways)) & bit) == 0)]],
            axis=1,
        )
        lost = states[:, self.before] - states[:, self.after]
        removed = lost[:, :, 0]
        marks = [lost[:, :, m] for m in range(1, states.shape[2])]
        return [n[:, self.after], removed, fails[:, self.bit] - removed, unique[:, self.bit], *marks, shapley[:, self.bit]]


def subset_audit(cells: DataFrame, names: str, marks: list[str], part_col: str = "part") -> DataFrame:
    """One row per part, order of the filters and step, from counts per failure mask.

    ``cells``: part, mask (int, bit i set: the i-th of ``names`` fails), n, and a long
    column for each of ``marks``; rows of equal part and mask add up. Returns part,
    filter_order, step, kept, removed, redundant (failing, removed earlier),
    unique_fails (failing this filter only), ``<mark>_lost`` and shapley (removed by
    this filter, added over all orders). No rows, no parts.
    """
    k = len(names)
    if not 1 <= k <= MOST_FILTERS or len(set(names)) != k:
        raise ValueError(f"1 to {MOST_FILTERS} filters of different one-letter names")
    counted = ["n", *marks]
    per_mask = cells.groupBy(F.col(part_col).alias("part"), "mask").agg(*(F.sum(c).alias(c) for c in counted))
    # at most 2^k small rows a part
    per_part = per_mask.groupBy("part").agg(F.collect_list(F.struct("mask", *counted)).alias("cells"))
    out_columns = [*STEP_COLUMNS, *(f"{m}_lost" for m in marks), "shapley"]
    schema = f"{part_col} string, filter_order string, step int, " + ", ".join(f"{c} long" for c in out_columns)

    def steps(batches):
        orders = Orders(names)
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS_AT_ONCE):
                some = batch.slice(at, PARTS_AT_ONCE).to_pydict()
                grid = np.zeros((len(some["part"]), 1 << k, len(counted)), dtype=np.int64)
                for p, own in enumerate(some["cells"]):
                    for cell in own:
                        grid[p, cell["mask"]] = [cell[c] for c in counted]
                rows = len(orders.order)
                columns = [
                    pa.array(np.repeat(np.array(some["part"], dtype=object), rows), pa.string()),
                    pa.array(orders.order * len(grid), pa.string()),
                    pa.array(orders.step * len(grid), pa.int32()),
                    *(pa.array(c.ravel()) for c in orders.report(gray_walk(grid))),
                ]
                yield pa.RecordBatch.from_arrays(columns, [part_col, "filter_order", "step", *out_columns])

    return per_part.mapInArrow(steps, schema)


# -- the filters of training text ----------------------------------------------------

NAMES = "ABCDE"
TEXT_FILTERS = 4  # A-D depend on the text alone; E asks for equal texts


def text_failures(text: Column, words: Column) -> Column:
    """Failure mask of the filters A-D."""
    n_words, n_distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    conditions = (
        n_words < 200,
        100 * n_distinct < 50 * n_words,
        100 * capitals > 3 * F.length(text),
        text.rlike("[#$%&*|]"),
    )
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)), F.lit(0))


def failure_cells(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """(part, mask, n, good, toxic): documents per part and set of failed filters A-E.

    E fails where a row of a smaller id has the identical text (same SHA-256 and
    length), in any part. Null text is empty, a null part is the empty string. A row
    without an id fails no E, makes none fail and has no label; rows that repeat id
    and text count each. Of several labels of one id a 1 wins.

    Copies are counted before they are shuffled, by document and then by text, so a
    text or an id that holds a third of all rows is one small row per task.
    """
    read = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col), F.lit("")).alias("t"),
    ).withColumn("ws", words_of(F.col("t")))
    facts = settle(
        read.select(
            "id",
            "part",
            text_failures(F.col("t"), F.col("ws")).alias("mask"),
            F.unhex(F.sha2("t", 256)).alias("digest"),
            F.octet_length("t").alias("size"),
        )
    )
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
    )
    text = ["digest", "size", "part", "mask"]
    rows = facts.groupBy("id", *text).agg(F.count(F.lit(1)).alias("n"))
    no_mark = F.lit(0)
    known = rows.where("id IS NOT NULL").join(marks, "id", "left")
    known = known.select("id", *text, "n", F.coalesce("good", no_mark).alias("good"), F.coalesce("toxic", no_mark).alias("toxic"))
    nameless = rows.where("id IS NULL").select("id", *text, "n", no_mark.alias("good"), no_mark.alias("toxic"))
    kinds = known.unionByName(nameless).groupBy(*text, "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
        F.min("id").alias("least"),
        F.min_by("n", "id").alias("n_least"),
    )
    # a text has one row per part and label by now
    least = kinds.groupBy("digest", "size").agg(F.min("least").alias("first"))
    joined = kinds.join(least, ["digest", "size"])
    stay = F.col("nameless") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    split = joined.withColumn("stay", stay).select(
        "part",
        "good",
        "toxic",
        F.explode(
            F.array(
                F.struct(F.col("mask"), F.col("stay").alias("n")),
                F.struct((F.col("mask") + (1 << TEXT_FILTERS)).alias("mask"), (F.col("n") - F.col("stay")).alias("n")),
            )
        ).alias("c"),
    )
    return split.where("c.n > 0").groupBy("part", "c.mask").agg(
        F.sum("c.n").alias("n"),
        F.sum(F.col("c.n") * F.col("good")).alias("good"),
        F.sum(F.col("c.n") * F.col("toxic")).alias("toxic"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """What the filters A-E remove in each order, per part; see ``failure_cells``.

    An empty table gives no rows.
    """
    return subset_audit(failure_cells(docs, labels, **columns), NAMES, ["good", "toxic"])
