"""Exact all-pairs scoring of two vector tables, reduced inside the tasks.

Two physical routes with the same task code and the same results:

* broadcast - the smaller table is measured, fits ``spark.xspace.broadcastBytes``
  and is shipped to every task; the other table streams past it unshuffled.
* grid - neither table is small. Both are hashed into groups and each (group,
  group) cell becomes one partition: every row is copied once per group of the
  other side, so shuffled bytes grow with the number of groups, not of pairs.

Score tiles live only inside a task. What leaves it is k rows per table row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions import session, tiles
from ..functions.tiles import LogSumExp, TopK


@dataclass(frozen=True)
class Size:
    rows: int
    bytes: int


def measure(*tables: DataFrame) -> list[Size]:
    """Rows and vector bytes of tables of equal width: one count, one look."""
    counts = reduce(
        DataFrame.unionAll,
        [
            t.agg(F.count("*").alias("n")).select(F.lit(i).alias("i"), "n")
            for i, t in enumerate(tables)
        ],
    )
    rows = {r["i"]: r["n"] for r in counts.collect()}
    # an empty table has no width; its rows are none, but the others' count
    firsts = (t.select(F.size("vec")).head() for t in tables)
    width = next((f[0] for f in firsts if f), 0)

    def itemsize(t):
        return 4 if "float" in t.schema["vec"].dataType.simpleString() else 8

    return [Size(rows[i], rows[i] * width * itemsize(t)) for i, t in enumerate(tables)]


class PairScan:
    """A prepared pair of tables (idx, vec[, extra]); run it as often as needed.

    ``extra`` is a penalty or weight per row. The broadcast side is collected once,
    so iterating with changing maps costs one pass over the streamed side each.
    ``sizes`` saves measuring tables of known size; ``spread=False`` keeps small
    tables in the partitions they have.
    """

    def __init__(self, left: DataFrame, right: DataFrame, sizes=None, spread=True):
        self.spark = left.sparkSession
        self.left, self.right = self._shape(left), self._shape(right)
        self.sizes = sizes or measure(self.left, self.right)
        (self.left_rows, self.left_bytes), (self.right_rows, self.right_bytes) = (
            (s.rows, s.bytes) for s in self.sizes
        )
        self.limit = session.broadcast_limit(self.spark)
        self.held_is_left = self.left_bytes < self.right_bytes
        self.broadcasts = min(self.left_bytes, self.right_bytes) <= self.limit
        self._held = None
        self.spread = spread

    @staticmethod
    def _shape(df: DataFrame) -> DataFrame:
        extra = F.col("extra") if "extra" in df.columns else F.lit(0.0)
        return df.select("idx", "vec", extra.cast("double").alias("extra"))

    def beside(self, left: DataFrame, right: DataFrame) -> PairScan:
        """The same scan with penalties: the tables again, with ``extra``."""
        return PairScan(left, right, self.sizes)

    def _held_block(self):
        if self._held is None:
            # in order of id here, so that no task copies it to sort it
            table = (self.left if self.held_is_left else self.right).toArrow().sort_by("idx")
            self._held = self.spark.sparkContext.broadcast(
                (
                    table["idx"].to_numpy(),
                    tiles.matrix(table["vec"]),
                    table["extra"].to_numpy(),
                )
            )
        return self._held

    def run(self, jobs, left_map=None, right_map=None, held_extra=None, own_mean=0):
        """Rows (job, idx, nbr, score, aux) for a list of TopK / LogSumExp jobs.

        ``left_map`` / ``right_map`` multiply a side's vectors on the fly.
        ``held_extra`` (broadcast route) overrides the held side's penalties.
        """
        jobs = list(jobs)
        if self.broadcasts:
            return self._run_broadcast(jobs, left_map, right_map, held_extra, own_mean)
        return self._run_grid(jobs, left_map, right_map)

    def _run_broadcast(self, jobs, left_map, right_map, held_extra, own_mean):
        held_is_left = self.held_is_left
        held_map, stream_map = (
            (left_map, right_map) if held_is_left else (right_map, left_map)
        )
        stream = self.right if held_is_left else self.left
        if self.spread and max(self.left_bytes, self.right_bytes) <= self.limit:
            # small input: spread the arithmetic over all cores
            stream = stream.repartition(session.parallelism(self.spark))
        held_side = "left" if held_is_left else "right"
        if any(job.side == held_side for job in jobs):
            # each task sends its state of every held row: as many tasks as run at once
            stream = stream.coalesce(session.parallelism(self.spark))
        block = self._held_block()
        extra = (
            None
            if held_extra is None
            else self.spark.sparkContext.broadcast(np.asarray(held_extra))
        )

        def scan(batches):
            ids, mat, own = block.value
            if held_map is not None:
                mat = mat @ held_map.astype(mat.dtype)
            held = (ids, mat, own if extra is None else extra.value)

            def blocks():
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    m = tiles.matrix(batch.column(1))
                    if stream_map is not None:
                        m = m @ stream_map.astype(m.dtype)
                    yield (
                        batch.column(0).to_numpy(),
                        m,
                        batch.column(2).to_numpy(zero_copy_only=False),
                    )

            if len(ids):
                yield from tiles.scan_tiles(jobs, held, blocks(), held_is_left, own_mean)

        return stream.mapInArrow(scan, tiles.SCAN_SCHEMA)

    def _run_grid(self, jobs, left_map, right_map):
        held_is_left = self.held_is_left
        held, stream = (
            (self.left, self.right) if held_is_left else (self.right, self.left)
        )
        held_map, stream_map = (
            (left_map, right_map) if held_is_left else (right_map, left_map)
        )
        held_bytes, stream_bytes = sorted((self.left_bytes, self.right_bytes))
        held_groups = max(1, math.ceil(held_bytes / self.limit))
        stream_groups = max(
            math.ceil(session.parallelism(self.spark) / held_groups),
            math.ceil(stream_bytes / (4 * self.limit)),
        )
        cells = grid(held, stream, held_groups, stream_groups)

        def scan(batches):
            block, rest = tiles.split_sides(batches, held_map, stream_map)
            if block is not None:
                yield from tiles.scan_tiles(jobs, block, rest, held_is_left)

        return cells.mapInArrow(scan, tiles.SCAN_SCHEMA)


def grid(held: DataFrame, stream: DataFrame, held_groups: int, stream_groups: int):
    """One partition per (held group, stream group), held rows in front.

    Groups come from a hash of the unique ``idx``, so they are even.
    """
    return _cells(held, stream, held_groups, stream_groups, _hashed(held_groups))


def grid_by_range(table: DataFrame, rows: int, held_groups: int, stream_groups: int):
    """A table against itself, the held groups being runs of its dense ``idx``."""
    run = f"int(idx div {max(1, math.ceil(rows / held_groups))})"
    return _cells(table, table, held_groups, stream_groups, run)


def _hashed(groups: int) -> str:
    return f"int(pmod(xxhash64(idx), {groups}))"


def _cells(held, stream, held_groups, stream_groups, held_group):
    def placed(df, side, group, copies, cell):
        copied = df.selectExpr(
            f"tinyint({side}) AS side",
            "idx",
            "vec",
            "extra",
            f"{group} AS grp",
            f"explode(sequence(0, {copies - 1})) AS copy",
        )
        return copied.selectExpr("side", "idx", "vec", "extra", f"{cell} AS cell")

    both = placed(
        held, 0, held_group, stream_groups, f"grp * {stream_groups} + copy"
    ).unionAll(
        placed(
            stream,
            1,
            _hashed(stream_groups),
            held_groups,
            f"copy * {stream_groups} + grp",
        )
    )
    return (
        both.repartitionById(held_groups * stream_groups, "cell")
        .sortWithinPartitions("side", "idx")
        .select("side", "idx", "vec", "extra")
    )


def reduce_top(partials: DataFrame, k: int) -> DataFrame:
    """Merge partial top-k rows to (job, idx, nbr, score, rank), ties to low nbr.

    With k = 1 the best plain similarity of the row comes along as ``best``.
    """
    if k == 1:
        # a partial aggregate on the map side, constant state per row
        merged = partials.groupBy("job", "idx").agg(
            F.expr("max(struct(score, -nbr AS neg))").alias("top"),
            F.max("aux").alias("best"),
        )
        return merged.selectExpr(
            "job", "idx", "-top.neg AS nbr", "top.score AS score", "best", "1 AS rank"
        )
    order = "row_number() OVER (PARTITION BY job, idx ORDER BY score DESC, nbr)"
    ranked = partials.select("job", "idx", "nbr", "score", F.expr(order).alias("rank"))
    return ranked.where(F.col("rank") <= k)


def top_neighbours(
    left: DataFrame,
    right: DataFrame,
    k: int = 1,
    alpha: float = 1.0,
    penalty: bool = False,
    side: str = "left",
    left_map=None,
    sizes=None,
) -> DataFrame:
    """Best ``k`` rows of the other table for each row of ``side``.

    Score is ``alpha * <l, r> - extra``, with ``extra`` taken from the other table
    when ``penalty`` is set. Returns (idx, nbr, score, rank[, best]).
    """
    scan = PairScan(left, right, sizes)
    raw = scan.run([TopK(side, k, alpha, penalty)], left_map=left_map)
    return reduce_top(raw, k).drop("job")


def best_similarity(left: DataFrame, right: DataFrame) -> DataFrame:
    """(idx, value): highest plain similarity of each left row."""
    return top_neighbours(left, right).select("idx", F.col("best").alias("value"))


def mean_from_top(top: DataFrame, k: int, columns: int) -> DataFrame:
    """(job, idx, value) from top-k rows; short rows are padded with the minimum."""
    if k <= columns:
        mean = F.expr(f"sum(score) / {k}")
        return top.groupBy("job", "idx").agg(mean.alias("value"))
    lowest = top.agg(F.min("score")).scalar()
    sums = top.groupBy("job", "idx").agg(
        F.sum("score").alias("total"), F.count("*").alias("n")
    )
    return sums.withColumn("low", lowest).selectExpr(
        "job", "idx", f"(total + ({k} - n) * low) / {k} AS value"
    )


def topk_mean(
    left: DataFrame, right: DataFrame, k: int, side: str = "left", sizes=None
) -> DataFrame:
    """(idx, value): mean of the k best similarities of each row of ``side``."""
    if k <= 0:
        table = left if side == "left" else right
        return table.select("idx", F.lit(0.0).alias("value"))
    return means_of_scan(PairScan(left, right, sizes), k, side).drop("job")


def means_of_scan(scan: PairScan, k: int, side: str = "left") -> DataFrame:
    """(job, idx, value): mean of the k best similarities, by a prepared scan."""
    columns = scan.right_rows if side == "left" else scan.left_rows
    top = reduce_top(scan.run([TopK(side, k)]), k)
    return mean_from_top(top, k, columns)


def log_partition(
    left: DataFrame, right: DataFrame, beta: float, weighted: bool = False, sizes=None
) -> DataFrame:
    """(idx, value): log sum over left rows of exp(beta * sim), per right row.

    Partial sums are rescaled to their common maximum, so no term overflows.
    """
    raw = PairScan(left, right, sizes).run([LogSumExp("right", beta, weighted)])
    # two aggregates with constant state; no row's partials are sorted or meet in one task.
    # Both read the partials, which cost a scan of all pairs: they are written once.
    raw = session.cut_lineage(raw.select("idx", "score", "aux"))
    top = raw.groupBy("idx").agg(F.max("score").alias("top"))
    total = F.expr("first(top) + ln(sum(aux * exp(score - top)))")
    return raw.join(top, "idx").groupBy("idx").agg(total.alias("value"))
