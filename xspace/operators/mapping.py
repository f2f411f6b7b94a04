"""Linear maps between two embedding tables: distributed fit, driver-sized algebra.

One weighted Gram matrix over the dictionary pairs holds everything any map needs,
so whitening, rotation, re-weighting, de-whitening and reduction are products of
width x width matrices, and each table is multiplied once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import session, tiles
from .lookup import lookup

RANK_TOLERANCE = 1e-10


# -- Gram matrices ---------------------------------------------------------------


def add_up(blocks):
    """Weighted Gram of a stream of (matrix, weights), as one numbered block."""
    total = None
    for m, weight in blocks:
        m = m.astype(np.float64, copy=False)
        part = (m * weight[:, None]).T @ m
        total = part if total is None else total + part
    if total is not None:
        yield _numbered(np.arange(len(total)), total)


def _gram_rows(batches):
    def blocks():
        for batch in batches:
            if batch.num_rows:
                *vecs, weight = batch.columns
                yield np.hstack([tiles.matrix(v) for v in vecs]), weight.to_numpy()

    return add_up(blocks())


def _sum_rows(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        for i, row in zip(batch.column(0).to_numpy(), tiles.matrix(batch.column(1))):
            sums[i] = sums[i] + row if i in sums else row
    if sums:
        ids = np.array(sorted(sums))
        yield _numbered(ids, np.stack([sums[i] for i in ids]))


def _numbered(ids, rows):
    return pa.RecordBatch.from_arrays(
        [pa.array(ids.astype(np.int32)), tiles.list_array(rows)], names=["i", "row"]
    )


def gram_rows(df: DataFrame, partials=_gram_rows) -> DataFrame:
    """Rows (i, row) of the weighted Gram of the leading vector columns of ``df``.

    The last column is the weight. Each task sends one partial matrix; the partials
    are then summed row by row over the cluster.
    """
    schema = "i int, row array<double>"
    partial = df.mapInArrow(partials, schema)
    # one key per matrix row: tasks hold at most their share of the rows
    tasks = session.shuffle_partitions(df.sparkSession)
    return partial.repartition(tasks, "i").mapInArrow(_sum_rows, schema)


def dictionary_vectors(
    src: DataFrame, trg: DataFrame, pairs: DataFrame, rows: int | None = None
) -> DataFrame:
    """(x, z, w): the two vectors of each dictionary pair and its multiplicity.

    A dictionary counted to be small is sent to the tables, which are then only
    scanned. A large one is joined by shuffle, splitting ids that partner very many
    others, on either side.
    """
    bag = pairs.select("src_idx", "trg_idx", F.col("w").cast("double").alias("w"))
    x = src.select(F.col("idx").alias("src_idx"), F.col("vec").alias("x"))
    z = trg.select(F.col("idx").alias("trg_idx"), F.col("vec").alias("z"))
    width = src.select(F.size("vec")).head()
    row_bytes = 24 + 8 * (width[0] if width else 0)
    rows = pairs.count() if rows is None else rows
    if rows * row_bytes <= session.broadcast_limit(pairs.sparkSession) / 4:
        xs = x.join(F.broadcast(bag), "src_idx")
        return z.join(F.broadcast(xs), "trg_idx").select("x", "z", "w")
    xs = lookup(bag, x, "src_idx")
    return lookup(xs, z, "trg_idx", counted=bag).select("x", "z", "w")


def joint_gram(src: DataFrame, trg: DataFrame, pairs: DataFrame) -> DataFrame:
    """(block, i, j, v): XtX, ZtZ and XtZ over the dictionary, by multiplicity."""
    rows = gram_rows(dictionary_vectors(src, trg, pairs))
    cells = rows.select(
        "i", (F.size("row") / 2).cast("int").alias("d"), F.posexplode("row")
    )
    i, j, d = F.col("i"), F.col("pos"), F.col("d")
    block = (
        F.when((i < d) & (j < d), "xx")
        .when((i >= d) & (j >= d), "zz")
        .when((i < d) & (j >= d), "xz")
    )
    return cells.where(block.isNotNull()).select(
        block.alias("block"),
        (i % d).alias("i"),
        (j % d).alias("j"),
        F.col("col").alias("v"),
    )


@dataclass(frozen=True)
class JointGram:
    xx: np.ndarray
    zz: np.ndarray
    xz: np.ndarray


def collect_joint_gram(
    src: DataFrame, trg: DataFrame, pairs: DataFrame, rows: int | None = None
) -> JointGram:
    """The Gram blocks on the driver: (2 * width) squared numbers."""
    return split_gram(gram_rows(dictionary_vectors(src, trg, pairs, rows)))


def split_gram(rows: DataFrame) -> JointGram:
    g = _collect_square(rows)
    d = len(g) // 2
    return JointGram(g[:d, :d], g[d:, d:], g[:d, d:])


def collect_gram(df: DataFrame) -> np.ndarray:
    """Plain Gram matrix of one table's vectors, on the driver."""
    return _collect_square(gram_rows(df.select("vec", F.lit(1.0).alias("w"))))


def _collect_square(rows: DataFrame) -> np.ndarray:
    table = rows.toArrow().sort_by("i")
    if not table.num_rows:
        raise ValueError("no dictionary pair is in both vocabularies")
    return tiles.matrix(table["row"])


# -- algebra on the Gram ---------------------------------------------------------


@dataclass(frozen=True)
class LinearMap:
    """Matrices for the two sides; None leaves a side unchanged."""

    src: np.ndarray
    trg: np.ndarray | None = None

    def to_df(self, spark: SparkSession, side: str = "src") -> DataFrame:
        m = self.src if side == "src" else self.trg
        rows = spark.createDataFrame(
            [(i, row.tolist()) for i, row in enumerate(m)], "i int, row array<double>"
        )
        return rows.select("i", F.posexplode("row").alias("j", "v"))


@dataclass(frozen=True)
class AdvancedMap(LinearMap):
    """The fused map together with its steps, for inspection."""

    src_whitening: np.ndarray | None = None
    trg_whitening: np.ndarray | None = None
    src_rotation: np.ndarray | None = None
    trg_rotation: np.ndarray | None = None
    singular_values: np.ndarray | None = None


def inverse_sqrt(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(G^-1/2, G^1/2, rank), restricted to the numerically non-zero eigenspace."""
    values, vectors_ = np.linalg.eigh((gram + gram.T) / 2)
    solid = values > RANK_TOLERANCE * max(values[-1], 0.0)
    root = np.sqrt(np.where(solid, values, 0.0))
    inverse = np.divide(1.0, root, out=np.zeros_like(root), where=solid)
    return (
        (vectors_ * inverse) @ vectors_.T,
        (vectors_ * root) @ vectors_.T,
        int(solid.sum()),
    )


def signed_svd(m: np.ndarray):
    """SVD with each left vector's largest entry positive, for repeatable output."""
    u, s, vt = np.linalg.svd(m)
    lead = u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])]
    sign = np.where(lead < 0, -1.0, 1.0)
    return u * sign, s, vt * sign[:, None]


def fit_orthogonal(gram: JointGram) -> LinearMap:
    """Rotation of the source that best matches the target over the dictionary."""
    u, _, vt = np.linalg.svd(gram.xz)
    return LinearMap(u @ vt)


def fit_unconstrained(gram: JointGram) -> LinearMap:
    """Least-squares map of the source onto the target."""
    if inverse_sqrt(gram.xx)[2] < len(gram.xx):
        raise ValueError("least squares needs as many independent pairs as dimensions")
    return LinearMap(np.linalg.solve(gram.xx, gram.xz))


def fit_advanced(
    gram: JointGram,
    whiten: bool = False,
    src_reweight: float = 0.0,
    trg_reweight: float = 0.0,
    src_dewhiten: str | None = None,
    trg_dewhiten: str | None = None,
    dim_reduction: int = 0,
) -> AdvancedMap:
    """Whiten, rotate both sides, re-weight, undo whitening, keep leading dimensions.

    Returns one fused matrix per side.
    """
    d = len(gram.xx)
    wx = wz = wx_back = wz_back = np.eye(d)
    if whiten:
        wx, wx_back, x_rank = inverse_sqrt(gram.xx)
        wz, wz_back, z_rank = inverse_sqrt(gram.zz)
        for side, rank in (("src", x_rank), ("trg", z_rank)):
            if rank < d and side in (src_dewhiten, trg_dewhiten):
                raise ValueError(
                    f"cannot undo whitening: the dictionary spans {rank} of {d} "
                    f"{side} dimensions"
                )
    u, s, vt = signed_svd(wx.T @ gram.xz @ wz)
    v = vt.T
    back = {
        None: np.eye(d),
        "src": u.T @ wx_back @ u,
        "trg": v.T @ wz_back @ v,
    }
    src = (wx @ u * s**src_reweight) @ back[src_dewhiten]
    trg = (wz @ v * s**trg_reweight) @ back[trg_dewhiten]
    if dim_reduction > 0:
        src, trg = src[:, :dim_reduction], trg[:, :dim_reduction]
    return AdvancedMap(src, trg, wx, wz, u, v, s)


# -- application -----------------------------------------------------------------


def apply_map(df: DataFrame, linear: np.ndarray | None) -> DataFrame:
    """Multiply every vector of the table; row-wise, so streams work as well."""
    if linear is None:
        return df

    def times(m):
        return tiles.list_array((m.astype(np.float64) @ linear).astype(m.dtype))

    return tiles.map_vectors(df, times, df.schema["vec"].dataType.simpleString())
