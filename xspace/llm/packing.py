"""Packing documents into windows by non-negative least squares on the length histogram."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import session
from .common import settle, small_side
from .tokens import byte_tokens

END = (0).to_bytes(4, "little")


# -- tokens ------------------------------------------------------------------------


def _tokenised(docs: DataFrame, ranks: str, window: int) -> DataFrame:
    """(id, n, crc of the whole, crcs of full windows, crc of the rest) per row."""
    kind = docs.schema["id"].dataType
    schema = f"id {kind.simpleString()}, n long, whole long, fulls array<long>, rest_crc long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = byte_tokens(ranks)
        for batch in batches:
            n, whole, fulls, rest = [], [], [], []
            for text in batch.column("text"):
                ids = memoryview(tokens.encode(text.as_py() or "") + END)
                cut = len(ids) - len(ids) % (4 * window)
                n.append(len(ids) // 4)
                whole.append(zlib.crc32(ids))
                fulls.append([zlib.crc32(ids[i : i + 4 * window]) for i in range(0, cut, 4 * window)])
                rest.append(zlib.crc32(ids[cut:]))
            columns = [batch.column("id"), pa.array(n, pa.int64()), pa.array(whole, pa.int64()),
                       pa.array(fulls, pa.list_(pa.int64())), pa.array(rest, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "whole", "fulls", "rest_crc"])

    return docs.mapInArrow(run, schema)


def _cut_crcs(docs: DataFrame, ranks: str, window: int) -> DataFrame:
    """Crcs of the given segments of the rests of a few documents; segs: (at, length) within the rest."""
    kind = docs.schema["id"].dataType
    schema = f"id {kind.simpleString()}, n long, whole long, at long, crc long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = byte_tokens(ranks)
        for batch in batches:
            out = []
            for id_, text, n, whole, segs in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "n", "whole", "segs"))):
                ids = memoryview(tokens.encode(text or "") + END)
                if len(ids) // 4 != n or zlib.crc32(ids) != whole:
                    continue  # another row with the same id
                rest = ids[len(ids) - len(ids) % (4 * window) :]
                out += [(id_, n, whole, s["at"], zlib.crc32(rest[4 * s["at"] : 4 * (s["at"] + s["length"])])) for s in segs]
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], batch.schema.field("id").type), *[pa.array(c, pa.int64()) for c in columns[1:]]],
                ["id", "n", "whole", "at", "crc"],
            )

    return docs.mapInArrow(run, schema)


# -- the plan of window fillings ---------------------------------------------------


def fillings(window: int) -> list[tuple[int, ...]]:
    """Shallow combinations of lengths that fill a window: two lengths, three and four.

    (a, b); (a, a, b); (a, 2a, b); (a, a, a, b): each has one free length, so their number
    is at most 2 x window whatever the corpus.
    """
    shapes = ((1,), (1, 1), (1, 2), (1, 1, 1))
    found = set()
    for shape in shapes:
        for a in range(1, window):
            last = window - a * sum(shape)
            if last > 0:
                found.add(tuple(sorted([*(a * k for k in shape), last])))
    return sorted(found)


def nonnegative_counts(hist: np.ndarray, combos, rounds: int = 2000) -> np.ndarray:
    """Least squares x >= 0 with (lengths used by x) near ``hist``, by accelerated projected gradient."""
    parts = np.array([p for combo in combos for p in combo])
    owner = np.array([k for k, combo in enumerate(combos) for _ in combo])
    used = lambda x: np.bincount(parts, x[owner], len(hist))
    back = lambda r: np.bincount(owner, r[parts], len(combos))
    v = np.ones(len(combos))
    for _ in range(50):  # the largest eigenvalue bounds the step
        v = back(used(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - back(used(y) - hist) / (1.01 * top))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan_windows(hist: np.ndarray, window: int):
    """Slots of the planned windows, and where the unplanned rests of each length begin.

    Returns (slots, first, sequences): slots are (length, low, high, sequence, offset):
    the rests of that length numbered low .. high-1 go to sequence, sequence + 1, ...
    at that offset; ``first[length]`` rests are planned.
    """
    combos = [c for c in fillings(window) if all(hist[p] for p in c)]
    first = np.zeros(len(hist), dtype=np.int64)
    slots, sequences = [], 0
    if combos:
        x = nonnegative_counts(hist.astype(float), combos)
        left = hist.copy()
        # rounding may overdraw a length: take the largest counts first, what is left of them,
        # and then what rounding down has freed
        order = np.argsort(-x, kind="stable")
        counts = np.zeros(len(combos), dtype=np.int64)
        for limit in (np.floor(x + 1e-6), np.ceil(x)):
            for k in order:
                lengths, times = np.unique(combos[k], return_counts=True)
                more = min(int(limit[k] - counts[k]), int((left[lengths] // times).min()))
                if more > 0:
                    counts[k] += more
                    left[lengths] -= more * times
        for k in np.flatnonzero(counts):
            offset = 0
            for length in combos[k]:
                slots.append((length, int(first[length]), int(first[length] + counts[k]), sequences, offset))
                first[length] += counts[k]
                offset += length
            sequences += int(counts[k])
    return slots, first, sequences


def tail_cuts(total: int, window: int) -> list[int]:
    """Places that cut the last, partly filled window of a stream into powers of two."""
    at, cuts, rest = total - total % window, [], total % window
    for bit in range(window.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            at += 1 << bit
            cuts.append(at)
    return cuts


# -- the job -----------------------------------------------------------------------


def _numbered(rows: DataFrame) -> DataFrame:
    """Number the rests of equal length and sum up the full windows before each row.

    Two levels: rows within buckets, then one small row per bucket (and length).
    """
    spark = rows.sparkSession
    buckets = max(session.shuffle_partitions(spark), rows.count() // 200_000 + 1)
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    full = F.size("fulls").cast("long")
    by_length = dealt.groupBy("r", "bucket").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("r").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    lengths = by_length.select("r", "bucket", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("r_base"))
    by_bucket = dealt.groupBy("bucket").agg(F.sum(full).alias("f"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    fulls = by_bucket.select("bucket", F.coalesce(F.sum("f").over(earlier), F.lit(0)).alias("f_base"))
    in_order = Window.partitionBy("bucket").orderBy("row")
    return (
        dealt.withColumn("f_run", F.sum(full).over(in_order) - full)
        .withColumn("r_run", F.row_number().over(Window.partitionBy("bucket", "r").orderBy("row")) - 1)
        .join(settle(lengths), ["r", "bucket"])
        .join(settle(fulls), "bucket")
        .withColumn("rank", F.col("r_base") + F.col("r_run"))
        .withColumn("full_before", F.col("f_base") + F.col("f_run"))
        .select(*rows.columns, "rank", "full_before")
    )


def pack(
    docs: DataFrame,
    ranks: str,
    window: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces (id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents.

    A document is its ids and an end id 0 (null and empty texts: the end id alone).
    Full windows of a document stay whole. The histogram of the rests (``window`` bins)
    is all that the driver sees: shallow combinations of lengths that fill a window get
    repeat counts by non-negative least squares, rounded; the rests they do not use
    follow each other in one stream cut at window ends, and the end of that stream is
    cut into sequences of a power of two, so no id of padding is needed. ``window``
    must be a power of two. Repeated rows are packed each for itself; an empty table
    gives no pieces.
    """
    if window & (window - 1) or window < 2:
        raise ValueError("window must be a power of two")
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rest = (F.col("n") % window).cast("int")
    rows = settle(
        _tokenised(source, ranks, window).withColumn("r", rest).withColumn("row", F.monotonically_increasing_id())
    )
    hist = np.zeros(window, dtype=np.int64)
    for r in rows.where("r > 0").groupBy("r").count().collect():  # at most window - 1 rows
        hist[r["r"]] = r["count"]
    slots, first, planned = plan_windows(hist, window)
    # the stream of unplanned rests: longest first, each length's stretch known from the histogram
    stream, at = [], 0
    for length in range(window - 1, 0, -1):
        if hist[length] > first[length]:
            stream.append((length, int(first[length]), int(hist[length]), at))
            at += int(hist[length] - first[length]) * length
    cuts = tail_cuts(at, window)
    whole_windows = at // window

    numbered = settle(_numbered(rows))
    rests = numbered.where("r > 0")
    slot = spark.createDataFrame(slots, "r int, low long, high long, sequence long, offset long")
    in_slot = (rests["r"] == slot["r"]) & (rests["rank"] >= slot["low"]) & (rests["rank"] < slot["high"])
    out = ["id", "start", "length", "crc", "n", "sequence_id", "offset"]
    placed = rests.join(F.broadcast(slot), in_slot).select(  # slots: at most 8 x window
        "id", (F.col("n") - rests["r"]).alias("start"), rests["r"].cast("long").alias("length"),
        F.col("rest_crc").alias("crc"), "n",
        (slot["sequence"] + F.col("rank") - slot["low"]).alias("sequence_id"), slot["offset"],
    )
    full = numbered.select("id", "n", "full_before", F.posexplode("fulls").alias("k", "crc")).select(
        "id", (F.col("k") * F.lit(window).cast("long")).alias("start"), F.lit(window).cast("long").alias("length"),
        "crc", "n", (F.col("full_before") + F.col("k") + planned + whole_windows + len(cuts)).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )

    lane = spark.createDataFrame(stream, "r int, low long, high long, base long")
    in_lane = (rests["r"] == lane["r"]) & (rests["rank"] >= lane["low"]) & (rests["rank"] < lane["high"])
    begin = lane["base"] + (F.col("rank") - lane["low"]) * lane["r"]
    laid = rests.join(F.broadcast(lane), in_lane).select(
        "row", "id", "n", "whole", "rest_crc", rests["r"].alias("r"), begin.alias("a"), (begin + rests["r"]).alias("b")
    )
    tail = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    ends = F.array_sort(
        F.array_union(
            F.filter(F.concat(F.transform(F.sequence(F.floor(F.col("a") / window), F.floor(F.col("b") / window)),
                                          lambda k: k * window), tail),
                     lambda c: (c > F.col("a")) & (c < F.col("b"))),
            F.array("b"),
        )
    )
    segs = laid.withColumn("ends", ends).select("*", F.posexplode("ends").alias("k", "end")).withColumn(
        "from", F.when(F.col("k") == 0, F.col("a")).otherwise(F.expr("ends[greatest(k - 1, 0)]"))
    )
    last = whole_windows * window
    behind = F.size(F.filter(tail, lambda c: c <= F.col("from")))
    tail_start = F.when(behind == 0, F.lit(last)).otherwise(F.element_at(tail, F.greatest(behind, F.lit(1))))
    in_tail = F.col("from") >= last
    segs = settle(
        segs.select(
            "row", "id", "n", "whole", "rest_crc", "r",
            (F.col("from") - F.col("a")).alias("at"),
            (F.col("end") - F.col("from")).alias("length"),
            F.when(in_tail, F.lit(planned + whole_windows) + behind)
            .otherwise(F.lit(planned) + F.floor(F.col("from") / window)).cast("long").alias("sequence_id"),
            F.when(in_tail, F.col("from") - tail_start).otherwise(F.col("from") % window).cast("long").alias("offset"),
        )
    )
    uncut = segs.where("length = r").withColumn("crc", F.col("rest_crc"))
    cut = segs.where("length < r")
    wanted = settle(
        cut.groupBy("id", "n", "whole").agg(F.collect_set(F.struct("at", "length")).alias("segs"))
    )
    texts = source.join(small_side(wanted.withColumnRenamed("id", "_id"), 400), source["id"].eqNullSafe(F.col("_id")))
    crcs = settle(_cut_crcs(texts.select("id", "text", "n", "whole", "segs"), ranks, window)).distinct()
    key = cut.withColumnRenamed("id", "_id")
    same = (
        key["_id"].eqNullSafe(crcs["id"]) & (key["n"] == crcs["n"]) & (key["whole"] == crcs["whole"]) & (key["at"] == crcs["at"])
    )
    recut = key.join(crcs, same).select(key["_id"].alias("id"), key["n"], key["r"], key["at"], key["length"], "sequence_id", "offset", "crc")
    loose = uncut.select("id", "n", "r", "at", "length", "sequence_id", "offset", "crc").unionByName(recut).select(
        "id", (F.col("n") - F.col("r") + F.col("at")).alias("start"), "length", "crc", "n", "sequence_id", "offset"
    )
    pieces = full.select(*out).unionByName(placed.select(*out)).unionByName(loose.select(*out))
    return pieces.select(
        F.col("id").alias(id_col), F.col("start").cast("long"), F.col("length").cast("long"),
        F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"),
        F.col("sequence_id").cast("long"), F.col("offset").cast("long"),
    )
