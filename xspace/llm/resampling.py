"""Importance resampling towards a target text, on hashed word n-grams.

Bucket numbers are CRC-32 remainders. CRC is linear: the CRC of a byte string is the
XOR of one number per byte, which depends on the byte and its distance from the end,
and of a constant for the length. Whole slices of text are hashed by looking these up
in a position table and folding each feature's span with ``bitwise_xor.reduceat``.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import settle, small_side

BLOCK = 256  # distances in the position table; longer spans are folded block by block
SPAN_BYTES = 1 << 20  # bytes of spans hashed by one array pass
SLICE_BYTES = 1 << 21  # text split by one array pass; one longer text is a pass of its own
ONES = np.uint32(0xFFFFFFFF)
POLYNOMIAL = 0xEDB88320  # of CRC-32, reflected


def _position_table() -> np.ndarray:
    """[distance from the end, byte] -> what the byte adds to the CRC register."""
    row = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        row = (row >> np.uint32(1)) ^ np.where(row & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    rows = [row]
    for _ in range(BLOCK - 1):  # one zero byte behind moves the register on
        rows.append((rows[-1] >> np.uint32(8)) ^ row[rows[-1] & np.uint32(255)])
    return np.stack(rows)


TABLE = _position_table()
FLAT = TABLE.ravel()
LENGTH = np.array([zlib.crc32(bytes(n)) for n in range(BLOCK + 1)], dtype=np.uint32)


def _xor_spans(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """XOR of the position entries of each span; lengths are 1 to BLOCK."""
    begins = np.cumsum(lengths) - lengths
    offset = np.arange(int(lengths.sum())) - np.repeat(begins, lengths)
    distance = np.repeat(lengths - 1, lengths) - offset
    entries = FLAT[distance * 256 + codes[np.repeat(starts, lengths) + offset]]
    return np.bitwise_xor.reduceat(entries, begins)


def _long_span(codes: np.ndarray, start: int, length: int) -> np.uint32:
    """CRC-32 of one span of more than BLOCK bytes.

    The first block takes what is left over from whole blocks. The register after a
    block enters the next one's first four bytes.
    """
    head = (length - 1) % BLOCK + 1
    register = int(_xor_spans(codes, np.array([start]), np.array([head]))[0] ^ LENGTH[head] ^ ONES)
    carry = TABLE[BLOCK - 4 :].tolist()
    for at in range(start + head, start + length, SPAN_BYTES):
        blocks = np.arange(at, min(at + SPAN_BYTES, start + length), BLOCK)
        for folded in _xor_spans(codes, blocks, np.full(len(blocks), BLOCK)).tolist():
            register = (
                folded
                ^ carry[3][register & 255]
                ^ carry[2][register >> 8 & 255]
                ^ carry[1][register >> 16 & 255]
                ^ carry[0][register >> 24]
            )
    return np.uint32(register) ^ ONES


def span_crcs(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 (unsigned) of each span of ``codes``; spans may overlap, none is empty."""
    out = np.empty(len(starts), dtype=np.uint32)
    short = np.flatnonzero(lengths <= BLOCK)
    cuts = np.searchsorted(np.cumsum(lengths[short]), np.arange(SPAN_BYTES, int(lengths[short].sum()), SPAN_BYTES))
    for some in np.split(short, cuts):
        if len(some):
            out[some] = _xor_spans(codes, starts[some], lengths[some]) ^ LENGTH[lengths[some]]
    for k in np.flatnonzero(lengths > BLOCK):
        out[k] = _long_span(codes, int(starts[k]), int(lengths[k]))
    return out


# -- words and features ----------------------------------------------------------------

# A-Z fold; words are made of digits, letters a-z and everything that is not ASCII.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[ord("0") : ord("9") + 1] = True
IN_WORD[ord("a") : ord("z") + 1] = True
IN_WORD[128:] = True


def word_spans(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, lengths, words per text) of all words of some texts.

    The bytes are folded, and each word is followed by one space, so that a run of
    words of one text is one span.
    """
    raw = FOLD[np.frombuffer(b"\n".join([*parts, b""]), dtype=np.uint8)]
    inside = IN_WORD[raw]
    behind = np.zeros_like(inside)
    behind[1:] = inside[:-1] & ~inside[1:]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    kept = inside | behind
    text_ends = np.cumsum([len(p) + 1 for p in parts])
    sizes = np.diff(np.searchsorted(np.flatnonzero(first), text_ends), prepend=0)
    raw[behind] = 32
    codes = raw[kept]
    starts = np.flatnonzero(first[kept])
    ends = np.flatnonzero(behind[kept])
    return codes, starts, ends - starts, sizes


def features(parts: list[bytes], longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(CRC-32 of every run of 1 to ``longest`` words, text by text; features and words per text)."""
    codes, starts, lengths, sizes = word_spans(parts)
    counts = [np.maximum(sizes - n + 1, 0) for n in range(1, longest + 1)]
    crcs, owners = [], []
    before = np.cumsum(sizes) - sizes
    for n, own in enumerate(counts, 1):
        at = np.repeat(before - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
        crcs.append(span_crcs(codes, starts[at], starts[at + n - 1] + lengths[at + n - 1] - starts[at]))
        owners.append(np.repeat(np.arange(len(sizes)), own))
    if longest == 1:
        return crcs[0], counts[0], sizes
    order = np.argsort(np.concatenate(owners), kind="stable")
    return np.concatenate(crcs)[order], sum(counts), sizes


def _text_slices(texts) -> Iterator[list[bytes]]:
    parts, held = [], 0
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        if parts and held + len(raw) > SLICE_BYTES:
            yield parts
            parts, held = [], 0
        parts.append(raw)
        held += len(raw)
    if parts:
        yield parts


def feature_table(docs: DataFrame, buckets: int, longest: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, n_features, buckets as little-endian 32-bit numbers) of every whole text."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def numbered(batches):
        for batch in batches:
            ids, at = batch.column(0), 0
            for parts in _text_slices(x.as_py() for x in batch.column(1)):
                crcs, counts, sizes = features(parts, longest)
                numbers = (crcs % np.uint32(buckets)).astype("<u4")
                ends = np.cumsum(counts)
                own = [numbers[e - c : e].tobytes() for e, c in zip(ends, counts)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(parts)), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(own, pa.binary())],
                    ["id", "n_words", "n_features", "buckets"],
                )
                at += len(parts)

    return source.mapInArrow(numbered, f"id {kind}, n_words long, n_features long, buckets binary")


def bucket_counts(table: DataFrame, buckets: int) -> np.ndarray:
    """Features per bucket; a task sends at most one row a bucket, the driver gets that many."""

    def counted(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for own in batch.column(0):
                total += np.bincount(np.frombuffer(own.as_buffer(), dtype="<u4"), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    rows = table.select("buckets").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for row in rows.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """floor(1000 ln(smoothed target share / smoothed raw share)) of each bucket."""
    many = len(raw)
    all_target, all_raw = int(target.sum()) + many, int(raw.sum()) + many
    return np.array(
        [
            math.floor(1000 * math.log((int(t) + 1) * all_raw / ((int(s) + 1) * all_target)))
            for t, s in zip(target, raw)
        ],
        dtype=np.int64,
    )


def weighted(table: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight): the floored mean gain of a document's features."""
    kind = table.schema["id"].dataType.simpleString()

    def means(batches):
        for batch in batches:
            counts = batch.column(2).to_numpy(zero_copy_only=False)
            own = [
                int(gain[np.frombuffer(b.as_buffer(), dtype="<u4")].sum()) // int(n) if n else 0
                for b, n in zip(batch.column(3), counts)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(own, pa.int64())], ["id", "n_words", "n_features", "weight"]
            )

    return table.mapInArrow(means, f"id {kind}, n_words long, n_features long, weight long")


# -- the draw --------------------------------------------------------------------------


def gumbel(seed: int, id_: Column) -> Column:
    """floor(1000 x standard Gumbel) drawn from the id; the same in every run."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def ranked(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """Add ``rank``: 1, 2, ... of the highest ``percent`` of the eligible rows, else null.

    ``scored`` is settled, with id and a whole-number score; ties go to the smaller id
    (null ids first). Scores are thousandths of logarithms, so their number is bounded
    by their range, whatever the table: one row for each gives the rows above it, and
    only rows of equal score are sorted, after copies have been counted.
    """
    fields = scored.columns
    able = scored.where(eligible)
    hist = settle(able.groupBy("score").agg(F.count(F.lit(1)).alias("_n")))
    total = hist.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    drawn = percent * total // 100
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = hist.select("score", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above"))
    offsets = small_side(settle(offsets.where(F.col("_above") < drawn)), 64)
    marked = scored.withColumn("_able", F.coalesce(eligible, F.lit(False)))
    least = F.lit(offsets.agg(F.min("score")).first()[0]).cast("long")
    inside = F.col("_able") & (F.col("score") >= least)
    rest = marked.where(~F.coalesce(inside, F.lit(False))).select(*fields, F.lit(None).cast("long").alias("rank"))
    copies = marked.where(inside).groupBy(*fields).agg(F.count(F.lit(1)).alias("_copies"))
    order = Window.partitionBy("score").orderBy("id", *(c for c in fields if c not in ("id", "score")))
    first = F.sum("_copies").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_copies")
    placed = copies.withColumn("_first", first).join(offsets, "score")
    each = placed.select(*fields, F.explode(F.expr("sequence(_above + _first + 1, _above + _first + _copies)")).alias("rank"))
    return rest.unionByName(each.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    min_words: int = 20,
    seed: int = 2024,
    buckets: int = 10_000,
    longest: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """(id, n_features, weight, score, rank), one row per row of ``docs``.

    Draws ``percent`` of the documents with at least ``min_words`` words, without
    replacement, by importance weight plus Gumbel noise. Null and wordless texts have
    no features and weight 0; a null id draws as the empty string; rows of equal id
    and text get ranks of their own. Empty tables give no rows, an empty target
    smoothed shares alone.
    """
    if not 1 <= buckets <= 1 << 20:
        raise ValueError("1 to 2^20 buckets: their counts go to the driver")
    own = settle(feature_table(docs, buckets, longest, id_col, text_col))
    aim = target.select(F.lit(0).alias("id"), F.col(target_text).alias("text"))
    wanted = feature_table(aim, buckets, longest, "id", "text")
    gain = gains(bucket_counts(wanted, buckets), bucket_counts(own, buckets))
    scored = settle(weighted(own, gain).withColumn("score", F.col("weight") + gumbel(seed, F.col("id"))))
    out = ranked(scored, F.col("n_words") >= min_words, percent)
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
