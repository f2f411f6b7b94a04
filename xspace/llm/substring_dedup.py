"""Repeated passages across documents, by winnowed anchors that are extended both ways."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import join_spread, settle, small_side
from .hashing import BASES, mixed, sequence_hashes, slices, split_words, starts_inside


class Anchors:
    """Winnowed seeds: of every window's ``length - seed + 1`` seeds the least by hash.

    Equal windows choose the equal seed at the equal place, so two documents that share
    a passage of ``length`` words share an anchor in it, and every window extends one
    anchor both ways.
    """

    def __init__(self, length: int, seed: int):
        self.length, self.seed = length, seed

    def of(self, words: np.ndarray, sizes: np.ndarray):
        """(text, flat start, anchor hash) of every window that lies in one text."""
        text, start = starts_inside(sizes, self.length)
        if not len(start):
            return text, start, np.zeros(0, dtype=np.int64)
        seeds = mixed(sequence_hashes(words, self.seed, BASES[0]))
        least, width, want = seeds, 1, self.length - self.seed + 1
        while width < want:  # minimum over ``want`` seeds by doubling
            step = min(width, want - width)
            least = np.minimum(least[: len(least) - step], least[step:])
            width += step
        return text, start, least[start].view(np.int64)


def _by_column(batch: pa.RecordBatch, *names: str):
    return [batch.column(n) for n in names]


def _anchor_rows(docs: DataFrame, anchors: Anchors) -> DataFrame:
    """(anchor, id): the anchors of every document; an anchor may come again later in a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = _by_column(batch, "id", "text")
            ids = ids.to_numpy(zero_copy_only=False)
            for first, words, sizes in slices(t.as_py() for t in texts):
                text, _, anchor = anchors.of(words, sizes)
                new = np.ones(len(anchor), dtype=bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[new]), pa.array(ids[first + text[new]])], ["anchor", "id"]
                )

    return docs.mapInArrow(run, "anchor long, id long")


def _window_rows(docs: DataFrame, anchors: Anchors) -> DataFrame:
    """(h1, h2, id, start) of the windows that extend one of the document's ``shared`` anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, shared = _by_column(batch, "id", "text", "shared")
            ids = ids.to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(shared.value_lengths().to_numpy(zero_copy_only=False))])
            values = shared.flatten().to_numpy(zero_copy_only=False)
            for first, words, sizes in slices(t.as_py() for t in texts):
                text, start, anchor = anchors.of(words, sizes)
                # anchors are compared per document: (document, anchor) as one mixed key
                own = np.arange(first, first + len(sizes))
                counts = ends[own + 1] - ends[own]
                part = values[ends[first] : ends[first + len(sizes)]]
                salted = lambda a, t: a.view(np.uint64) ^ mixed((t + 1).astype(np.uint64))
                hit = np.isin(salted(anchor, text), salted(part, np.repeat(np.arange(len(sizes)), counts)))
                text, start = text[hit], start[hit]
                hashes = [sequence_hashes(words, anchors.length, b)[start].view(np.int64) for b in BASES]
                begin = np.cumsum(sizes) - sizes
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, hashes), pa.array(ids[first + text]), pa.array((start - begin[text]).astype(np.int32))],
                    ["h1", "h2", "id", "start"],
                )

    return docs.mapInArrow(run, "h1 long, h2 long, id long, start int")


def _spans(starts: DataFrame, length: int) -> DataFrame:
    """(id, begins, ends): maximal stretches of words covered by windows at ``starts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begins, ends = [], []
            for s in batch.column("starts"):
                s = np.unique(s.values.to_numpy(zero_copy_only=False))
                gap = np.flatnonzero(s[1:] > s[:-1] + length)
                begins.append(s[np.concatenate([[0], gap + 1])])
                ends.append(s[np.concatenate([gap, [len(s) - 1]])] + length)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(begins, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))],
                ["id", "begins", "ends"],
            )

    lists = starts.groupBy("id").agg(F.collect_list("start").alias("starts"))
    return lists.mapInArrow(run, "id long, begins array<int>, ends array<int>")


def repeated_spans(docs: DataFrame, length: int = 13, seed: int = 6, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, begins, ends): the words covered by windows of ``length`` words met in a smaller id.

    1. Copies of a whole text: their spans need no search.
    2. Anchors of each other text; only anchors met in two documents go on.
    3. Each window around such an anchor is compared with the others of that anchor by
       a 128-bit hash of its words; the smallest id that has it decides.
    Joins carry one row per document and anchor (or window), never pairs of documents;
    frequent anchors and windows are split over tasks.
    """
    anchors = Anchors(length, seed)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    source = source.where("text IS NOT NULL")
    digests = settle(source.select("id", F.unhex(F.sha2("text", 256)).alias("digest")))
    least = digests.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = settle(digests.join(least, "digest").where("id > least").select(F.col("id").alias("copy")))
    firsts = source.join(small_side(copies, 64), F.col("id") == F.col("copy"), "left_anti")

    rows = _anchor_rows(firsts, anchors)
    least_largest = F.min("id").alias("a"), F.max("id").alias("z"), F.count(F.lit(1)).alias("k")
    met = settle(rows.groupBy("anchor").agg(*least_largest).where("a < z").select("anchor", "k"))
    shared = settle(
        join_spread(rows, met, ["anchor"], "k").groupBy("id").agg(F.collect_set("anchor").alias("shared"))
    )
    ids = small_side(settle(shared.select(F.col("id").alias("has"))), 64)
    some = firsts.join(ids, F.col("id") == F.col("has"), "left_semi")
    windows = _window_rows(some.join(shared, "id"), anchors)
    first = settle(windows.groupBy("h1", "h2").agg(*least_largest).where("a < z").select("h1", "h2", "a", "k"))
    repeated = join_spread(windows, first, ["h1", "h2"], "k").where("id > a").select("id", "start")
    found = _spans(repeated, length)
    whole = copies.select(
        F.col("copy").alias("id"), F.array(F.lit(0)).alias("begins"), F.array(F.lit(2**31 - 1)).alias("ends")
    )
    return found.unionByName(whole)


def _cut(docs: DataFrame, length: int) -> DataFrame:
    schema = "id long, n_words long, n_removed long, kept string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, kept = [], [], []
            for text, begins, ends in zip(*_by_column(batch, "text", "begins", "ends")):
                words = split_words(text.as_py())
                sizes.append(len(words))
                left, at = [], 0
                if begins.is_valid and len(words) >= length:
                    for b, e in zip(begins.as_py(), ends.as_py()):
                        left += words[at:b]
                        at = e
                left += words[at:]
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept)],
                ["id", "n_words", "n_removed", "kept"],
            )

    return docs.mapInArrow(run, schema)


def substring_dedup(docs: DataFrame, length: int = 13, seed: int = 6, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, n_words, n_removed, kept): texts without the words of repeated windows.

    A window is ``length`` words in a row; its words go if the same words start in a
    document with a smaller id. Windows are judged on the input, so the result does not
    depend on any order; repeats within one document stay. ``kept`` is the other words
    joined by one space. Null and short texts lose nothing; a row with a null id is
    neither cut nor searched; rows that share an id are cut where any of them repeats;
    an empty table gives no rows.
    """
    spans = settle(repeated_spans(docs, length, seed, id_col, text_col).groupBy("id").agg(
        F.flatten(F.collect_list("begins")).alias("begins"), F.flatten(F.collect_list("ends")).alias("ends")
    ))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    weight = spans.agg(F.coalesce(F.sum(F.size("begins") * 8 + 96), F.lit(0))).head()[0]
    side = small_side(spans.withColumnRenamed("id", "_id"), max(1, weight // max(1, spans.count())))
    return _cut(source.join(side, F.col("id") == F.col("_id"), "left").select("id", "text", "begins", "ends"), length)

