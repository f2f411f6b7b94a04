"""Near duplicates by Jaccard similarity of word n-grams, joined on parity sketches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import settle, small_side
from .graph import components
from .hashing import BASES, mixed, sequence_hashes, slices, starts_inside

SKETCH_BITS = 512  # larger sets have a second sketch with at least one bit an element
BLOCK_PART = 256  # members of a block that one task compares with the others
COMMON_SHARE = 1e-3  # of the documents: shingles of more are laid in blocks of their own
MOST_COMMON = 500_000
BAND = 4  # ratio of the set sizes of a band


# -- shingle sets ------------------------------------------------------------------


def shingle_sets(words: np.ndarray, sizes: np.ndarray, length: int):
    """(text, hash) of every distinct shingle, in order; a shorter text is one shingle."""
    text, start = starts_inside(sizes, length)
    hashes = mixed(sequence_hashes(words, length, BASES[0])[start]) if len(start) else np.zeros(0, np.uint64)
    begin = np.cumsum(sizes) - sizes
    short = np.flatnonzero((sizes > 0) & (sizes < length))
    if len(short):
        # words in turn; the count keeps them apart from shingles and from each other
        own = sizes[short].astype(np.uint64)
        for j in range(int(sizes[short].max())):
            here = sizes[short] > j
            own[here] = own[here] * BASES[1] + words[begin[short[here]] + j]
        at = np.searchsorted(text, short)
        text, hashes = np.insert(text, at, short), np.insert(hashes, at, mixed(own))
    ends = np.cumsum(np.bincount(text, minlength=len(sizes))).tolist()
    for low, high in zip([0, *ends], ends):  # short sorts in place are faster than one of all
        hashes[low:high].sort()
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    return text[new], hashes[new]


def _facts(docs: DataFrame, length: int) -> DataFrame:
    """(id, n, set1, set2, sketch, wide, common, counts): per document the size of its set, two
    digests of it, its parity sketch and that of a large set; now and then also the shingles
    frequent among recent documents."""
    schema = "id long, n long, set1 long, set2 long, sketch array<long>, wide array<long>, common array<long>, counts array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0

        def frequent():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts >= max(3, COMMON_SHARE * n_held)
            return values[keep].view(np.int64), counts[keep]

        for batch in batches:
            ids = batch.column("id")
            for first, words, sizes in slices((t.as_py() for t in batch.column("text")), lower=True):
                text, hashes = shingle_sets(words, sizes, length)
                n = np.bincount(text, minlength=len(sizes))
                bits = np.bincount(text * SKETCH_BITS + (hashes % SKETCH_BITS).astype(np.int64), minlength=len(sizes) * SKETCH_BITS)
                sketch = np.packbits((bits & 1).astype(np.uint8)).view("<i8")
                sums = [np.zeros(len(sizes), dtype=np.uint64) for _ in BASES]
                if len(text):
                    for total, base in zip(sums, BASES):
                        total[n > 0] = np.add.reduceat(mixed(hashes * base), (np.cumsum(n) - n)[n > 0])
                held.append(hashes)
                n_held += len(sizes)
                found = None
                if sum(map(len, held)) > 2_000_000:
                    found, held, n_held = frequent(), [], 0
                wide = wide_sketches(text, hashes, n)
                yield _fact_batch(ids.slice(first, len(sizes)), n, sums, sketch, wide, found)
        if held:
            yield _fact_batch(pa.array([None], pa.int64()), np.array([-1]), [np.zeros(1, np.uint64)] * 2, np.zeros(SKETCH_BITS // 64, "<i8"), [None], frequent())

    return docs.mapInArrow(run, schema)


def wide_sketches(text, hashes, n) -> list[np.ndarray | None]:
    """Parity sketches of the sets of more than SKETCH_BITS elements, as 64-bit words.

    The number of bits is the next power of two, so that a longer sketch folds to a
    shorter one: halves are joined by XOR.
    """
    out: list[np.ndarray | None] = [None] * len(n)
    ends = np.cumsum(n)
    for k in np.flatnonzero(n > SKETCH_BITS):
        size = 1 << int(n[k] - 1).bit_length()
        bits = np.bincount((hashes[ends[k] - n[k] : ends[k]] % np.uint64(size)).astype(np.int64), minlength=size)
        out[k] = np.packbits((bits & 1).astype(np.uint8)).view("<i8")
    return out


def _fact_batch(ids, n, sums, sketch, wide, found):
    lists = [None] * len(n), [None] * len(n)
    if found is not None:
        lists[0][-1], lists[1][-1] = found
    width = SKETCH_BITS // 64
    offsets = pa.array(np.arange(0, width * len(n) + 1, width, dtype=np.int32))
    columns = [ids, pa.array(n.astype(np.int64)), *[pa.array(s.view(np.int64)) for s in sums],
               pa.ListArray.from_arrays(offsets, pa.array(sketch)), pa.array(wide, pa.list_(pa.int64())), *[pa.array(x, pa.list_(pa.int64())) for x in lists]]
    return pa.RecordBatch.from_arrays(columns, ["id", "n", "set1", "set2", "sketch", "wide", "common", "counts"])


# -- sketch blocks -----------------------------------------------------------------


def most_different(n: np.ndarray, percent: int) -> np.ndarray:
    """Largest symmetric difference of a set of n elements and one it may link with.

    100 i >= p u and i, u = (a + b -+ d) / 2 give d <= (a + b)(100 - p) / (100 + p), and
    the larger set has at most 100 / p of the smaller one's elements.
    """
    return (n + n * 100 // percent) * (100 - percent) // (100 + percent)


def block_keys(text, hashes, n, common, percent: int):
    """(text, key): a pair that links has an equal key whatever its differing elements are.

    Each element falls into one block of a sketch by its hash; a block's value is the
    XOR of its elements, so a block without a differing element is equal on both sides
    and each differing element spoils one block. With d differing elements, of the
    first d + 1 blocks that are not empty (on the side where these end first) at least
    one is equal. Elements of many documents lie in blocks of their own behind the
    others. Sketches have as many blocks for every size of a band; sets that may link
    with one of the next band are also laid out as that band's.
    """
    out = []
    often = np.zeros(len(hashes), dtype=bool)
    if len(common):
        often = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
    band = np.zeros(len(n), dtype=np.int64)
    top = np.full(len(n), BAND - 1, dtype=np.int64)
    while (n > top).any():
        band[n > top] += 1
        top = BAND ** (band + 1) - 1
    for shift in (0, 1):
        chosen = n > 0 if not shift else n * 100 // percent > top
        placed = np.zeros(len(n), dtype=np.int64)  # blocks of each text so far
        for behind in (False, True):
            use = chosen[text] & (often == behind)
            t, h = text[use], hashes[use]
            if not len(t):
                continue
            own = band[t] + shift
            # small sets: every element is a block; others about one to two elements in a
            # block. Elements are in order, and so are the blocks they fall into.
            blocks = (BAND ** (own + 1) // 2).astype(np.uint64)
            block = np.where(own < 4, h, ((h >> np.uint64(32)) * blocks) >> np.uint64(32))
            begins = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (block[1:] != block[:-1])]))
            value = np.bitwise_xor.reduceat(h, begins)
            t, block, own = t[begins], block[begins], own[begins]
            first = np.concatenate([[True], t[1:] != t[:-1]])
            rank = np.arange(len(t)) - np.maximum.accumulate(np.where(first, np.arange(len(t)), 0)) + placed[t]
            placed += np.bincount(t, minlength=len(n))
            keep = rank <= most_different(n[t], percent)
            kind = (own * 2 + behind).astype(np.uint64)
            key = mixed(value ^ mixed(block + BASES[1] * kind))
            out.append((t[keep], key[keep].view(np.int64)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _keys(docs: DataFrame, common, length: int, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for first, words, sizes in slices((t.as_py() for t in batch.column("text")), lower=True):
                text, hashes = shingle_sets(words, sizes, length)
                n = np.bincount(text, minlength=len(sizes))
                t, key = block_keys(text, hashes, n, common.value, percent)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[first + t])], ["key", "id"])

    return docs.mapInArrow(run, "key long, id long")


# -- candidates and their check ------------------------------------------------------


def _plausible(a: str, b: str, percent: int) -> Column:
    """Sizes and sketches allow the pair: the sketches' Hamming distance is at most the
    symmetric difference."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    sizes = (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b))
    apart = reduce(
        lambda x, j: x + F.bit_count(F.col(f"{a}.sketch")[j].bitwiseXOR(F.col(f"{b}.sketch")[j])),
        range(SKETCH_BITS // 64), F.lit(0),
    )
    return sizes & (apart * (100 + percent) <= (n_a + n_b) * (100 - percent))


def _verified(pairs: DataFrame, texts: DataFrame, length: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (u, v) whose whole texts link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets_of(texts):
            for _, words, sizes in slices(texts, lower=True):
                text, hashes = shingle_sets(words, sizes, length)
                yield from np.split(hashes, np.searchsorted(text, np.arange(1, len(sizes))))

        for batch in batches:
            linked = np.zeros(len(batch), dtype=bool)
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                u = part.column("u").to_numpy()
                new = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))  # rows come sorted by u
                own = dict(zip(new.tolist(), sets_of(part.column("t1")[k].as_py() for k in new.tolist())))
                left = None
                for k, right in enumerate(sets_of(t.as_py() for t in part.column("t2"))):
                    left = own.get(k, left)
                    both = len(np.intersect1d(left, right, assume_unique=True))
                    linked[at + k] = both > 0 and 100 * both >= percent * (len(left) + len(right) - both)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).filter(pa.array(linked)) for c in ("u", "v")], ["u", "v"]
            )

    left = texts.select(F.col("id").alias("u"), F.col("text").alias("t1"))
    right = texts.select(F.col("id").alias("v"), F.col("text").alias("t2"))
    joined = pairs.select("u", "v").join(right, "v").join(left, "u").select("u", "v", "t1", "t2")
    return settle(joined.mapInArrow(run, "u long, v long"))


def _likely(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """(u, v, both): the pairs that sizes and sketches allow, with the sum of the sizes."""
    a = facts.select(F.col("id").alias("u"), F.struct("n", "sketch").alias("a"))
    b = facts.select(F.col("id").alias("v"), F.struct("n", "sketch").alias("b"))
    near = pairs.join(a, "u").join(b, "v").where(_plausible("a", "b", percent))
    return _allowed_wide(near.select("u", "v", (F.col("a.n") + F.col("b.n")).alias("both")), facts, percent)


def _allowed_wide(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (u, v, both) whose wide sketches allow it too.

    Sketches of equal length, or of twice the length and folded, are compared; a pair
    without two such sketches stays.
    """
    wide = facts.where("wide IS NOT NULL")
    a = wide.select(F.col("id").alias("u"), F.col("wide").alias("x"))
    b = wide.select(F.col("id").alias("v"), F.col("wide").alias("y"))
    least = F.least(F.size("x"), F.size("y"))
    xor = lambda p, q: p.bitwiseXOR(q)
    fold = lambda c: F.when(
        F.size(c) > least, F.zip_with(F.slice(c, 1, least), F.slice(c, least + 1, least), xor)
    ).otherwise(F.col(c))
    apart = F.aggregate(F.zip_with(fold("x"), fold("y"), xor), F.lit(0), lambda n, w: n + F.bit_count(w))
    known = F.col("x").isNotNull() & F.col("y").isNotNull() & (F.greatest(F.size("x"), F.size("y")) <= 2 * least)
    far = F.when(known, apart * (100 + percent) > F.col("both") * (100 - percent)).otherwise(False)
    return settle(pairs.join(a, "u", "left").join(b, "v", "left").where(~far).select("u", "v", "both"))


def _checked(likely: DataFrame, source: DataFrame, length: int, percent: int) -> DataFrame:
    ids = likely.select(F.col("u").alias("has")).unionByName(likely.select(F.col("v").alias("has"))).distinct()
    texts = source.join(small_side(settle(ids), 64), F.col("id") == F.col("has"), "left_semi")
    return _verified(likely, texts, length, percent)


def jaccard_groups(
    docs: DataFrame, length: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_shingles, component_id): near-duplicate classes of all documents.

    Two documents link when 100 x common shingles >= ``percent`` x shingles of either;
    a class is what links reach, named by its least id. Words are lower-cased in A-Z.

    1. Documents of one set are one member of what follows.
    2. Documents that may link share a sketch block (``block_keys``). Every document of
       a block is compared with the block's least and its largest id; what this links
       is put together.
    3. Of the other documents of a block only pairs in different classes are compared:
       a group of copies never becomes all its pairs.
    Sizes and parity sketches rule out most candidates before whole texts are compared.

    Texts without words, and null texts, have no shingles and link with nothing. A null
    id gets a null class. Rows that share an id count as one document in the least row's
    form. An empty table gives no rows.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    raw = settle(_facts(source, length))
    rows = raw.where("n >= 0")
    total = rows.count()
    listed = raw.where("common IS NOT NULL").select(F.explode(F.arrays_zip("common", "counts")).alias("c"))
    often = listed.groupBy(F.col("c.common").alias("h")).agg(F.sum("c.counts").alias("k"))
    # any set of shingles is right here, as it only orders blocks; so its size can be bounded
    often = often.where(F.col("k") >= max(8, COMMON_SHARE * total)).orderBy(F.desc("k"), "h").limit(MOST_COMMON)
    common = np.sort(np.array([r[0] for r in often.select("h").collect()], dtype=np.int64).view(np.uint64))
    common = spark.sparkContext.broadcast(common)

    distinct = rows.where("id IS NOT NULL AND n > 0").groupBy("id").agg(
        F.min(F.struct("n", "set1", "set2", "sketch", "wide")).alias("f")
    ).select("id", "f.*")
    least = distinct.groupBy("n", "set1", "set2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("k")).where("k > 1")
    copies = settle(distinct.join(least, ["n", "set1", "set2"]).where("id > rep").select("id", "rep"))
    facts = settle(distinct.join(copies, "id", "left_anti").select("id", "n", "sketch", "wide"))
    gone = small_side(copies.select(F.col("id").alias("copy")), 64)
    source = source.where("id IS NOT NULL AND text IS NOT NULL").join(gone, F.col("id") == F.col("copy"), "left_anti")

    keys = settle(_keys(source, common, length, percent))
    shared = keys.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z")
    members = settle(keys.join(shared, "key"))
    stars = members.select(F.col("a").alias("u"), F.col("id").alias("v")).unionByName(
        members.select(F.col("id").alias("u"), F.col("z").alias("v"))
    )
    compared = _likely(stars.where("u <> v").distinct(), facts, percent)
    found = _checked(compared, source, length, percent)
    labels = components(found)

    # blocks that hold several classes: the pairs that neither the least nor the largest id has settled
    others = members.where("id <> a AND id <> z").select("key", "id").distinct()
    labelled = others.join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    mixed_blocks = labelled.groupBy("key").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(F.count(F.lit(1)) / BLOCK_PART).cast("int").alias("ways")
    ).where("lo < hi")
    open_ = labelled.join(mixed_blocks.select("key", "ways"), "key").join(facts.drop("wide"), "id")
    open_ = settle(open_.select("key", "ways", F.struct("id", "label", "n", "sketch").alias("a")))
    # a large block is cut into parts, each compared with the whole block by itself
    again = open_.select("key", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("part"), F.col("a").alias("b"))
    open_ = open_.select("key", F.pmod(F.xxhash64("a.id"), "ways").cast("int").alias("part"), "a")
    apart = (F.col("a.id") < F.col("b.id")) & (F.col("a.label") != F.col("b.label")) & _plausible("a", "b", percent)
    same = (open_["key"] == again["key"]) & (open_["part"] == again["part"])
    crossed = open_.join(again, same & apart).select(
        F.col("a.id").alias("u"), F.col("b.id").alias("v"), (F.col("a.n") + F.col("b.n")).alias("both")
    )
    # a pair of another block that was compared there and does not link is not read again
    fresh = _allowed_wide(crossed.distinct().join(compared, ["u", "v"], "left_anti"), facts, percent)
    more = _checked(fresh, source, length, percent)
    labels = components(found.unionByName(more)) if more.head() is not None else labels

    classes = rows.select("id", F.col("n").alias("n_shingles")).join(copies, "id", "left")
    rep = F.coalesce("rep", "id")
    named = classes.select("id", "n_shingles", rep.alias("rep")).join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    return named.select(
        F.col("id").alias(id_col), "n_shingles", F.coalesce("label", "rep").alias("component_id")
    )
