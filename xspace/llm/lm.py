"""Masked pseudo-likelihood of words by bidirectional window networks.

A word's probability is that of its class given the words on both sides, times that of
the word within its class. The number of classes and the table of words grow with the
corpus.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import session
from .common import settle
from .hashing import slices

CLASSES = 256
FREQUENT = 192  # words with a class of their own; the others share the rest by hash
HASHED = CLASSES - FREQUENT  # divides 2^64: remainders of signed and unsigned hashes agree
WIDTH = 24
REACH = 2  # words looked at on each side
OWN_PER_ROOT = 3  # own classes per cube root of the distinct words
PRIOR = 0.5  # added to each word's count within its class
RATIO_STEPS = 16  # per unit of the logarithm, in the fit of the networks' shares
LEAST_KEYS, MOST_KEYS = 1 << 18, 1 << 22  # of a task's tally: between merges, in all
BLOCK_CONTEXTS = 32  # contexts sent and added up together
CHUNK = 4096  # words scored by one array pass: what it touches stays in the processor's cache
DRIVER_PARTS = 32  # gradients that the driver adds up


class Network:
    """Predicts the class of a word from the classes of the words on both sides.

    Embeddings of the left and the right neighbour (class ``classes`` stands for the edge
    of a text) are added, passed through tanh, and a softmax gives the class.
    """

    def __init__(self, seed: int = 0, classes: int = CLASSES):
        self.name = uuid.uuid4().hex
        self.classes = classes
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.1, shape)
        self.left, self.right = draw(classes + 1, WIDTH), draw(classes + 1, WIDTH)
        self.out, self.bias = draw(WIDTH, classes), np.zeros(classes)

    def parameters(self) -> list[np.ndarray]:
        return [self.left, self.right, self.out, self.bias]

    def log_probabilities(self, left: np.ndarray, right: np.ndarray):
        hidden = np.tanh(self.left[left] + self.right[right])
        scores = hidden @ self.out + self.bias
        scores -= scores.max(axis=1, keepdims=True)
        return hidden, scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))

    def gradient(self, left, right, counts):
        """Of the summed log-likelihood of word counts per context, and that sum."""
        hidden, logs = self.log_probabilities(left, right)
        off = counts - counts.sum(axis=1, keepdims=True) * np.exp(logs)
        inner = (off @ self.out.T) * (1 - hidden**2)
        g_left, g_right = np.zeros_like(self.left), np.zeros_like(self.right)
        np.add.at(g_left, left, inner)
        np.add.at(g_right, right, inner)
        return [g_left, g_right, hidden.T @ off, off.sum(axis=0)], float((counts * logs).sum())

    def table(self) -> np.ndarray:
        """Log-probability of every class between every two neighbours (single precision)."""
        sides = np.arange(self.classes + 1)
        return np.stack([
            self.log_probabilities(np.full(self.classes + 1, a), sides)[1].astype(np.float32) for a in sides
        ])


_TABLES: dict[str, np.ndarray] = {}


def _table(network: Network) -> np.ndarray:
    """The network's table, computed once per worker; only the last one is kept."""
    if network.name not in _TABLES:
        _TABLES.clear()
        _TABLES[network.name] = network.table()
    return _TABLES[network.name]


# -- word classes ------------------------------------------------------------------


class Tally:
    """Counts of 64-bit keys, added up over the slices of a task.

    New keys wait and are merged when they are as many as the counted ones; beyond
    ``MOST_KEYS`` counted keys the task sends what it has and starts again.
    """

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> bool:
        """Whether the tally is full."""
        self.new.append((keys, counts))
        self.waiting += len(keys)
        if self.waiting > max(LEAST_KEYS, len(self.keys)):
            self.merge()
        return len(self.keys) > MOST_KEYS

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.new)])
        counts = np.concatenate([self.counts, *(c for _, c in self.new)])
        order = np.argsort(keys, kind="stable")  # runs are sorted already
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        self.new, self.waiting = [], 0

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys and their counts so far; the tally is empty afterwards."""
        self.merge()
        out = self.keys, self.counts
        self.__init__()
        return out


def _word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): counts of all words, by hash, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent():
            keys, counts = tally.take()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["word", "n"])

        tally = Tally()
        for batch in batches:
            for _, words, _ in slices(t.as_py() for t in batch.column("text")):
                if tally.add(*np.unique(words.view(np.int64), return_counts=True)):
                    yield sent()
        yield sent()

    return docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _classes(words: np.ndarray, frequent: np.ndarray, own: int = FREQUENT) -> np.ndarray:
    """Class of each word hash; ``frequent`` holds at most ``own`` sorted hashes."""
    out = own + (words % np.uint64(HASHED)).astype(np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, words), len(frequent) - 1)
        hit = frequent[at] == words
        out[hit] = at[hit]
    return out


def _neighbours(classes: np.ndarray, sizes: np.ndarray, edge: int = CLASSES, reach: int = 1):
    """Classes of the words ``reach`` places to the left and to the right."""
    before = np.arange(len(classes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    behind = np.repeat(sizes, sizes) - before
    left, right = np.full(len(classes), edge), np.full(len(classes), edge)
    has = np.flatnonzero(before >= reach)
    left[has] = classes[has - reach]
    has = np.flatnonzero(behind > reach)
    right[has] = classes[has + reach]
    return left, right


def _settled_contexts(docs: DataFrame, frequent, own: int = FREQUENT, reach: int = 1) -> DataFrame:
    """(reach, context, centres, ns) over every word of every document, written.

    A context is the classes of the words ``reach`` places to both sides, with at most as
    many entries as there are classes. Tasks add their cells up and send blocks of
    contexts as bytes; a block's parts meet in one partition and are added up there.
    """
    classes = own + HASHED
    block = BLOCK_CONTEXTS * classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(k):
            cells, counts = tallies[k].take()
            blocks = cells // block
            cuts = np.flatnonzero(blocks[1:] != blocks[:-1]) + 1 if len(cells) else np.zeros(0, np.int64)
            firsts = np.concatenate([[0], cuts]) if len(cells) else cuts
            places = [c.tobytes() for c in np.split((cells % block).astype("<i4"), cuts)][: len(firsts)]
            numbers = [c.tobytes() for c in np.split(counts.astype("<i8"), cuts)][: len(firsts)]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(firsts), k, np.int32)), pa.array(blocks[firsts]), pa.array(places, pa.binary()), pa.array(numbers, pa.binary())],
                ["reach", "block", "places", "numbers"],
            )

        tallies = {k: Tally() for k in range(1, reach + 1)}
        for batch in batches:
            for _, words, sizes in slices(t.as_py() for t in batch.column("text")):
                if not len(words):
                    continue
                centre = _classes(words, frequent.value, own)
                for k, tally in tallies.items():
                    left, right = _neighbours(centre, sizes, classes, k)
                    if tally.add(*np.unique((left * (classes + 1) + right) * classes + centre, return_counts=True)):
                        yield sent(k)
        for k in tallies:
            yield sent(k)

    def add_up(key, table):
        k, own_block = (x.as_py() for x in key)
        dense = np.zeros(block, np.int64)
        for places, numbers in zip(table.column("places"), table.column("numbers")):
            dense[np.frombuffer(places.as_buffer(), "<i4")] += np.frombuffer(numbers.as_buffer(), "<i8")
        cells = np.flatnonzero(dense)
        context, centre = own_block * BLOCK_CONTEXTS + cells // classes, cells % classes
        cuts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1], [True]])).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in (centre.astype(np.int32), dense[cells])]
        return pa.table(
            [pa.array(np.full(len(cuts) - 1, k, np.int32)), pa.array(context[cuts[:-1]]), *lists], ["reach", "context", "centres", "ns"]
        )

    parts = docs.mapInArrow(run, "reach int, block long, places binary, numbers binary")
    schema = "reach int, context long, centres array<int>, ns array<long>"
    return settle(parts.groupBy("reach", "block").applyInArrow(add_up, schema))


# -- training ----------------------------------------------------------------------


def _summed_gradient(counts: DataFrame, network: Network) -> tuple[list[np.ndarray], float]:
    """Each task adds up the gradient of its contexts; the driver gets one row per task."""
    spark = counts.sparkSession
    shared = spark.sparkContext.broadcast(network)
    shapes, sides = [p.shape for p in network.parameters()], network.classes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, value = [np.zeros(s) for s in shapes], 0.0
        for batch in batches:
            lists = zip(batch.column("context").to_pylist(), batch.column("centres"), batch.column("ns"))
            rows = list(lists)
            for at in range(0, len(rows), 2000):
                part = rows[at : at + 2000]
                context = np.array([r[0] for r in part])
                counts_ = np.zeros((len(part), sides - 1))
                for k, (_, centres, ns) in enumerate(part):
                    counts_[k, centres.values.to_numpy()] = ns.values.to_numpy()
                grads, log = shared.value.gradient(context // sides, context % sides, counts_)
                total = [a + b for a, b in zip(total, grads)]
                value += log
        flat = np.concatenate([g.ravel() for g in total] + [[value]])
        yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary())], ["g"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for g in batch.column(0):
                g = np.frombuffer(g.as_buffer())
                total = g.copy() if total is None else total + g
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["g"])

    parts, many = counts.mapInArrow(run, "g binary"), counts.rdd.getNumPartitions()
    while many > DRIVER_PARTS:  # a tree: each level has a DRIVER_PARTS-th of the rows
        many = -(-many // DRIVER_PARTS)
        parts = parts.repartition(many).mapInArrow(add_up, "g binary")
    rows = [np.frombuffer(r["g"]) for r in parts.collect()]  # at most DRIVER_PARTS, each as long as the parameters
    shared.destroy()
    flat = np.sum(rows, axis=0) if rows else np.zeros(sum(int(np.prod(s)) for s in shapes) + 1)
    out, at = [], 0
    for s in shapes:
        size = int(np.prod(s))
        out.append(flat[at : at + size].reshape(s))
        at += size
    return out, flat[-1]


def _fit(counts: DataFrame, network: Network, epochs: int, rate: float) -> list[float]:
    """Train on settled contexts; the mean log-likelihood per epoch."""
    total = counts.select(F.sum(F.aggregate("ns", F.lit(0).cast("long"), lambda a, x: a + x))).head()[0]
    history = []
    if not total:
        return history
    m = [np.zeros_like(p) for p in network.parameters()]
    v = [np.zeros_like(p) for p in network.parameters()]
    for step in range(1, epochs + 1):
        grads, value = _summed_gradient(counts, network)
        history.append(value / total)
        for k, (p, g) in enumerate(zip(network.parameters(), grads)):
            g = g / total
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            p += rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-9)
    return history


def _frequent(words: DataFrame, own: int) -> np.ndarray:
    top = words.orderBy(F.desc("n"), "word").limit(own).collect()
    return np.sort(np.array([r["word"] for r in top], dtype=np.int64).view(np.uint64))


def train(docs: DataFrame, epochs: int = 12, rate: float = 0.08, text_col: str = "text"):
    """(network, sorted hashes of the frequent words, mean log-likelihood per epoch).

    The likelihood of a corpus under a window network depends on it only through how
    often each word class stands between each two classes. These counts are taken over
    every word of every document; each epoch is a full-batch step (Adam) whose gradient
    the executors sum over the counts. This predicts classes alone, see ``train_words``.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(text_col).alias("text"))
    frequent = _frequent(_word_counts(source), FREQUENT)
    counts = _settled_contexts(source, spark.sparkContext.broadcast(frequent))
    network = Network()
    return network, frequent, _fit(counts, network, epochs, rate)


# -- words -------------------------------------------------------------------------


@dataclass
class WordModel:
    """What scores a word: small parts here, the words themselves in a table.

    ``networks[k]`` looks ``k + 1`` places to both sides; the class probability is their
    mean with weights ``shares``. ``sums[k]`` holds the logarithm of the softmax sum
    between every two classes. ``words`` (word, log_p) has every word that shares its
    class, ``rest`` the log-probability of an unseen word of each shared class.
    """

    frequent: np.ndarray
    own: int
    networks: list[Network]
    sums: list[np.ndarray]
    shares: np.ndarray
    words: DataFrame
    rest: np.ndarray
    history: list[list[float]]

    def small(self) -> ClassModel:
        parts = [(n.left, n.right, n.out.T, n.bias) for n in self.networks]
        single = [tuple(np.ascontiguousarray(p, np.float32) for p in part) for part in parts]
        return ClassModel(self.frequent, self.own, single, self.sums, self.shares)


@dataclass
class ClassModel:
    """The part of a word model that tasks hold."""

    frequent: np.ndarray
    own: int
    parts: list[tuple]
    sums: list[np.ndarray]
    shares: np.ndarray

    def logs(self, centre: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """Log-probability of each word's class by each network."""
        out, edge = [], self.own + HASHED
        for k, ((left_of, right_of, out_of, bias), sums) in enumerate(zip(self.parts, self.sums)):
            left, right = _neighbours(centre, sizes, edge, k + 1)
            own = np.empty(len(centre))
            for at in range(0, len(centre), CHUNK):
                part = slice(at, at + CHUNK)
                hidden = np.tanh(left_of[left[part]] + right_of[right[part]])
                own[part] = np.einsum("ij,ij->i", hidden, out_of[centre[part]]) + bias[centre[part]]
            out.append(own - sums[left, right])
        return out

    def mixed(self, centre: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        logs = [a + np.log(s) for a, s in zip(self.logs(centre, sizes), self.shares)]
        return np.logaddexp.reduce(logs)


def _softmax_sums(spark, network: Network) -> np.ndarray:
    """Logarithm of the softmax sum between every two classes; a task per range of left classes."""
    sides = network.classes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in batch.column("id").to_pylist():
                scores = np.tanh(network.left[a] + network.right) @ network.out + network.bias
                top = scores.max(axis=1)
                sums = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([sums], pa.list_(pa.float64()))], ["a", "sums"])

    out = np.zeros((sides, sides), np.float32)
    for a, sums in spark.range(sides).mapInArrow(run, "a long, sums array<double>").collect():
        out[a] = sums
    return out


def _shares(source: DataFrame, small: ClassModel) -> np.ndarray:
    """Shares of the two networks that make all words likeliest, from a histogram of their ratio."""
    shared = source.sparkSession.sparkContext.broadcast(small)
    most = 100 * RATIO_STEPS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist, model = np.zeros(2 * most + 1, np.int64), shared.value
        for batch in batches:
            for _, words, sizes in slices(t.as_py() for t in batch.column("text")):
                if len(words):
                    near, far = model.logs(_classes(words, model.frequent, model.own), sizes)
                    bins = np.rint((far - near) * RATIO_STEPS).clip(-most, most).astype(np.int64) + most
                    hist += np.bincount(bins, minlength=len(hist))
        at = np.flatnonzero(hist)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(hist[at])], ["bin", "n"])

    rows = source.mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").collect()
    shared.destroy()
    near = 0.5
    if rows:
        ratio = np.exp((np.array([r["bin"] for r in rows]) - most) / RATIO_STEPS)
        n = np.array([r["n"] for r in rows], dtype=float)
        for _ in range(300):
            near = float((n * near / (near + (1 - near) * ratio)).sum() / n.sum())
    near = min(max(near, 1e-6), 1 - 1e-6)
    return np.array([near, 1 - near])


def train_words(docs: DataFrame, epochs: int = 12, rate: float = 0.08, text_col: str = "text") -> WordModel:
    """A model of words from all words of all documents.

    The most frequent words, as many as ``OWN_PER_ROOT`` times the cube root of the
    distinct words, have a class each (at least ``FREQUENT``); the others share classes
    by hash and are told apart by their smoothed counts, kept as a table. A network is
    trained as by ``train`` for each distance up to ``REACH``.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(text_col).alias("text"))
    counts = settle(_word_counts(source))
    distinct = counts.count()
    own = max(FREQUENT, int(OWN_PER_ROOT * distinct ** (1 / 3)))
    frequent = _frequent(counts, own)
    top = spark.createDataFrame([(int(w),) for w in frequent.view(np.int64)], "word long")
    rare = counts.join(F.broadcast(top), "word", "left_anti").withColumn("c", F.pmod("word", F.lit(HASHED)).cast("int"))
    sizes = rare.groupBy("c").agg((F.sum("n") + PRIOR * (F.count("n") + 1)).alias("all")).collect()
    rest = np.zeros(HASHED)  # a class without words: its unseen words have all of it
    for c, all_ in sizes:
        rest[c] = np.log(PRIOR / all_)
    by_class = spark.createDataFrame([(c, all_) for c, all_ in sizes], "c int, all double")
    words = settle(rare.join(F.broadcast(by_class), "c").select("word", F.ln((F.col("n") + PRIOR) / F.col("all")).alias("log_p")))
    contexts = _settled_contexts(source, spark.sparkContext.broadcast(frequent), own, REACH)
    networks = [Network(k, own + HASHED) for k in range(REACH)]
    history = [_fit(contexts.where(F.col("reach") == k + 1), n, epochs, rate) for k, n in enumerate(networks)]
    sums = [_softmax_sums(spark, n) for n in networks]
    model = WordModel(frequent, own, networks, sums, np.full(REACH, 1 / REACH), words, rest, history)
    model.shares = _shares(source, model.small())
    return model


# -- scores ------------------------------------------------------------------------


def _per_text(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes), values, len(sizes)) if len(values) else np.zeros(len(sizes))


def score_words(docs: DataFrame, model: WordModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, pll, pll_per_word): summed log-probability of each word given those around it.

    The table of words is shipped to the tasks if it is measured to fit half of
    ``spark.xspace.broadcastBytes``; otherwise words and table meet in a join. Rows are
    as by ``score``.
    """
    spark = docs.sparkSession
    n_words = model.words.count()
    shipped = n_words * 16 <= session.broadcast_limit(spark) // 2
    keys, logs = None, None
    if shipped:
        held = model.words.toArrow()
        keys = held.column("word").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        keys, logs = keys[order], held.column("log_p").to_numpy()[order]
    shared = spark.sparkContext.broadcast((model.small(), model.rest, keys, logs))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small, rest, keys, logs = shared.value
        for batch in batches:
            for first, words, sizes in slices(t.as_py() for t in batch.column("text")):
                centre = _classes(words, small.frequent, small.own)
                own = small.mixed(centre, sizes) if len(words) else np.zeros(0)
                at = np.flatnonzero(centre >= small.own)
                if keys is None:
                    counts = _per_text(np.ones(len(at)), np.diff(np.searchsorted(at, np.cumsum(sizes)), prepend=0))
                    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    looked = pa.ListArray.from_arrays(pa.array(ends), pa.array(words[at].view(np.int64)))
                else:
                    more = rest[centre[at] - small.own]
                    if len(keys):
                        spot = np.minimum(np.searchsorted(keys, words[at]), len(keys) - 1)
                        more = np.where(keys[spot] == words[at], logs[spot], more)
                    own[at] += more
                    looked = pa.nulls(len(sizes), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(first, len(sizes)), batch.column("row").slice(first, len(sizes)),
                     pa.array(sizes.astype(np.int64)), pa.array(_per_text(own, sizes)), looked],
                    ["id", "row", "n_words", "pll", "looked"])

    out = source.mapInArrow(run, f"id {kind}, row long, n_words long, pll double, looked array<long>")
    if not shipped:
        out = settle(out)
        unseen = F.element_at(F.array(*[F.lit(float(x)) for x in model.rest]), (F.pmod("word", F.lit(HASHED)) + 1).cast("int"))
        each = out.select("row", F.explode("looked").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("n"))
        met = each.join(model.words, "word", "left").select("row", (F.col("n") * F.coalesce("log_p", unseen)).alias("more"))
        added = met.groupBy("row").agg(F.sum("more").alias("more"))
        out = out.join(added, "row", "left").withColumn("pll", F.col("pll") + F.coalesce("more", F.lit(0.0)))
    mean = F.when(F.col("n_words") > 0, F.col("pll") / F.col("n_words"))
    return out.select(F.col("id").alias(id_col), "n_words", "pll", mean.alias("pll_per_word"))


def score(docs: DataFrame, network: Network, frequent, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, pll, pll_per_word): summed log-probability of each class given both neighbours.

    A text without words, or null, has the sum 0.0 and no mean. Repeated rows score
    alike; an empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((network, frequent))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, often = shared.value
        logs = _table(net)
        for batch in batches:
            for first, words, sizes in slices(t.as_py() for t in batch.column("text")):
                total = np.zeros(len(sizes))
                if len(words):
                    centre = _classes(words, often)
                    left, right = _neighbours(centre, sizes)
                    own = logs[left, right, centre].astype(float)
                    total = np.bincount(np.repeat(np.arange(len(sizes)), sizes), own, len(sizes))
                mean = np.divide(total, sizes, out=np.full(len(sizes), np.nan), where=sizes > 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(first, len(sizes)), pa.array(sizes.astype(np.int64)), pa.array(total),
                     pa.array(mean, mask=sizes == 0)], ["id", "n_words", "pll", "pll_per_word"])

    return source.mapInArrow(run, f"id {kind}, n_words long, pll double, pll_per_word double").withColumnRenamed("id", id_col)
