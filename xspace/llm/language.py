"""Language identification with a string kernel, Nyström landmarks and ridge regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import learnable

SPECTRUM = (1, 2, 3)  # lengths of the character n-grams
BUCKETS = 8192  # n-grams by hash
SLICE_CHARS, SLICE_TEXTS = 1_000_000, 512
LETTER = regex.compile(r"\p{L}")  # as in training: number signs such as a half are none
UNKNOWN = "und"


def presence(texts: list[str]) -> np.ndarray:
    """Which n-gram buckets each text has, over its whole length."""
    sizes = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    flags = np.zeros(len(texts) * BUCKETS, dtype=bool)
    gram = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, max(SPECTRUM) + 1):
        gram = gram[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
        if not len(gram):
            break
        if n in SPECTRUM:
            inside = owner[: len(gram)] == owner[n - 1 :]
            mixed = (gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            bucket = (mixed >> np.uint64(51)).astype(np.int64)
            flags[(owner[: len(gram)] * BUCKETS + bucket)[inside]] = True
    return flags.reshape(len(texts), BUCKETS)


def _slices(texts) -> Iterator[tuple[int, list[str]]]:
    first, part, chars = 0, [], 0
    for text in texts:
        part.append((text or "").lower())
        chars += len(part[-1])
        if chars > SLICE_CHARS or len(part) == SLICE_TEXTS:
            yield first, part
            first, part, chars = first + len(part), [], 0
    if part:
        yield first, part


def normalised(flags: np.ndarray) -> np.ndarray:
    """Rows whose products are the kernel |x and y| / sqrt(|x| |y|)."""
    sizes = np.maximum(flags.sum(axis=1, keepdims=True), 1)
    return flags.astype(np.float32) / np.sqrt(sizes).astype(np.float32)


class Classifier:
    """One-versus-rest kernel ridge regression on Nyström features.

    With landmarks L the features of x are K(x, L) K(L, L)^(-1/2); the regression on them
    is linear, so scoring is one product of the texts' rows with a matrix of one column
    per language.
    """

    def __init__(self, flags: np.ndarray, langs: list[str], landmarks: int, ridge: float, seed: int = 0):
        self.langs = sorted(set(langs))
        rows = normalised(flags)
        chosen = np.random.default_rng(seed).permutation(len(rows))[:landmarks]
        marks = rows[chosen].astype(float)
        values, vectors = np.linalg.eigh(marks @ marks.T)
        keep = values > 1e-9 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])
        features = rows.astype(float) @ marks.T @ root
        mean = features.mean(axis=0)
        target = (np.array(langs)[:, None] == np.array(self.langs)[None, :]).astype(float)
        weight = np.array([1 / langs.count(x) for x in langs])[:, None] * len(langs) / len(self.langs)
        centred = features - mean
        solved = np.linalg.solve(
            centred.T @ (weight * centred) + ridge * np.eye(features.shape[1]), centred.T @ (weight * (target - target.mean(axis=0)))
        )
        self.matrix = (marks.T @ root @ solved).astype(np.float32)
        self.bias = (target.mean(axis=0) - mean @ solved).astype(np.float32)

    def score(self, flags: np.ndarray) -> np.ndarray:
        """Share of each language, from the regression values cut to 0 .. 1."""
        values = np.clip(normalised(flags) @ self.matrix + self.bias, 1e-6, 1)
        return values / values.sum(axis=1, keepdims=True)


def _sample(docs: DataFrame, per_language: int) -> tuple[np.ndarray, list[str]]:
    """Presence rows and languages of at most ``per_language`` texts each, chosen by a hash of their ids."""
    counts = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return np.zeros((0, BUCKETS), dtype=bool), []
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.5 * per_language / n))])
    drawn = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(2**20)) < share[F.col("lang")] * 2**20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in _slices(t.as_py() for t in batch.column("text")):
                bits = np.packbits(presence(part), axis=1)
                own = [batch.column(c).slice(first, len(part)) for c in ("order", "lang")]
                yield pa.RecordBatch.from_arrays([*own, pa.array([b.tobytes() for b in bits])], ["order", "lang", "bits"])

    picked = docs.where(drawn).select(F.xxhash64("id").alias("order"), "lang", "text")
    rows = picked.mapInArrow(run, "order long, lang string, bits binary").collect()
    taken: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r["order"], r["bits"])):
        if len(taken.setdefault(r["lang"], [])) < per_language:
            taken[r["lang"]].append(r["bits"])
    flat = [(lang, b) for lang in sorted(taken) for b in taken[lang]]
    bits = np.frombuffer(b"".join(b for _, b in flat), dtype=np.uint8).reshape(len(flat), BUCKETS // 8)
    return np.unpackbits(bits, axis=1).astype(bool), [lang for lang, _ in flat]


def train(
    docs: DataFrame, per_language: int = 400, landmarks: int = 256, ridge: float = 1.0, id_col="doc_id", text_col="text", lang_col="lang"
) -> Classifier | None:
    """Fit on a bounded sample of the labelled texts that are not held out; None without any."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.where(learnable("id") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    flags, langs = _sample(known, per_language)
    return Classifier(flags, langs, landmarks, ridge) if langs else None


def identify(docs: DataFrame, model: Classifier | None, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, lang_pred, score) of every whole text; ``und`` with score 0 for null texts and those without a letter.

    Without a model every text is ``und``. Repeated rows get the same answer; an empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for first, part in _slices(t.as_py() for t in batch.column("text")):
                lettered = np.array([model is not None and LETTER.search(t) is not None for t in part])
                langs, score = np.full(len(part), UNKNOWN, dtype=object), np.zeros(len(part))
                if lettered.any():
                    shares = model.score(presence(part))
                    best = shares.argmax(axis=1)
                    langs[lettered] = np.array(model.langs, dtype=object)[best[lettered]]
                    score[lettered] = shares.max(axis=1)[lettered]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(first, len(part)), pa.array(langs, pa.string()), pa.array(score)],
                    ["id", "lang_pred", "score"],
                )

    return source.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
