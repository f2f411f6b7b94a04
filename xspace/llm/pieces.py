"""SentencePiece encoding by shared-prefix Viterbi, and decoding."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

MARK = "▁"
MOST_WORDS = 300_000  # remembered by a worker at once


class Pieces:
    """Vocabulary of a SentencePiece model file: pieces with scores, and byte pieces.

    A unigram model's scores are log-probabilities and are taken as they are. A BPE
    model's scores are merge ranks (0, -1, -2, ...); as a piece's frequency falls about
    as its rank, they are read as ln(1 / (rank + 1)) relative to the whole vocabulary.
    """

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        raw = {i: sp.get_score(i) for i in plain}
        ranks = sorted(raw, key=lambda i: (-raw[i], i))
        merges = all(float(raw[i]).is_integer() for i in ranks)
        total = math.log(sum(1 / (k + 1) for k in range(len(ranks))))
        # a piece holds the mark at its start or not at all: words are encoded one by one
        usable = lambda t: MARK not in t[1:]
        self.score = {
            self.text[i]: (-math.log(k + 1) - total if merges else raw[i], i)
            for k, i in enumerate(ranks) if usable(self.text[i])
        }
        self.bytes = {int(sp.id_to_piece(i)[3:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        # every end of a piece: with its score and id if it is a piece itself, else None
        self.ends: dict[str, tuple[float, int] | None] = dict(self.score)
        for t in self.score:
            for k in range(1, len(t)):
                self.ends.setdefault(t[k:], None)
        # what a piece shows: its text with a space for the mark, None for bytes
        self.shown = [
            None if i in self.byte_of else " " + t[1:] if t[:1] == MARK else t for i, t in enumerate(self.text)
        ]
        self.worst = min(s for s, _ in self.score.values())
        self._known: dict[str, bytes] = {}

    # -- encoding ------------------------------------------------------------------

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct marked words, each as 32-bit numbers.

        The sorted words are a trie walked depth first: going from one word to the next
        keeps the forward scores of their common prefix and computes only what follows.
        A character without a piece costs its bytes, each worse than any piece.
        """
        out, piece_or_end = {}, self.ends.get
        best: list[float] = [0.0]
        back: list[tuple[int, tuple[int, ...]]] = [(0, ())]
        last = ""
        for word in sorted(words):
            k, top = 0, min(len(last), len(word))
            while k < top and last[k] == word[k]:
                k += 1
            del best[k + 1 :], back[k + 1 :]
            for end in range(k + 1, len(word) + 1):
                high, how = -math.inf, None
                for start in range(end - 1, -1, -1):
                    found = piece_or_end(word[start:end], ())
                    if not found:
                        if found is None:
                            continue
                        break  # no piece ends so
                    if start and word[start] == MARK:
                        continue  # a mark inside a word is text, never a space
                    total = best[start] + found[0]
                    if total >= high:
                        high, how = total, (start, (found[1],))
                if how is None:
                    raw = word[end - 1].encode("utf-8", "surrogatepass")
                    high = best[end - 1] + len(raw) * (self.worst - 10)
                    how = (end - 1, tuple(self.bytes[b] for b in raw))
                best.append(high)
                back.append(how)
            ids, at = [], len(word)
            while at > 0:
                at, own = back[at]
                ids.extend(reversed(own))
            out[word] = np.array(ids[::-1], dtype="<i4").tobytes()
            last = word
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts. Words are what single spaces part, each with a mark before it."""
        split = [t.split(" ") if t else [] for t in texts]
        known = self._known
        new = {w for words in split for w in words if w not in known}
        if len(known) + len(new) > MOST_WORDS:
            known.clear()
            new = {w for words in split for w in words}
        known.update((w[1:], ids) for w, ids in self.encode_words([MARK + w for w in new]).items())
        return [b"".join(map(known.__getitem__, words)) for words in split]

    # -- decoding ------------------------------------------------------------------

    def decode(self, ids: bytes) -> str:
        """The text of ids: marks become spaces, the first one none; bytes are joined."""
        parts, run = [], bytearray()
        text, byte_of = self.shown, self.byte_of
        for i in np.frombuffer(ids, dtype="<i4").tolist():
            piece = text[i]
            if piece is None:
                run.append(byte_of[i])
                continue
            if run:
                parts.append(run.decode("utf-8", "surrogatepass"))
                run = bytearray()
            parts.append(piece)
        if run:
            parts.append(run.decode("utf-8", "surrogatepass"))
        return "".join(parts)[1:]


_LOADED: dict[str, Pieces] = {}


def load(model: str) -> Pieces:
    """One per worker process and file."""
    if model not in _LOADED:
        _LOADED[model] = Pieces(model)
    return _LOADED[model]


def _chunks(batch: pa.RecordBatch, column: str, size: int = 500):
    values = batch.column(column)
    for at in range(0, len(values), size):
        yield at, values.slice(at, size).to_pylist()


def encode(docs: DataFrame, model: str, text_col: str = "text", ids_col: str = "piece_ids") -> DataFrame:
    """``docs`` with the piece ids of each whole text in ``ids_col``; null texts get null.

    Distinct words are encoded once per worker (and again when it has met too many to
    remember); nothing is shuffled. An empty text has no ids.
    """
    kept = [c for c in docs.columns if c != ids_col]
    source = docs.select(*kept)
    schema = T.StructType([*source.schema, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            for at, texts in _chunks(batch, text_col):
                ids = pieces.encode([t or "" for t in texts])
                ends = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])]).astype(np.int32)
                mask = pa.array([t is None for t in texts])
                values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
                column = pa.ListArray.from_arrays(pa.array(ends), values, mask=mask)
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, ids_col])

    return source.mapInArrow(run, schema)


def decode(docs: DataFrame, model: str, ids_col: str = "piece_ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of ``ids_col`` in ``text_col``; the inverse of ``encode``."""
    kept = [c for c in docs.columns if c != text_col]
    source = docs.select(*kept)
    schema = T.StructType([*source.schema, T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            ids = batch.column(ids_col)
            texts = [
                pieces.decode(i.values.to_numpy(zero_copy_only=False).astype("<i4").tobytes()) if i.is_valid else None
                for i in ids
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text_col])

    return source.mapInArrow(run, schema)
