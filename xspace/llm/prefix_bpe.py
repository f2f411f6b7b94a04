"""Byte-level BPE by dynamic programming over prefixes.

Two tokens may follow each other if merging by rank never crosses the border between
them. A row of tokens is the encoding of its bytes exactly if that holds for every two
in a row, so each prefix of a text has one last token that is valid behind the prefix
before it. The table of last tokens grows by appending and shrinks by cutting: bytes in
front of a change keep their entries.
"""

from __future__ import annotations

import base64
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

NEVER = 1 << 62  # rank of a merge that does not take place
MOST_PIECES = 400_000  # remembered encodings of short pieces per worker
LONG_PIECE = 64  # bytes; longer pieces are not remembered
MOST_PAIRS = 2_000_000  # remembered verdicts on two tokens
START_BYTES = 6  # of a piece, whose last tokens are shared by all pieces that start so
MOST_STARTS = 50_000  # remembered starts per worker
CUT_CHARS = 1 << 20  # a long text is split into pieces this much at a time
OUT_IDS = 1 << 21  # ids or bytes per Arrow batch sent back


class PrefixBpe(dict):
    """Encodes pieces of text. ``self[piece]``: its ids, as little-endian 32-bit numbers."""

    def __init__(self, ranks: str, pattern: str):
        import ahocorasick
        import regex

        with open(ranks, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.token = {r: t for t, r in self.rank.items()}
        self.pieces = regex.compile(pattern).findall
        self.longest = max(map(len, self.rank))
        self._trie = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self._trie.add_word(token.decode("latin-1"), (rank, len(token)))
        self._trie.make_automaton()
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._spines: dict[tuple[int, int], list] = {}
        self._pairs: dict[int, bool] = {}
        self._starts: dict[bytes, list[int]] = {}
        self._size_of = np.zeros(max(self.token) + 1, dtype=np.int64)
        for token, text in self.token.items():
            self._size_of[token] = len(text)
        self._sizes = self._size_of.tolist()

    # -- which tokens may meet ---------------------------------------------------------

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for one byte.

        (-1, -1) if no merging by rank ends in it: it only stands for a whole piece.
        """
        if token not in self._halves:
            text = self.token[token]
            found = None if len(text) == 1 else (-1, -1)
            for cut in range(1, len(text)):
                left, right = self.rank.get(text[:cut]), self.rank.get(text[cut:])
                if left is None or right is None or max(left, right) >= token:
                    continue
                if self.made(left) and self.made(right) and self._meet(left, right, token):
                    found = (left, right)
                    break
            self._halves[token] = found
        return self._halves[token]

    def made(self, token: int) -> bool:
        return self.halves(token) != (-1, -1)

    def _spine(self, token: int, side: int) -> list[tuple[bytes, int, int]]:
        """Tokens that stand at one end while ``token`` is merged: (bytes, made at, gone at).

        ``side`` 1 is the right end, 0 the left end.
        """
        if (token, side) not in self._spines:
            out, gone, at = [], NEVER, token
            while True:
                half = self.halves(at)
                out.append((self.token[at], -1 if half is None else at, gone))
                if half is None:
                    break
                gone, at = at, half[side]
            self._spines[token, side] = out
        return self._spines[token, side]

    def _meet(self, left: int, right: int, limit: int = NEVER) -> bool:
        """No merge of rank below ``limit`` crosses from ``left`` into ``right``."""
        for a, a_made, a_gone in self._spine(left, 1):
            for b, b_made, b_gone in self._spine(right, 0):
                if a_made >= b_gone or b_made >= a_gone:
                    continue  # never next to each other
                rank = self.rank.get(a + b)
                if rank is None:
                    continue
                at = max(rank, a_made, b_made)
                # of equal merges the left one comes first
                if at < a_gone and at <= b_gone and at < limit:
                    return False
        return True

    def may_follow(self, left: int, right: int) -> bool:
        """A merged token that may stand behind ``left`` (-1: at the start of a piece)."""
        key = left << 32 | right
        found = self._pairs.get(key)
        if found is None:
            found = self.made(right) and (left < 0 or self._meet(left, right))
            if len(self._pairs) >= MOST_PAIRS:
                self._pairs.clear()
            self._pairs[key] = found
        return found

    # -- the table of prefixes -----------------------------------------------------------

    def extend(self, last: list[int], piece: bytes) -> None:
        """Add the last tokens of the prefixes of ``piece`` beyond those in ``last``."""
        known = len(last)
        lowest = max(0, known - self.longest)
        found = known - lowest
        known_pair, may_follow, add = self._pairs.get, self.may_follow, last.append
        for end, (token, size) in self._trie.iter(piece[lowest:].decode("latin-1")):
            if end < found:
                continue
            front = end + lowest - size  # where the prefix in front has its last token
            left = last[front] if front >= 0 else -1
            good = known_pair(left << 32 | token)
            if may_follow(left, token) if good is None else good:
                add(token)
                found += 1
        if len(last) != len(piece):
            raise ValueError(f"bytes without a token: {piece[len(last):][:20]!r} in {len(self.token)} ranks")

    def trace(self, last: list[int]) -> list[int]:
        """The encoding that a table of prefixes ends in."""
        out, at, sizes = [], len(last), self._sizes
        while at:
            token = last[at - 1]
            out.append(token)
            at -= sizes[token]
        out.reverse()
        return out

    def _start(self, piece: bytes) -> list[int]:
        """The last tokens of the first prefixes of ``piece``, as a list of its own."""
        start = piece[:START_BYTES]
        last = self._starts.get(start)
        if last is None:
            last = []
            self.extend(last, start)
            if len(self._starts) >= MOST_STARTS:
                self._starts.clear()
            self._starts[start] = last
        return last.copy()

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        last = self._start(piece) if len(piece) <= LONG_PIECE else array("i")
        if len(last) < len(piece):
            self.extend(last, piece)
        return self.trace(last)

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        ids = self.encode_piece(raw)
        ids = struct.pack(f"<{len(ids)}I", *ids)
        if len(raw) <= LONG_PIECE:
            if len(self) >= MOST_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    # -- texts ---------------------------------------------------------------------------

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, split into pieces a bounded stretch at a time."""
        ids = [b"".join(map(self.__getitem__, self.pieces(part))) for part in stretches(text)]
        return np.frombuffer(b"".join(ids), dtype="<u4")

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def splice(self, text: str, ids: np.ndarray, start: int, end: int, new: str) -> tuple[str, np.ndarray, int]:
        """The text with ``text[start:end]`` replaced, its ids, and the bytes encoded for it.

        Only the stretch between the sure borders of pieces around the change is split
        anew; the ids outside it are taken over.
        """
        changed = text[:start] + new + text[end:]
        left = 0
        for m in BORDER.finditer(text, max(0, start - LOOK_BACK), start):
            left = m.start()
        if not left:  # none near by: the last of the whole front
            left = text.rfind(" ", 0, max(0, start - 1))
            while left > 0 and not BORDER.match(text, left):
                left = text.rfind(" ", 0, left)
            left = max(left, 0)
        found = BORDER.search(text, end)
        right = found.start() if found else len(text)
        head, tail = len(text[:left].encode("utf-8", "surrogatepass")), len(text[right:].encode("utf-8", "surrogatepass"))
        sizes = self._size_of[ids]
        through = np.cumsum(sizes)
        first = int(np.searchsorted(through, head)) + 1 if head else 0
        behind = int(np.searchsorted(through, int(through[-1]) - tail)) + 1 if len(ids) and tail else len(ids)
        middle = changed[left : len(changed) - (len(text) - right)]
        own = self.encode(middle)
        out = np.concatenate([ids[:first], own, ids[behind:] if tail else ids[:0]])
        return changed, out, len(middle.encode("utf-8", "surrogatepass"))


# A space before a character that is no white space starts a piece, whatever stands
# before it: matches look ahead only.
BORDER = re.compile(r" (?=\S)")
LOOK_BACK = 4096


def stretches(text: str) -> Iterator[str]:
    """Parts of a text that end where a piece surely ends."""
    at = 0
    while len(text) - at > CUT_CHARS:
        cut = BORDER.search(text, at + CUT_CHARS)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class PrefixTable:
    """The encoding of one growing or edited piece of bytes.

    Entries in front of a change stay; ``worked`` counts the prefixes computed.
    """

    def __init__(self, bpe: PrefixBpe, piece: bytes = b""):
        self.bpe, self.piece, self.last, self.worked = bpe, b"", array("i"), 0
        self.append(piece)

    def append(self, more: bytes) -> None:
        self.piece += more
        self.bpe.extend(self.last, self.piece)
        self.worked += len(more)

    def replace(self, start: int, end: int, new: bytes) -> None:
        tail = self.piece[end:]
        self.piece = self.piece[:start]
        del self.last[start:]
        self.append(new + tail)

    def ids(self) -> list[int]:
        return self.bpe.trace(self.last)


_LOADED: dict[tuple[str, str], PrefixBpe] = {}


def loaded(ranks: str, pattern: str) -> PrefixBpe:
    """One per worker process, file and pattern."""
    if (ranks, pattern) not in _LOADED:
        _LOADED[ranks, pattern] = PrefixBpe(ranks, pattern)
    return _LOADED[ranks, pattern]


def _batches(columns, names, made) -> Iterator[pa.RecordBatch]:
    """Rows with one more column, a bounded number of its values at a time."""
    held, at, done = [], 0, 0
    for n, (size, value) in enumerate(made, 1):
        held.append(value)
        at += size
        if at >= OUT_IDS:
            yield [c.slice(done, n - done) for c in columns], held
            held, at, done = [], 0, n
    if held:
        yield [c.slice(done) for c in columns], held


def _ids_array(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def encode(docs: DataFrame, ranks: str, pattern: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """Add the ids of each whole text; null counts as empty and has none.

    Rows stay as they are, repeated ones too; a column of the name ``out_col`` is
    refused. An empty table gives no rows.
    """
    schema = _added(docs, out_col, "array<int>")
    at = docs.columns.index(text_col)

    def ids(batches):
        bpe = loaded(ranks, pattern)
        for batch in batches:
            made = ((len(x), x) for x in (bpe.encode(t.as_py() or "") for t in batch.column(at)))
            for columns, rows in _batches(batch.columns, batch.schema.names, made):
                yield pa.RecordBatch.from_arrays([*columns, _ids_array(rows)], [*batch.schema.names, out_col])

    return docs.mapInArrow(ids, schema)


def decode(encoded: DataFrame, ranks: str, pattern: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """Add the bytes that each row's ids stand for; null ids count as none."""
    schema = _added(encoded, out_col, "binary")
    at = encoded.columns.index(ids_col)

    def texts(batches):
        bpe = loaded(ranks, pattern)
        for batch in batches:
            made = ((len(x), x) for x in (bpe.decode(i.values.to_numpy().tolist() if i.is_valid else ()) for i in batch.column(at)))
            for columns, rows in _batches(batch.columns, batch.schema.names, made):
                yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, pa.binary())], [*batch.schema.names, out_col])

    return encoded.mapInArrow(texts, schema)


def reencode(
    encoded: DataFrame,
    ranks: str,
    pattern: str,
    start_col: str = "start",
    end_col: str = "end",
    new_col: str = "new",
    text_col: str = "text",
    ids_col: str = "token_ids",
) -> DataFrame:
    """Replace characters start to end of each text by new text, in text and ids.

    An append has start and end at the length of the text. Null or larger places mean
    that end, a null new text nothing. Adds ``encoded_bytes``, the bytes encoded anew.
    """
    names = encoded.columns
    schema = _added(encoded, "encoded_bytes", "long")
    at = {c: names.index(c) for c in (start_col, end_col, new_col, text_col, ids_col)}

    def changed(batches):
        bpe = loaded(ranks, pattern)
        for batch in batches:
            texts, rows, sizes = [], [], []
            for k in range(batch.num_rows):
                value = {c: batch.column(i)[k] for c, i in at.items()}
                text = value[text_col].as_py() or ""
                ids = value[ids_col].values.to_numpy().astype("<u4") if value[ids_col].is_valid else np.zeros(0, "<u4")
                start, end = value[start_col].as_py(), value[end_col].as_py()
                start = len(text) if start is None else min(start, len(text))
                end = len(text) if end is None else max(start, min(end, len(text)))
                text, ids, size = bpe.splice(text, ids, start, end, value[new_col].as_py() or "")
                texts.append(text), rows.append(ids), sizes.append(size)
            columns = list(batch.columns)
            columns[at[text_col]], columns[at[ids_col]] = pa.array(texts, pa.string()), _ids_array(rows)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64())], [*names, "encoded_bytes"])

    return encoded.mapInArrow(changed, schema)


def _added(df: DataFrame, name: str, kind: str) -> str:
    if name in df.columns:
        raise ValueError(f"the table has a column {name}; give another name")
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{name}` {kind}"])


def digests(decoded: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of encoded and decoded rows."""
    numbers = F.concat_ws(",", F.col(ids_col).cast("array<string>"))
    return decoded.select(
        id_col,
        F.size(ids_col).cast("long").alias("n_tokens"),
        F.sha2(numbers.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(out_col, 256).alias("decoded_sha256"),
    )
