"""Token ids of whole texts, with remembered words."""

from __future__ import annotations

import base64
import re

# A space that starts a new pre-token whatever stands before it is followed by a
# character that is no white space; other texts are encoded as a whole.
UNSAFE = re.compile(r" (?:\s|\Z)")
MOST_WORDS = 400_000  # remembered by a worker at once


class ByteTokens(dict):
    """Text to ids of a byte-level BPE vocabulary, as little-endian 32-bit numbers.

    ``self[w]`` is the encoding of " " + w. Byte-level pre-tokens never reach across a
    space before a word, so texts are encoded word by word, each distinct word once.
    ``ranks`` is the rank file of the vocabulary: the ids are those of its tokenizer
    file (a test compares them), at a fraction of the time per word.
    """

    def __init__(self, ranks: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._bpe = tiktoken.Encoding(
            "ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}
        )

    def plain(self, text: str) -> bytes:
        import numpy as np

        return np.array(self._bpe.encode_ordinary(text), dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MOST_WORDS:
            self.clear()
        found = self[word] = self.plain(" " + word)
        return found

    def encode(self, text: str) -> bytes:
        if UNSAFE.search(text):
            return self.plain(text)
        first, *rest = text.split(" ")
        return self.plain(first) + b"".join(map(self.__getitem__, rest))


_LOADED: dict[str, ByteTokens] = {}


def byte_tokens(ranks: str) -> ByteTokens:
    """One per worker process and file."""
    if ranks not in _LOADED:
        _LOADED[ranks] = ByteTokens(ranks)
    return _LOADED[ranks]
