"""Hashes of words and of word sequences, for many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

SLICE_BYTES = 2_000_000  # text handled by one array pass; one longer text is a pass of its own
LONG_WORD = 256  # bytes; longer words are hashed one by one
# Two independent odd multipliers: together they make 128-bit sequence hashes.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(2025).integers(0, 2**64, 256, dtype=np.uint64)
_POWER = np.cumprod(np.full(LONG_WORD, np.uint64(0xA24BAED4963EE407)), dtype=np.uint64)


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words of a text as UTF-8; bytes split at space and at 09-0D alone, and fold A-Z alone."""
    raw = _raw(text, lower)
    return raw.split()


def _raw(text: str | None, lower: bool) -> bytes:
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    return raw.lower() if lower else raw


def slices(texts, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, hashes of the words of some texts in a row, words per text).

    ``lower`` folds the letters A-Z and no others.
    """
    first, parts, held = 0, [], 0
    for text in texts:
        raw = _raw(text, lower)
        parts.append(raw)
        held += len(raw)
        if held >= SLICE_BYTES:
            yield first, *word_hashes(parts)
            first, parts, held = first + len(parts), [], 0
    if parts:
        yield first, *word_hashes(parts)


def word_hashes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, and the number of words of each text.

    A word's hash is the sum of random numbers of its bytes, each times a power for its
    place in the word, scrambled.
    """
    raw = b"\n".join(parts)
    codes = np.frombuffer(raw, dtype=np.uint8)
    in_word = np.concatenate([[False], ~_SPACE[codes], [False]])
    starts = np.flatnonzero(in_word[1:-1] & ~in_word[:-2])
    ends = np.flatnonzero(in_word[1:-1] & ~in_word[2:]) + 1
    lengths = ends - starts
    begins = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(begins, lengths)
    terms = _BYTE[codes[in_word[1:-1]]] * _POWER[np.minimum(place, LONG_WORD - 1)]
    hashes = mixed(np.add.reduceat(terms, begins)) if len(starts) else np.zeros(0, np.uint64)
    for k in np.flatnonzero(lengths > LONG_WORD):
        hashes[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : ends[k]])
    text_ends = np.cumsum([len(p) + 1 for p in parts])
    return hashes, np.diff(np.searchsorted(starts, text_ends), prepend=0)


def sequence_hashes(words: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """Hash of every ``length`` words in a row, by doubling; a sequence may span two texts."""
    if len(words) < length:
        return np.zeros(0, dtype=np.uint64)
    out, size, power, at_size = None, 0, base, 1
    grown = words
    rest = length
    while rest:
        if rest & 1:
            # append a block of at_size words behind what there is
            out = grown if out is None else out[: len(words) - size - at_size + 1] * power + grown[size : size + len(words) - size - at_size + 1]
            size += at_size
        rest >>= 1
        if rest:
            n = len(words) - 2 * at_size + 1
            grown = grown[:n] * power + grown[at_size : at_size + n]
            power = np.uint64(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF)
            at_size *= 2
    return out[: len(words) - length + 1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that their order is random."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def starts_inside(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, flat start) of every sequence of ``length`` words that lies in one text."""
    counts = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(sizes)), counts)
    begin = np.cumsum(sizes) - sizes
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return text, begin[text] + within
