"""Encodings of text files: how their lines are found, decoded and written.

Three kinds: UTF-8, whose bytes pass through as they are; Latin-1, which the JVM
decodes; every other Python codec whose line breaks are bytes, or units of two or
four bytes, of their own. Bytes outside a codec are kept as lone surrogates (U+DC80 and
up), in Spark strings as their three-byte form, and written back as they were.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed value: a charset whose every byte is a character, by the JVM's name.
JVM_CHARSETS = {"iso8859-1": "ISO-8859-1"}
# Codecs of two- and four-byte units, (bytes, big-endian, marked by a BOM).
UNITS = {
    "utf-16": (2, False, True),
    "utf-16-le": (2, False, False),
    "utf-16-be": (2, True, False),
    "utf-32": (4, False, True),
    "utf-32-le": (4, False, False),
    "utf-32-be": (4, True, False),
}
BREAK = re.compile("\r\n|\r|\n")


@dataclass(frozen=True)
class Encoding:
    name: str  # as Python's codec registry writes it
    charset: str | None = None  # the JVM's name, where it decodes
    unit: int = 1
    big: bool = False
    marked: bool = False  # a byte order mark leads the file and decides ``big``

    @property
    def plain(self) -> bool:
        return self.name == "utf-8"

    @property
    def errors(self) -> str:
        # units have no bytes of their own to escape; their lone surrogates stay surrogates
        return "surrogateescape" if self.unit == 1 else "surrogatepass"

    @property
    def unit_codec(self) -> str:
        return f"utf-{8 * self.unit}-{'be' if self.big else 'le'}"

    def encode(self, value: bytes) -> bytes:
        """Bytes of a file for bytes of a Spark string, without a byte order mark."""
        text = value.decode("utf-8", "surrogatepass")
        return text.encode(self.name if self.unit == 1 else self.unit_codec, self.errors)

    def decode(self, raw: bytes) -> bytes:
        """Bytes of a Spark string for bytes of a file."""
        text = raw.decode(self.name if self.unit == 1 else self.unit_codec, self.errors)
        return text.encode("utf-8", "surrogatepass")

    def line_break(self) -> str:
        """What ends a line, as a string whose UTF-8 bytes are those of the encoding."""
        return "\n".encode(self.unit_codec).decode("ascii") if self.unit > 1 else "\n"

    def mark(self) -> bytes:
        return "\ufeff".encode(self.unit_codec) if self.marked else b""


@cache
def encoding_of(name: str) -> Encoding:
    """The encoding of a name; ValueError where lines cannot be told apart by their bytes."""
    try:
        known = codecs.lookup(name).name
        " ".encode(known)
    except LookupError:
        raise ValueError(f"encoding {name!r} is not known") from None
    if known in JVM_CHARSETS:
        return Encoding(known, JVM_CHARSETS[known])
    if known in UNITS:
        return Encoding(known, None, *UNITS[known])
    if known != "utf-8" and not _breaks_apart(known):
        raise ValueError(f"encoding {name!r} has line breaks within characters")
    return Encoding(known)


def _breaks_apart(name: str) -> bool:
    """Whether line feed, carriage return and space are themselves after any byte."""
    for char in "\n\r ":
        code = char.encode(name)
        if code != char.encode("ascii"):
            return False
        for lead in range(256):
            if not (bytes([lead]) + code).decode(name, "replace").endswith(char):
                return False
    return True


def split_units(raw: bytes, encoding: Encoding) -> list[str]:
    """Lines of whole units; the break of the last line does not begin another."""
    lines = BREAK.split(raw.decode(encoding.unit_codec, encoding.errors))
    return lines[:-1] if lines[-1] == "" else lines


def _mapped(df: DataFrame, change) -> DataFrame:
    """``df`` with its column ``value`` (bytes) changed row by row, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("value")
            new = [None if v is None else change(v) for v in batch.column(at).to_pylist()]
            yield batch.set_column(at, "value", pa.array(new, pa.binary()))

    return df.mapInArrow(run, df.schema)


def decoded(lines: DataFrame, encoding: Encoding) -> DataFrame:
    return _mapped(lines, encoding.decode)


def encoded(lines: DataFrame, encoding: Encoding) -> DataFrame:
    """Lines (line_no, value as bytes) in an encoding; a byte order mark leads line 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, values = batch.column("line_no").to_pylist(), batch.column("value").to_pylist()
            new = [(encoding.mark() if n == 0 else b"") + encoding.encode(v) for n, v in zip(numbers, values)]
            yield pa.RecordBatch.from_arrays([batch.column("line_no"), pa.array(new, pa.binary())], ["line_no", "value"])

    return lines.select("line_no", "value").mapInArrow(run, "line_no bigint, value binary")
