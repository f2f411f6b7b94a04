"""A data source of numbered text lines, read by byte ranges without a copy of the text.

A line belongs to the range that its first byte lies in. Lines are counted per range
first (one small row each); then every range knows the number of its first line, and a
reader that wants the first n lines gets only the ranges that hold them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import astuple, dataclass
from urllib.parse import quote, unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import session
from .encodings import Encoding, encoding_of, split_units

SCHEMA = "file string, line_no bigint, value binary"
# Endings that Spark's text reader decompresses; such files have no byte ranges.
PACKED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst", ".xz")
LEAST_RANGE = 1 << 16  # bytes, of files too small for one range per core
BATCH_BYTES = 1 << 22  # lines sent to Spark at a time
GROWTH = 4  # ranges counted, from round to round, until they hold the lines asked for


@dataclass
class LineRange(InputPartition):
    path: str
    begin: int
    end: int
    first: int = 0  # number of its first line
    encoding: str = "utf-8"
    big: bool = False  # units of two or four bytes, the high byte first

    def units(self) -> Encoding:
        known = encoding_of(self.encoding)
        return Encoding(known.name, known.charset, known.unit, self.big, known.marked)


def open_file(path: str):
    """A seekable file of a local path or of any file system that Arrow knows."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return open(unquote(parts.path), "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _starts(raw: bytes, before: bytes, units: Encoding) -> np.ndarray:
    """Places in ``raw`` where a line begins; ``before`` is the unit in front, if any."""
    kind = np.dtype(f"{'>' if units.big else '<'}u{units.unit}")
    codes = np.frombuffer((before or np.array([10], kind).tobytes()) + raw, dtype=kind)
    ends = (codes[:-1] == 10) | (codes[:-1] == 13) & (codes[1:] != 10)
    return np.flatnonzero(ends) * units.unit


def _range_bytes(file, part: LineRange, units: Encoding) -> tuple[bytes, np.ndarray]:
    """The bytes of a range, and where lines begin in it."""
    file.seek(max(0, part.begin - units.unit))
    before = file.read(units.unit) if part.begin else b""
    raw = file.read(part.end - part.begin)
    return raw, _starts(raw, before, units)


def lines_of(part: LineRange) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first, lines) of the lines that begin in a range, some at a time.

    Lines of wide units come as UTF-8, others as the bytes of the file.
    """
    units = part.units()
    line_feed = "\n".encode(units.unit_codec) if units.unit > 1 else b"\n"
    with open_file(part.path) as file:
        raw, starts = _range_bytes(file, part, units)
        if not len(starts):
            return
        while not raw.endswith(line_feed):  # the last line may reach into the next ranges,
            more = file.read(LEAST_RANGE)  # and after a carriage return the line feed may still come
            cut = _starts(more, raw[-units.unit :], units)
            if not more or len(cut):
                raw += more[: cut[0]] if len(cut) else b""
                break
            raw += more
    at = 0
    while at < len(starts):
        until = max(at + 1, int(np.searchsorted(starts, starts[at] + BATCH_BYTES)))
        stop = starts[until] if until < len(starts) else len(raw)
        yield part.first + at, _cut(raw[starts[at] : stop], units, part.begin + starts[at] == 0)
        at = until


def _cut(raw: bytes, units: Encoding, leads: bool) -> list[bytes]:
    if units.unit == 1:
        return raw.splitlines()
    lines = split_units(raw, units)
    if leads and units.marked:
        lines[0] = lines[0].removeprefix("\ufeff")
    return [line.encode("utf-8", "surrogatepass") for line in lines]


class LinesReader(DataSourceReader):
    def __init__(self, options):
        self.ranges = [LineRange(*r) for r in json.loads(options["ranges"])]

    def partitions(self):
        return self.ranges

    def read(self, partition: LineRange) -> Iterator[pa.RecordBatch]:
        for first, lines in lines_of(partition):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([partition.path] * len(lines)),
                    pa.array(np.arange(first, first + len(lines))),
                    pa.array(lines, pa.binary()),
                ],
                ["file", "line_no", "value"],
            )


class NumberedLines(DataSource):
    """``spark.read.format("xspace_lines")`` with the ranges of ``line_ranges``."""

    @classmethod
    def name(cls) -> str:
        return "xspace_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return LinesReader(self.options)


def _files(spark: SparkSession, paths) -> list[tuple[str, int]]:
    """(URI, bytes) of the files that Spark's own readers find, in order of their names."""
    found = spark.read.format("binaryFile").load(paths).select("path", "length").collect()  # no content is read
    return sorted((_uri(r["path"]), r["length"]) for r in found if r["length"])


def _uri(path: str) -> str:
    parts = urlsplit(path.replace("#", "%23").replace("?", "%3F"))
    if parts.scheme in ("", "file"):
        return "file://" + quote(path.split(":", 1)[-1] if parts.scheme else path)
    return path


def _counted(spark: SparkSession, ranges: list[LineRange]) -> list[int]:
    """Lines that begin in each range, counted where the data can be read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            counts = []
            for r in rows:
                part = LineRange(r["path"], r["begin"], r["end"], 0, r["encoding"], r["big"])
                with open_file(r["path"]) as file:
                    counts.append(len(_range_bytes(file, part, part.units())[1]))
            yield pa.RecordBatch.from_arrays([pa.array([r["k"] for r in rows]), pa.array(counts)], ["k", "n"])

    rows = [(k, r.path, r.begin, r.end, r.encoding, r.big) for k, r in enumerate(ranges)]
    table = spark.createDataFrame(rows, "k bigint, path string, begin bigint, end bigint, encoding string, big boolean")
    spread = table.repartition(min(len(rows), session.parallelism(spark)))
    n = {r["k"]: r["n"] for r in spread.mapInArrow(count, "k bigint, n bigint").collect()}
    return [n[k] for k in range(len(rows))]


def _big(path: str, units: Encoding) -> bool:
    """Whether the high byte of a unit comes first, by the file's mark where that decides."""
    if not units.marked:
        return units.big
    with open_file(path) as file:
        return file.read(units.unit) == "\ufeff".encode(f"utf-{8 * units.unit}-be")


def line_ranges(
    spark: SparkSession, paths, per_file: bool = False, most: int | None = None, encoding: str = "utf-8"
) -> list[LineRange] | None:
    """Byte ranges with the numbers of their first lines; None where ranges cannot be read.

    With ``most`` only ranges that hold the first ``most`` lines are counted and returned.
    Ranges begin at whole units of the encoding.
    """
    units = encoding_of(encoding)
    files = _files(spark, paths)
    if any(p.lower().endswith(PACKED) for p, _ in files):
        return None
    try:
        for path, _ in files[:1]:
            open_file(path).close()
    except (OSError, ValueError, pa.ArrowException):
        return None  # a file system of Spark alone
    for path, size in files:
        if size % units.unit:
            raise ValueError(f"{path} has {size} bytes, not whole units of encoding {encoding!r}")
    limit = int(spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("b"))
    total = sum(n for _, n in files)
    step = min(limit, max(LEAST_RANGE, -(-total // session.parallelism(spark))))
    step = max(units.unit, step - step % units.unit)
    ends = {p: _big(p, units) for p, _ in files}
    ranges = [LineRange(p, at, min(at + step, n), 0, units.name, ends[p]) for p, n in files for at in range(0, n, step)]
    if len(ranges) > 1:
        counts, k = [], len(ranges) if most is None else 1
        while True:
            counts += _counted(spark, ranges[len(counts) : k])
            if k >= len(ranges) or sum(counts) >= most:
                break
            k = min(len(ranges), GROWTH * k)
        first = 0
        for k, (r, n) in enumerate(zip(ranges, counts)):
            if per_file and r.begin == 0:
                first = 0
            r.first, first = first, first + n
            if most is not None and first >= most:
                return ranges[: k + 1]
    return ranges


def numbered_lines(spark: SparkSession, ranges: list[LineRange]) -> DataFrame:
    """(file, line_no, value as bytes) of some ranges."""
    spark.dataSource.register(NumberedLines)
    packed = json.dumps([astuple(r) for r in ranges])
    return spark.read.format("xspace_lines").option("ranges", packed).load()
