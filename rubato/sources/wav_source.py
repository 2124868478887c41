"""WAV files as a Python data source, batch and stream.

``spark.read.format("wav")`` gives blocks of samples; its partitions are ranges
of bytes of the files, planned from their lengths alone.  A task follows the
chunk list of a file's header and then reads the blocks that begin in its
range.  Options:

=================  =======================================================
path               a file or a folder, with all files below it
content            ``samples`` (default) or ``headers``
blockSamples       samples of a block, 120,000 by default; or
blockSeconds       its length in seconds
overlapSeconds     how far a block reaches into its neighbours, 0 by default
start, duration    only blocks that reach into these seconds, cut to them
splitBytes         bytes of a partition, 32 MB by default
=================  =======================================================

Filters on ``path``, ``block_idx`` and ``start_sample`` are pushed to the
reader: files and blocks beyond them are not read.  ``register`` turns that on.
Files are opened through pyarrow, so any of its file systems will do.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringEndsWith,
    StringStartsWith,
)
from pyspark.sql.types import StructType

from .wav_format import WavHeader, mono, parse_header

BLOCK_SAMPLES = 120_000
SPLIT_BYTES = 32 << 20
#: What a file counts at least when partitions are packed, as opening it costs too.
OPEN_BYTES = 64 << 10
SAMPLES = "path string, block_idx int, start_sample long, sample_rate int, lead int, n_samples long, samples array<float>"
HEADERS = "path string, length long, sample_rate int, channels int, width int, is_float boolean, n_samples long, duration double"


@dataclass(frozen=True)
class Piece:
    path: str
    length: int
    lo: int
    hi: int


@dataclass
class Pieces(InputPartition):
    pieces: tuple[Piece, ...]

    def __init__(self, pieces: Iterable[Piece]):
        self.pieces = tuple(pieces)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    if urlsplit(path).scheme:
        return fs.FileSystem.from_uri(path.replace("file:///", "file:/", 1).replace("file:/", "file:///", 1))
    return fs.LocalFileSystem(), path


def list_files(path: str) -> list[fs.FileInfo]:
    """All files at or below a path, by name; hidden ones are left out."""
    system, inner = file_system(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted((f for f in found if f.is_file and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)


def pack(pieces: Iterable[Piece], split: int) -> list[Pieces]:
    """Pieces put together to partitions of about ``split`` bytes."""
    out, held, size = [], [], 0
    for piece in pieces:
        cost = max(OPEN_BYTES, piece.hi - piece.lo)
        if held and size + cost > split:
            out.append(Pieces(held))
            held, size = [], 0
        held.append(piece)
        size += cost
    return [*out, Pieces(held)] if held else out


class Wanted:
    """Which files and blocks the pushed filters leave."""

    def __init__(self) -> None:
        self.names: list[Filter] = []
        self.first, self.last = 0, math.inf  # of block_idx
        self.low, self.high = 0, math.inf  # of start_sample, both included

    def take(self, f: Filter) -> bool:
        """Whether the filter is wholly applied by the reader."""
        if len(getattr(f, "attribute", ())) != 1:
            return False
        column, whole = f.attribute[0], isinstance(getattr(f, "value", None), int)
        if column == "path" and isinstance(f, EqualTo | In | StringStartsWith | StringEndsWith):
            self.names.append(f)
            return True
        if column in ("block_idx", "start_sample") and whole and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
            low = f.value + isinstance(f, GreaterThan) if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual) else 0
            high = f.value - isinstance(f, LessThan) if isinstance(f, EqualTo | LessThan | LessThanOrEqual) else math.inf
            if column == "block_idx":
                self.first, self.last = max(self.first, low), min(self.last, high)
            else:
                self.low, self.high = max(self.low, low), min(self.high, high)
            return True
        return False

    def holds(self, path: str) -> bool:
        tests = {EqualTo: lambda v: path == v, In: lambda v: path in v, StringStartsWith: path.startswith, StringEndsWith: path.endswith}
        return all(tests[type(f)](f.value) for f in self.names)


class Blocks:
    """How the files are cut, from the options."""

    def __init__(self, options: dict):
        self.headers = options.get("content", "samples") == "headers"
        self.samples = int(options.get("blocksamples", BLOCK_SAMPLES))
        self.seconds = float(options["blockseconds"]) if "blockseconds" in options else None
        self.overlap = float(options.get("overlapseconds", 0))
        self.start = float(options.get("start", 0))
        self.end = self.start + float(options["duration"]) if "duration" in options else math.inf
        if self.samples < 1 or (self.seconds is not None and self.seconds <= 0):
            raise ValueError("a block has to hold a sample")

    def read(self, piece: Piece, wanted: Wanted) -> Iterator[pa.RecordBatch]:
        """The rows of the blocks that begin in a piece of a file; a file that is no WAV has one row, without samples."""
        system, inner = file_system(piece.path)
        with system.open_input_file(inner) as f:
            header = parse_header(lambda at, n: f.read_at(min(n, max(0, piece.length - at)), at), piece.length)
            if self.headers:
                yield self.header_row(piece, header)
                return
            if header is None or not header.n_samples:
                if piece.lo == 0 and not self.start and wanted.first == 0 and wanted.low == 0:
                    yield self.row(piece, header, 0, 0, 0, np.zeros(0))
                return
            step = self.samples if self.seconds is None else math.ceil(header.sample_rate * self.seconds)
            reach = math.ceil(header.sample_rate * self.overlap)
            lo, hi = math.floor(self.start * header.sample_rate), min(header.n_samples, math.floor(self.end * header.sample_rate) if self.end < math.inf else header.n_samples)
            # blocks whose first byte lies in the piece, within the time range and the filters
            place = lambda at: max(0, -(-(at - header.begin) // (step * header.frame)))
            first = max(place(piece.lo) if piece.lo else 0, lo // step, wanted.first)
            last = min(place(piece.hi), -(-hi // step), wanted.last + 1)
            for k in range(int(first), int(last)):
                a, b = max(lo, k * step), min(hi, (k + 1) * step)
                if b <= a or not wanted.low <= a <= wanted.high:
                    continue
                lead = min(reach, a - lo)
                tail = min(reach, hi - b)
                raw = f.read_at((lead + b - a + tail) * header.frame, header.begin + (a - lead) * header.frame)
                yield self.row(piece, header, k, a, lead, mono(raw, header))

    @staticmethod
    def row(piece: Piece, header: WavHeader | None, k: int, start: int, lead: int, x: np.ndarray) -> pa.RecordBatch:
        samples = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x.astype(np.float32)))
        values = [[piece.path], [k], [start], [header and header.sample_rate], [lead], [header and header.n_samples]]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        columns = [pa.array(v, t) for v, t in zip(values, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*columns, samples], [c.split()[0] for c in SAMPLES.split(", ")])

    @staticmethod
    def header_row(piece: Piece, h: WavHeader | None) -> pa.RecordBatch:
        values = [piece.path, piece.length, *((h.sample_rate, h.channels, h.width, h.is_float, h.n_samples, h.duration) if h else (None,) * 6)]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], [c.split()[0] for c in HEADERS.split(", ")])


class WavReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.blocks, self.wanted = options["path"], Blocks(options), Wanted()
        self.split = int(options.get("splitbytes", SPLIT_BYTES))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def pieces(self, path: str, length: int) -> Iterator[Piece]:
        if self.blocks.headers:
            yield Piece(path, length, 0, 1)
        else:
            for lo in range(0, max(1, length), self.split):
                yield Piece(path, length, lo, min(lo + self.split, max(1, length)))

    def partitions(self) -> list[InputPartition]:
        files = [f for f in list_files(self.path) if self.wanted.holds(f.path)]
        return pack((p for f in files for p in self.pieces(f.path, f.size)), self.split)

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        for piece in partition.pieces:
            yield from self.blocks.read(piece, self.wanted)


class WavStreamReader(DataSourceStreamReader):
    """Files as they come, by the time of their last change and name; a file has to be moved into the folder whole."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"at": -1, "path": ""}

    def latestOffset(self) -> dict:
        at, path = max(((f.mtime_ns, f.path) for f in list_files(self.options["path"])), default=(-1, ""))
        return {"at": at, "path": path}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        bounds = [(o["at"], o["path"]) for o in (start, end)]
        reader = WavReader(self.options)
        files = [f for f in list_files(self.options["path"]) if bounds[0] < (f.mtime_ns, f.path) <= bounds[1]]
        return pack((p for f in files for p in reader.pieces(f.path, f.size)), reader.split)

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        return WavReader(self.options).read(partition)

    def commit(self, end: dict) -> None:
        json.dumps(end)  # nothing to let go of; files stay


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return HEADERS if self.options.get("content", "samples") == "headers" else SAMPLES

    def reader(self, schema: StructType) -> DataSourceReader:
        return WavReader(_lower(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return WavStreamReader(_lower(self.options))

    def writer(self, schema: StructType, overwrite: bool):
        from .wav_sink import WavWriter

        return WavWriter(_lower(self.options), schema, overwrite)


def _lower(options) -> dict:
    return {k.lower(): v for k, v in options.items()}


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WavSource)
