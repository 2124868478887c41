"""WAV and raw PCM files written from blocks, as a Python data source.

``df.write.format("wav").mode("append").option("path", folder).save()`` makes a
file of each recording from rows (recording_id, start_sample, samples).  Tasks
write their ranges of samples to their places in files of a hidden folder; no
row, task or driver holds a recording.  Each task's commit message says which
ranges it wrote; the driver makes sure that they cover every recording once,
writes the headers and moves the files to their names.  If a task or the commit
fails, the hidden folder goes and nothing else has changed.  Options:

=============  ==========================================================
path           the target folder; driver and executors have to share it
sampleRate     24,000 by default
kind           ``wav`` (default) or ``raw``, without a header
values         ``int16`` (default), ``int24``, ``int32``, ``float32``
=============  ==========================================================

Ranges are written in place, so the folder has to be on a file system with
paths (a shared mount, or this machine's for local runs).  A task that runs
twice writes the same bytes to the same places.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections import OrderedDict, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .wav_format import WRITTEN_BEGIN, encode_values, written_header

VALUES = {"int16": (2, False), "int24": (3, False), "int32": (4, False), "float32": (4, True)}
#: Files that a task keeps open.
OPEN_FILES = 64


@dataclass
class Written(WriterCommitMessage):
    """Ranges [start, end) of samples by recording."""

    ranges: dict


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, those that meet put together; of repeated ones the first counts."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(set(ranges)):
        if out and out[-1][1] == lo:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


class WavWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        missing = {"recording_id", "start_sample", "samples"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"no column {', '.join(sorted(missing))}")
        parts = urlsplit(options["path"])
        if parts.scheme not in ("", "file"):
            raise ValueError(f"files can't be written in place at {options['path']}")
        self.folder, self.overwrite = parts.path, overwrite
        self.rate, self.kind = int(options.get("samplerate", 24_000)), options.get("kind", "wav")
        self.width, self.is_float = VALUES[options.get("values", "float32" if self.kind == "raw" else "int16")]
        self.begin = WRITTEN_BEGIN if self.kind == "wav" else 0
        self.hidden = f"{self.folder}/_writing-{uuid.uuid4().hex}"

    def target(self, recording: str) -> str:
        return f"{self.folder}/{recording}.{'wav' if self.kind == 'wav' else 'pcm'}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        os.makedirs(self.hidden, exist_ok=True)
        files: OrderedDict[str, int] = OrderedDict()
        ranges = defaultdict(list)
        try:
            for batch in iterator:
                for recording, start, samples in zip(*(batch.column(c) for c in ("recording_id", "start_sample", "samples")), strict=True):
                    name, start = quote(str(recording.as_py()), safe=""), start.as_py()
                    x = (samples.values if samples.values is not None else pa.array([], pa.float64())).to_numpy(zero_copy_only=False)
                    if name not in files:
                        if len(files) >= OPEN_FILES:
                            os.close(files.popitem(last=False)[1])
                        files[name] = os.open(f"{self.hidden}/{name}", os.O_WRONLY | os.O_CREAT, 0o644)
                    files.move_to_end(name)
                    raw, at = encode_values(x, self.width, self.is_float), self.begin + start * self.width
                    while raw:
                        done = os.pwrite(files[name], raw, at)
                        raw, at = raw[done:], at + done
                    ranges[name].append((start, start + len(x)))
        finally:
            for f in files.values():
                os.close(f)
        return Written({name: merged([r for r in own if r[0] < r[1]]) for name, own in ranges.items()})

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        try:
            ranges = defaultdict(list)
            for message in messages:
                for name, own in (message.ranges if message else {}).items():
                    ranges[name] += own
            for name, own in ranges.items():
                whole = merged(own)
                if len(whole) > 1 or (whole and whole[0][0] != 0):
                    raise ValueError(f"the samples of {unquote(name)} have gaps or come twice: {whole[:4]}")
                if not self.overwrite and os.path.exists(self.target(name)):
                    raise FileExistsError(self.target(name))
            for name, own in ranges.items():
                n = max((hi for _, hi in own), default=0)
                with open(f"{self.hidden}/{name}", "r+b") as f:
                    if self.kind == "wav":
                        f.write(written_header(n, self.rate, self.width, self.is_float))
                    f.truncate(self.begin + n * self.width + (n * self.width % 2 if self.kind == "wav" else 0))
                    os.fsync(f.fileno())
            for name in ranges:
                os.replace(f"{self.hidden}/{name}", self.target(name))
        finally:
            shutil.rmtree(self.hidden, ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.hidden, ignore_errors=True)
