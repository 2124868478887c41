"""WAV files as a data source: headers, ranges of bytes, kinds of values, stream and sink."""

from __future__ import annotations

import io
import os
import struct
import tempfile
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F
from rubato.sources import audio, wav_format, wav_source

RNG = np.random.default_rng(4)


def riff(*chunks: tuple[bytes, bytes], top: bytes = b"RIFF") -> bytes:
    body = b"".join(struct.pack("<4sI", name, len(data)) + data + b"\0" * (len(data) % 2) for name, data in chunks)
    return struct.pack("<4sI4s", top, 4 + len(body), b"WAVE") + body


def form(tag: int, bits: int, channels: int = 1, rate: int = 24_000, sub: int | None = None) -> bytes:
    width = bits // 8 * channels
    plain = struct.pack("<HHIIHH", 0xFFFE if sub else tag, channels, rate, rate * width, width, bits)
    return plain + (struct.pack("<HHIH", 22, bits, 0, sub) + wav_format.SUBFORMAT_TAIL if sub else b"")


def header(raw: bytes):
    return wav_format.parse_header(lambda at, n: raw[at : at + n], len(raw))


def folder_of(**files: bytes) -> str:
    folder = tempfile.mkdtemp(prefix="spark-")
    for name, raw in files.items():
        with open(f"{folder}/{name}.wav", "wb") as f:
            f.write(raw)
    return folder


@pytest.mark.parametrize(("tag", "bits", "sub"), [(1, 8, None), (1, 16, None), (1, 24, None), (1, 32, None), (3, 32, None), (3, 64, None), (0, 32, 3), (0, 24, 1), (0, 16, 1)])
def test_kinds_of_values(tag, bits, sub):
    x = np.array([0.5, -0.25, 0.0, -1.0, 0.75])
    is_float = 3 in (tag, sub)
    raw = riff((b"fmt ", form(tag, bits, sub=sub)), (b"data", wav_format.encode_values(x, bits // 8, is_float)))
    rate, found = audio.decode_wav(raw)
    assert rate == 24_000 and np.allclose(found, x, atol=0 if is_float else 1.5 / (1 << (bits - 1)))


def test_what_is_no_wav_here():
    data = (b"data", bytes(8))
    for raw in (b"", b"RIFF", b"no audio at all", riff(data), riff((b"fmt ", form(1, 16)[:8]), data), riff((b"fmt ", form(85, 16)), data), riff((b"fmt ", form(1, 12)), data), riff((b"fmt ", form(0, 16, sub=7)), data), riff((b"fmt ", form(1, 16)))):
        assert header(raw) is None


def test_odd_headers():
    x = wav_format.encode_values(np.array([0.5, 0.25]))
    long_list = (b"LIST", RNG.bytes(200_001))
    assert header(riff(long_list, (b"fmt ", form(1, 16)), (b"JUNK", bytes(70_000)), (b"data", x))).n_samples == 2
    assert audio.decode_wav(riff(long_list, (b"fmt ", form(1, 16)), (b"data", x), (b"LIST", b"abcd")))[1].tolist() == pytest.approx([0.5, 0.25], abs=1e-4)
    assert header(riff((b"fmt ", form(1, 16)), (b"data", b""), (b"LIST", b"abcd"))).n_samples == 0
    cut = riff((b"fmt ", form(1, 16)), (b"data", x * 50))[:-100]
    assert header(cut).n_samples == 50
    unknown = bytearray(riff((b"fmt ", form(1, 16)), (b"data", x)))
    unknown[40:44] = b"\xff" * 4
    assert header(bytes(unknown)).n_samples == 2


def test_files_over_4_gb_without_making_one():
    top = wav_format.written_header(3_000_000_000, 24_000)
    assert len(top) == wav_format.WRITTEN_BEGIN and top[:4] == b"RF64"
    found = wav_format.parse_header(lambda at, n: top[at : at + n], wav_format.WRITTEN_BEGIN + 6_000_000_000)
    assert found.n_samples == 3_000_000_000 and found.begin == wav_format.WRITTEN_BEGIN
    assert len(list(wav_source.WavReader({"path": "x"}).pieces("x", 6_000_000_000))) == 179


def test_written_files_are_read_by_others():
    x = RNG.uniform(-1, 1, 1001)
    with wave.open(io.BytesIO(audio.encode_wav(x, 16_000))) as w:
        assert (w.getframerate(), w.getnchannels(), w.getsampwidth(), w.getnframes()) == (16_000, 1, 2, 1001)
        assert np.allclose(np.frombuffer(w.readframes(1001), "<i2") / 32767, x, atol=1e-4)


class Counted:
    """A file system that counts the bytes read of each file."""

    def __init__(self):
        self.read = {}

    def of(self, path):
        system, inner = wav_source.fs.LocalFileSystem(), path
        outer = self

        class System:
            def open_input_file(self, name):
                f = system.open_input_file(name)

                class File:
                    def __enter__(self):
                        return self

                    def __exit__(self, *_):
                        f.close()

                    def read_at(self, n, at):
                        raw = f.read_at(n, at)
                        outer.read[name] = outer.read.get(name, 0) + len(raw)
                        return raw

                return File()

        return System(), inner


def run_reader(monkeypatch, filters=(), **options):
    counted, files = Counted(), wav_source.list_files(options["path"])
    monkeypatch.setattr(wav_source, "list_files", lambda path: files)
    monkeypatch.setattr(wav_source, "file_system", counted.of)
    reader = wav_source.WavReader({k.lower(): v for k, v in options.items()})
    left = list(reader.pushFilters(list(filters)))
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    monkeypatch.undo()
    return [r for b in batches for r in b.to_pylist()], counted.read, left


def test_only_the_bytes_that_are_wanted_are_read(monkeypatch):
    x = RNG.uniform(-1, 1, 24_000 * 60)
    folder = folder_of(a=audio.encode_wav(x, 24_000), b=audio.encode_wav(x[:1000], 24_000))
    a = f"{folder}/a.wav"
    rows, read, _ = run_reader(monkeypatch, path=folder, content="headers")
    assert [r["n_samples"] for r in rows] == [len(x), 1000] and max(read.values()) <= 2 * wav_format.HEAD_BYTES
    rows, read, _ = run_reader(monkeypatch, path=a, start=20.0, duration=10.0)
    assert np.allclose(np.concatenate([r["samples"] for r in rows]), x[480_000:720_000], atol=1e-4) and rows[0]["start_sample"] == 480_000
    assert read[a] <= 2 * 240_000 + 10 * wav_format.HEAD_BYTES
    filters = [wav_source.StringEndsWith(("path",), "a.wav"), wav_source.GreaterThanOrEqual(("start_sample",), 240_000), wav_source.LessThan(("start_sample",), 480_000)]
    rows, read, left = run_reader(monkeypatch, filters, path=folder, splitBytes=100_000)
    assert [r["block_idx"] for r in rows] == [2, 3] and list(read) == [a] and not left
    pieces = len(x) * 2 // 100_000 + 1
    assert read[a] <= 2 * 240_000 + pieces * 2 * wav_format.HEAD_BYTES


@pytest.mark.parametrize("split", [1000, 7777, 1 << 20])
@pytest.mark.parametrize("channels", [1, 3])
def test_every_sample_comes_once(monkeypatch, split, channels):
    x = RNG.uniform(-1, 1, (5000, channels))
    raw = riff((b"LIST", bytes(3001)), (b"fmt ", form(1, 24, channels, 8000)), (b"data", wav_format.encode_values(x.ravel(), 3)), (b"LIST", bytes(2001)))
    rows, _, _ = run_reader(monkeypatch, path=folder_of(x=raw), splitBytes=split, blockSamples=701)
    assert [r["block_idx"] for r in rows] == list(range(8))
    assert np.allclose(np.concatenate([r["samples"] for r in rows]), x.mean(axis=1), atol=1e-5)
    rows, _, _ = run_reader(monkeypatch, path=folder_of(x=raw), splitBytes=split, blockSeconds=0.1, overlapSeconds=0.01)
    for r in rows:
        start = r["start_sample"] - r["lead"]
        assert r["lead"] == (80 if r["block_idx"] else 0) and np.allclose(r["samples"], x.mean(axis=1)[start : start + len(r["samples"])], atol=1e-5)


def test_source_in_spark(spark):
    x = RNG.uniform(-1, 1, 300_000)
    floats = riff((b"fmt ", form(0, 32, sub=3)), (b"data", wav_format.encode_values(x[:50], 4, True)))
    folder = folder_of(a=audio.encode_wav(x, 24_000), f=floats, bad=b"no audio")
    found = {os.path.basename(r.path): r for r in audio.wav_headers(spark, folder).collect()}
    assert found["f.wav"].is_float and found["f.wav"].n_samples == 50 and found["bad.wav"].duration is None
    part = audio.read_wav_range(spark, folder, 6.0, 1.0).collect()
    assert [(os.path.basename(r.path), r.start_sample) for r in part] == [("a.wav", 144_000)] and np.allclose(part[0].samples, x[144_000:168_000], atol=1e-4)
    own = audio.read_wav(spark, folder).where(F.col("path").endswith("a.wav") & (F.col("start_sample") >= 240_000))
    assert [r.block_idx for r in own.collect()] == [2]
    assert [r.samples for r in audio.read_wav(spark, f"{folder}/f.wav").collect()][0] == pytest.approx(x[:50].tolist(), abs=1e-6)


def test_stream_of_files(spark):
    folder, target, checkpoint = folder_of(a=audio.encode_wav(np.ones(1000) / 2, 24_000)), *(tempfile.mkdtemp(prefix="spark-") for _ in range(2))
    wav_source.register(spark)

    def go() -> dict:
        stream = spark.readStream.format("wav").option("path", folder).option("blockSamples", 300).load()
        query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return {(os.path.basename(r.path), r.start_sample): len(r.samples) for r in spark.read.parquet(target).collect()}

    first = go()
    assert first == {("a.wav", k): n for k, n in ((0, 300), (300, 300), (600, 300), (900, 100))}
    with open(f"{folder}/b.wav", "wb") as f:
        f.write(audio.encode_wav(np.ones(200), 24_000))
    assert go() == first | {("b.wav", 0): 200}


def blocks_frame(spark, recordings: dict, block: int):
    rows = [(k, i, x[i : i + block].tolist()) for k, x in recordings.items() for i in range(0, max(1, len(x)), block)]
    return spark.createDataFrame(rows, "recording_id string, start_sample long, samples array<double>")


def test_sink_writes_long_recordings_from_blocks(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    n = 5_000_000
    ids = spark.range(21).select((F.col("id") * 240_000).alias("start_sample"))
    samples = F.transform(F.sequence(F.col("start_sample"), F.least(F.col("start_sample") + 240_000, F.lit(n)) - 1), lambda i: F.sin(i / 100) / 2)
    audio.write_wav(ids.repartition(7).select(F.lit("a/b c").alias("recording_id"), "start_sample", samples.alias("samples")), folder)
    assert os.listdir(folder) == ["a%2Fb%20c.wav"]
    rate, found = audio.decode_wav(open(f"{folder}/a%2Fb%20c.wav", "rb").read())
    assert rate == 24_000 and len(found) == n and np.allclose(found, np.sin(np.arange(n) / 100) / 2, atol=1e-4)


@pytest.mark.parametrize("values", ["int16", "int24", "int32", "float32"])
def test_sink_and_source_round_trip(spark, values):
    recordings = {"x": RNG.uniform(-1, 1, 1001), "empty": np.zeros(0), "y": RNG.uniform(-1, 1, 70)}
    folder = tempfile.mkdtemp(prefix="spark-")
    audio.write_wav(blocks_frame(spark, recordings, 64).repartition(5), folder, values=values)
    back = {r.path: r for r in audio.read_wav(spark, folder).collect()}
    for name, x in recordings.items():
        assert np.allclose(back[f"{folder}/{name}.wav"].samples, x, atol=1e-4)
    audio.write_wav(blocks_frame(spark, recordings, 64), folder, kind="raw")
    assert np.allclose(np.fromfile(f"{folder}/x.pcm", "<f4"), recordings["x"], atol=1e-6)


def test_a_failed_write_leaves_nothing(spark):
    good = {"x": RNG.uniform(-1, 1, 500)}
    for bad in (
        blocks_frame(spark, good, 100).where("start_sample <> 200"),  # a gap
        blocks_frame(spark, good, 100).union(blocks_frame(spark, good, 150)),  # samples that come twice
        blocks_frame(spark, good, 100).withColumn("samples", F.when(F.col("start_sample") == 300, F.raise_error(F.lit("lost"))).otherwise(F.col("samples"))),  # a task that fails
    ):
        folder = tempfile.mkdtemp(prefix="spark-")
        with pytest.raises(Exception):  # noqa: B017
            audio.write_wav(bad.repartition(3), folder)
        assert os.listdir(folder) == []
    folder = tempfile.mkdtemp(prefix="spark-")
    audio.write_wav(blocks_frame(spark, good, 100), folder)
    with pytest.raises(Exception):  # noqa: B017
        audio.write_wav(blocks_frame(spark, {"x": np.zeros(5)}, 100), folder)
    assert len(audio.decode_wav(open(f"{folder}/x.wav", "rb").read())[1]) == 500 and os.listdir(folder) == ["x.wav"]
    audio.write_wav(blocks_frame(spark, {"x": np.zeros(5)}, 100), folder, overwrite=True)
    assert len(audio.decode_wav(open(f"{folder}/x.wav", "rb").read())[1]) == 5
