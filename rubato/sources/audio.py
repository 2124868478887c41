"""Recordings from and to WAV files, training items and analysis documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.signal import array_column, array_values
from . import wav_source
from .wav_format import encode_values, mono, parse_header, written_header

#: Suffixes of the output formats, and whether there is an encoder here.
FORMATS = {".wav": True, ".mp3": False, ".m4a": False, ".flac": False}


def decode_wav(raw: bytes) -> tuple[int, np.ndarray]:
    """(sample rate, mono samples in [-1, 1]) of a whole WAV file's bytes."""
    header = parse_header(lambda at, n: raw[at : at + n], len(raw))
    if header is None:
        raise ValueError("no PCM or float WAV")
    return header.sample_rate, mono(raw[header.begin : header.begin + header.n_bytes], header).astype(np.float32)


def encode_wav(samples: np.ndarray, sample_rate: int) -> bytes:
    """A WAV file's bytes, 16 bits mono."""
    raw = encode_values(samples)
    return written_header(len(samples), sample_rate) + raw


def wav_blocks(spark: SparkSession, path: str, **options: float | str) -> DataFrame:
    """The data source of ``wav_source`` with its options."""
    wav_source.register(spark)
    return spark.read.format("wav").options(path=path, **options).load()


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """Blocks (path, block_idx, start_sample, sample_rate, samples) of the WAV files under ``path``.

    Partitions are byte ranges of the files.  A file that is no WAV gives one
    row without samples; filters on path and place are pushed to the reader.
    """
    return wav_blocks(spark, path).select("path", "block_idx", "start_sample", "sample_rate", "samples")


def read_wav_range(spark: SparkSession, path: str, start: float, duration: float) -> DataFrame:
    """The same for ``duration`` seconds from ``start`` on; only their bytes are read."""
    found = wav_blocks(spark, path, start=start, duration=duration)
    return found.where(F.size("samples") > 0).select("path", "block_idx", "start_sample", "sample_rate", "samples")


def wav_payloads(recordings: DataFrame, sample_rate: int) -> DataFrame:
    """(recording_id, payload) with each recording as one WAV file's bytes."""
    kind = recordings.schema["recording_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [encode_wav(np.array(x.as_py() or []), sample_rate) for x in batch.column("samples")]
            yield pa.RecordBatch.from_arrays([batch.column("recording_id"), pa.array(raw, pa.binary())], ["recording_id", "payload"])

    return recordings.select("recording_id", "samples").mapInArrow(run, f"recording_id {kind}, payload binary")


def pcm_payloads(recordings: DataFrame) -> DataFrame:
    """(recording_id, payload) with each recording's samples as raw little-endian 32-bit floats."""
    kind = recordings.schema["recording_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at = array_values(batch.column("samples"))
            raw = [values[a:b].astype("<f4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("recording_id"), pa.array(raw, pa.binary())], ["recording_id", "payload"])

    return recordings.select("recording_id", "samples").mapInArrow(run, f"recording_id {kind}, payload binary")


def payloads(recordings: DataFrame, sample_rate: int, suffix: str = ".wav") -> DataFrame:
    """Encoded recordings in the format of ``suffix``; an unknown one, or one without an encoder here, raises."""
    if not FORMATS.get(suffix.lower()):
        raise ValueError(f"unknown format {suffix}" if suffix.lower() not in FORMATS else f"no encoder for {suffix} here")
    return wav_payloads(recordings, sample_rate)


def wav_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sample_rate, channels, width, is_float, n_samples, duration) of the files under ``path``, null where one is no WAV.

    A few KB of each file are read, never its samples.
    """
    return wav_blocks(spark, path, content="headers")


def probe_durations(spark: SparkSession, path: str) -> DataFrame:
    """(path, duration) in seconds from the headers; null on failure."""
    return wav_headers(spark, path).select("path", "duration")


def samples_between(blocks: DataFrame, start: float, duration: float) -> DataFrame:
    """The blocks' samples from ``start`` seconds on, for ``duration`` seconds; only blocks within are read further."""
    rate = F.col("sample_rate")
    lo, hi = F.floor(start * rate), F.floor((start + duration) * rate)
    own = blocks.where((F.col("start_sample") < hi) & (F.col("start_sample") + F.size("samples") > lo))
    first = F.greatest(F.lit(0), lo - F.col("start_sample")).cast("int")
    n = (F.least(F.size("samples"), hi - F.col("start_sample")) - first).cast("int")
    return own.withColumn("samples", F.slice("samples", first + 1, n)).withColumn("start_sample", F.col("start_sample") + first)


def resample(x: np.ndarray, source: int, target: int, zeros: int = 16) -> np.ndarray:
    """Another sample rate by a windowed sinc, ``zeros`` of its zero crossings on either side, edges as zeros."""
    if source == target or not len(x):
        return x
    n, cutoff = -(-len(x) * target // source), min(1.0, target / source)
    reach = int(np.ceil(zeros / cutoff))
    out = np.empty(n)
    padded = np.pad(x, reach + 1)
    for lo in range(0, n, 1 << 14):
        at = np.arange(lo, min(n, lo + (1 << 14))) * (source / target)
        near = np.floor(at).astype(np.int64)[:, None] + np.arange(-reach, reach + 1)
        d = near - at[:, None]
        kernel = cutoff * np.sinc(d * cutoff) * (0.5 + 0.5 * np.cos(np.pi * np.clip(d / (reach + 1), -1, 1)))
        out[lo : lo + len(at)] = (padded[near + reach + 1] * kernel).sum(axis=1)
    return out


def read_wav_parallel(spark: SparkSession, path: str, sample_rate: int = 24_000, seconds: float = 60.0, overlap: float = 0.05) -> DataFrame:
    """Blocks (recording_id, index, start_sample, samples) at one sample rate, a file's slices in tasks of their own.

    A slice of ``seconds`` reaches ``overlap`` seconds into its neighbours; after
    decoding and resampling, slices are cross-faded there.  Files that are no
    WAV have no blocks.
    """
    from ..operators.chunks import merge_parts

    slices = wav_blocks(spark, path, blockSeconds=seconds, overlapSeconds=overlap).where(F.size("samples") > 0)
    tail = F.col("start_sample") + F.size("samples") - F.col("lead") < F.col("n_samples")
    fade = lambda there: F.when(there, F.floor(F.lit(overlap * sample_rate))).otherwise(F.lit(0)).cast("long")
    parts = slices.select(F.col("path").alias("recording_id"), F.col("block_idx").alias("index"), "sample_rate", "samples", fade(F.col("lead") > 0).alias("fade_in"), fade(tail).alias("fade_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at = array_values(batch.column("samples"))
            rates = batch.column("sample_rate").to_pylist()
            for i, rate in enumerate(rates):
                out = resample(values[at[i] : at[i + 1]], rate, sample_rate)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in ("recording_id", "index", "fade_in", "fade_out")), array_column([out])], ["recording_id", "index", "fade_in", "fade_out", "samples"])

    return merge_parts(parts.mapInArrow(run, "recording_id string, index int, fade_in long, fade_out long, samples array<double>"))


def write_wav(blocks: DataFrame, folder: str, sample_rate: int = 24_000, overwrite: bool = False, **options: str) -> None:
    """A file of each recording in ``folder``, from blocks (recording_id, start_sample, samples); see ``wav_sink``."""
    wav_source.register(blocks.sparkSession)
    rows = blocks.select("recording_id", F.col("start_sample").cast("long").alias("start_sample"), F.transform("samples", lambda v: v.cast("double")).alias("samples"))
    rows.write.format("wav").mode("overwrite" if overwrite else "append").options(path=folder, sampleRate=sample_rate, **options).save()


def concatenated(blocks: DataFrame, order: DataFrame) -> DataFrame:
    """One signal (start_sample, samples) of several recordings' blocks, in the order of (recording_id, file_idx)."""
    sizes = blocks.groupBy("recording_id").agg(F.sum(F.size("samples")).alias("n")).join(order, "recording_id")
    before = F.coalesce(F.sum("n").over(Window.orderBy("file_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per file
    return blocks.join(sizes.select("recording_id", before.alias("_before")), "recording_id").select((F.col("_before") + F.col("start_sample")).alias("start_sample"), "samples")


def read_file_list(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the lines of text files that are not blank."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")


def drawn(seed: int, what: str) -> Column:
    """A number in [0, 1) of each recording_id, from 52 bits of a digest, the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}-{what}-"), F.col("recording_id").cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def crop_plan(sizes: DataFrame, n_samples: int, train: bool, seed: int) -> DataFrame:
    """``sizes`` (recording_id, total, ...) with where each crop begins and the gain of its peak; recordings without samples are left out.

    Gains are from -6 to -1 dB and places anywhere, both drawn by id, or -3 dB
    and the beginning if not to ``train``.
    """
    known = sizes.where("recording_id is not null and total > 0")
    spare = F.greatest(F.lit(1), F.col("total") - n_samples + 1)
    start, db = (F.floor(drawn(seed, "place") * spare), -6 + 5 * drawn(seed, "gain")) if train else (F.lit(0), F.lit(-3.0))
    return known.withColumn("start", start.cast("long")).withColumn("level", F.pow(F.lit(10.0), db / 20))


def training_items(blocks: DataFrame, block: int, n_samples: int = 24_000, train: bool = True, seed: int = 0) -> DataFrame:
    """(recording_id, samples) of ``n_samples`` each, from blocks: the recording's peak at the crop's gain; a short recording is repeated.

    The place is drawn before any samples are put together, so only the blocks
    that a crop reaches are joined.  A recording that is null, or has no
    samples, gives no item.
    """
    from ..operators.chunks import chunk_samples

    peak = F.max(F.array_max(F.transform("samples", F.abs)))
    sizes = blocks.groupBy("recording_id").agg(F.sum(F.size("samples")).cast("long").alias("total"), peak.cast("double").alias("peak"))
    plan = crop_plan(sizes, n_samples, train, seed)
    end = F.least(F.col("start") + n_samples, F.col("total"))
    scale = F.when(F.col("peak") > 0, F.col("level") / F.col("peak")).otherwise(F.lit(1.0))
    crops = plan.select("recording_id", F.col("start").alias("start_sample"), end.alias("end_sample"), scale.alias("scale"))
    found = chunk_samples(crops, blocks, block)
    repeats = F.ceil(n_samples / F.size("samples")).cast("int")
    filled = F.slice(F.flatten(F.array_repeat("samples", repeats)), 1, n_samples)
    return found.select("recording_id", F.transform(filled, lambda v: v * F.col("scale")).alias("samples"))


def read_training_items(spark: SparkSession, path: str, n_samples: int = 24_000, train: bool = True, seed: int = 0, peaks: DataFrame | None = None) -> DataFrame:
    """The same from the WAV files under ``path``, at their own rates; of each file, its header and the crop's bytes are read.

    ``peaks`` (path, peak) are the files' peaks, made once; without them a
    crop's own peak counts.
    """
    heads = wav_headers(spark, path).select(F.col("path").alias("recording_id"), F.col("n_samples").alias("total"), "length")
    plan = crop_plan(heads, n_samples, train, seed)
    plan = plan.join(peaks.select(F.col("path").alias("recording_id"), F.col("peak").cast("double").alias("peak")), "recording_id", "left") if peaks is not None else plan.withColumn("peak", F.lit(None).cast("double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = read_samples(row["recording_id"], row["length"], row["start"], n_samples)
                peak = np.abs(x).max(initial=0) if row["peak"] is None else row["peak"]
                out = np.resize(x, n_samples) * (row["level"] / peak if peak > 0 else 1.0)
                yield pa.RecordBatch.from_arrays([pa.array([row["recording_id"]]), array_column([out])], ["recording_id", "samples"])

    dealt = plan.select("recording_id", "length", "start", "level", "peak").repartition("recording_id")
    return dealt.mapInArrow(run, "recording_id string, samples array<double>")


def read_samples(path: str, length: int, start: int, n: int) -> np.ndarray:
    """Up to ``n`` samples of a file from ``start`` on; nothing else of it is read but its header."""
    system, inner = wav_source.file_system(path)
    with system.open_input_file(inner) as f:
        header = parse_header(lambda at, k: f.read_at(min(k, max(0, length - at)), at), length)
        k = max(0, min(n, header.n_samples - start)) if header else 0
        return mono(f.read_at(k * header.frame, header.begin + start * header.frame), header) if k else np.zeros(0)


def analysis_documents(scores: DataFrame, resolution: float) -> DataFrame:
    """(recording_id, document): a JSON object per recording from (recording_id, frame_idx, t, score)."""
    rows = F.sort_array(F.collect_list(F.struct("frame_idx", "t", "score")))
    grouped = scores.groupBy("recording_id").agg(F.max("t").alias("duration"), rows.alias("r"))
    body = F.struct("duration", F.lit(1 / resolution).alias("frame_rate"), F.lit(resolution).alias("resolution_s"), F.size("r").alias("n_frames"), F.col("r.score").alias("scores"), F.col("r.t").alias("times"))
    return grouped.select("recording_id", F.to_json(body).alias("document"))
