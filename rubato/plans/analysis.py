"""Whole analyses put together from operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import grid_time
from ..operators import chunks, signal, signal_blocks
from ..operators.importance import codec_importance, mel_importance
from ..operators.joins import interpolate_at, resample_importance
from ..operators.rates import check_speed
from ..operators.schedules import schedule_long
from ..operators.signal import SAMPLE_RATE
from ..operators.windows import frames_from_events, normalised
from ..scratch import written


def scored_events(events: DataFrame) -> DataFrame:
    """Frames of events with their values scaled to scores."""
    return frames_from_events(events).withColumn("score", normalised(F.col("value")))


def held_up(scores: DataFrame, floors: DataFrame) -> DataFrame:
    """``scores`` (recording_id, frame_idx, t, score), no lower than ``floors`` (recording_id, t, floor) between their knots."""
    held = interpolate_at(floors, scores, "floor").select("recording_id", "frame_idx", "floor")
    return scores.join(held, ["recording_id", "frame_idx"], "left").withColumn("score", F.greatest("score", "floor")).drop("floor")


def on_grid(scores: DataFrame, resolution: float) -> DataFrame:
    return resample_importance(scores.withColumnRenamed("score", "value"), resolution).withColumnRenamed("value", "score")


def analyse(mel: DataFrame, duration: float | DataFrame, resolution: float, floors: DataFrame | None = None) -> DataFrame:
    """Mel importance on a grid of ``resolution`` seconds: (recording_id, frame_idx, t, score).

    ``duration`` is that of all recordings, or a table (recording_id,
    duration).  ``floors`` (recording_id, t, floor), if given, are interpolated
    and hold the scores up, before they are put on the grid.
    """
    return on_grid(_scored(mel_importance(mel), duration, floors), resolution)


def _scored(scores: DataFrame, duration: float | DataFrame, floors: DataFrame | None) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy("recording_id"))
    known = scores.withColumn("_d", F.lit(duration)) if isinstance(duration, float) else scores.join(duration.withColumnRenamed("duration", "_d"), "recording_id")
    timed = known.withColumn("t", grid_time(F.col("frame_idx"), n, F.col("_d"))).select("recording_id", "frame_idx", "t", "score")
    return timed if floors is None else held_up(timed, floors)


def analyse_codes(codes: DataFrame, resolution: float, frame_rate: float = 12.5, floors: DataFrame | None = None) -> DataFrame:
    """Codec importance on a grid, from (recording_id, frame_idx, cb, rms) at ``frame_rate``; the end of the last frame's time is left out."""
    scores = codec_importance(codes).withColumn("t", F.col("frame_idx") / frame_rate).select("recording_id", "frame_idx", "t", "score")
    return on_grid(scores if floors is None else held_up(scores, floors), resolution)


def accelerate(
    blocks: DataFrame, speed: float, block: int, sample_rate: int = SAMPLE_RATE, step=chunks.play_at_rates, noise: str | None = "gate", resolution: float = 0.02, uniform: bool = False,
    prosody: bool = True, gamma: float = 1.5, floors: DataFrame | None = None, tilt_fft: int = 2048, chunk_seconds: float = 300.0, overlap_seconds: float = 1.0, declick: bool = True, with_room: bool = True, dither: bool = True,
) -> DataFrame:
    """Recordings played ``speed`` times as fast, less where they matter: blocks in, blocks out.

    Noise is taken off; the mel spectra's importance, held up by ``floors`` and
    lowered by the loudness contour, becomes rates that meet the duration;
    chunks are played at them by ``step`` (samples, times, rates, sample rate),
    and put together; the mean spectrum is brought back to the clean one's, the
    loudness to the input's; then the finish.  With ``uniform`` the rate is
    constant and nothing is analysed.  Recordings of one block go apart from
    longer ones, whose blocks meet their neighbours in shuffles.
    """
    check_speed(speed)
    signal_blocks.check_method(noise)
    least = min(block, int(chunk_seconds * sample_rate))
    alone = (F.col("block_idx") == 0) & F.coalesce(F.size("samples") < least, F.lit(False))
    short, long = blocks.where(alone), blocks.where(~alone)

    def rates_of(clean: DataFrame, one_block: bool) -> DataFrame:
        durations = clean.groupBy("recording_id").agg((F.sum(F.size("samples")) / sample_rate).alias("duration"))
        scores = analyse(signal_blocks.mel_frames(clean, block, sample_rate, alone=one_block), durations, resolution, floors)
        if prosody:
            scores = signal_blocks.prosodic_modulation(scores, signal_blocks.prosodic_envelope(clean, block, sample_rate))
        return schedule_long(written(scores, "scores"), speed, gamma=gamma).select("recording_id", "t", "rate")

    done = _accelerated_alone(short, speed, block, sample_rate, step, noise, None if uniform else rates_of, tilt_fft, least, declick, with_room, dither)
    if long.isEmpty():
        return done
    rms = F.sqrt(F.sum(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v * v)) / F.sum(F.size("samples")))
    targets = long.groupBy("recording_id").agg(rms.alias("target"))
    clean = written(signal_blocks.denoise(long, block, noise), "clean")
    rates = None if uniform else rates_of(clean, False)
    played = chunks.process_chunked(clean, speed, sample_rate, block, lambda x, t, r: step(x, t, r, sample_rate), chunk_seconds, overlap_seconds, rates)
    even = written(chunks.even_blocks(played, block), "played")
    tilted = written(signal_blocks.match_tilt(clean, even, block, tilt_fft), "tilted")
    finished = signal_blocks.post_process(signal_blocks.soft_clip(tilted, targets), block, sample_rate, declick, with_room, dither)
    return done.unionByName(finished)


def _accelerated_alone(blocks: DataFrame, speed: float, block: int, sample_rate: int, step, noise: str | None, rates_of, tilt_fft: int, chunk: int, declick: bool, with_room: bool, dither: bool) -> DataFrame:
    """``accelerate`` of recordings that are one block and one chunk each, which need no halo.

    Their samples go through one shuffle, to their rates; spectra, peaks and
    sums of a recording are those of its block and go nowhere.
    """
    whole = lambda rows, f, out, keep=(): chunks.over_blocks(rows, 0, 0, lambda x, a, z, start, *kept: f(x, *kept), out, keep)
    clean = written(whole(blocks.where(F.size("samples") > 0), lambda x: (signal.denoise(x, noise), np.sqrt((x * x).mean())), "samples array<double>, target double"), "clean")
    if rates_of is None:
        constant = F.array(F.lit(float(speed)), F.lit(float(speed)))
        known = clean.select("*", F.array(F.lit(0.0), F.size("samples") / sample_rate).alias("times"), constant.alias("rates"))
    else:
        plan = chunks.plan_chunks(clean.select("recording_id", F.size("samples").cast("long").alias("n_samples")), chunk, 0)
        points = chunks.rates_in_chunks(plan, rates_of(clean, True), sample_rate, chunk).groupBy("recording_id").agg(F.sort_array(F.collect_list(F.struct("t", "rate"))).alias("c"))
        known = clean.join(points, "recording_id", "left").select(*clean.columns, F.col("c.t").alias("times"), F.col("c.rate").alias("rates"))

    def played(x: np.ndarray, times: list | None, rates: list | None, target: float) -> tuple[np.ndarray, float]:
        out = np.asarray(step(x, np.array(times or [], float), np.array(rates or [], float), sample_rate), float)
        return (signal.match_tilt(x, out, tilt_fft) if len(out) else out), target

    def finished(x: np.ndarray, target: float) -> tuple[np.ndarray]:
        return (signal.post_process(signal.soft_clip(x, target), sample_rate, declick, with_room, dither),)

    tilted = whole(known, played, "samples array<double>, target double", ("times", "rates", "target"))
    done = whole(tilted.where(F.size("samples") > 0), finished, "samples array<double>", ("target",))
    # a step may have made more of a recording than a block holds
    cut = done.select("recording_id", "samples", F.explode(F.sequence(F.lit(0), F.floor((F.size("samples") - 1) / block).cast("int"))).alias("block_idx"))
    start = F.col("block_idx").cast("long") * block
    return cut.select("recording_id", "block_idx", start.alias("start_sample"), F.slice("samples", (start + 1).cast("int"), F.lit(block)).alias("samples"))
