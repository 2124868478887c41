"""Time-stretched frames of recordings of any length.

Output time runs through a recording as a sum of steps over rates; where it is
on an even grid, its inverse tells which frame to read.  The sums are two-level
scans, the inverse is an as-of join by buckets of time, frames are fetched by
their index, and the smoothing that follows works on blocks with lent frames.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import grid_time
from ..scratch import written
from . import windows as w
from .frame_blocks import BLOCK_FRAMES, Block, Scan, blocks_of_frames, interpolated, map_frame_blocks, near_windows, scanned
from .joins import index_interpolate
from .rates import EQUAL_RATIOS

#: Least playback rate, and least ratio of the time map.
LEAST_RATE, LEAST_RATIO = 0.5, 0.1


def source_frames(mel: DataFrame, rates: DataFrame, durations: DataFrame, width: float = 60.0, block: int = BLOCK_FRAMES) -> DataFrame:
    """(recording_id, frame_idx, src, ratio): which frame each output frame reads, and by how much that goes on.

    ``mel`` has recording_id and frame_idx, from 0 without gaps; ``rates``
    recording_id, t and rate; ``durations`` recording_id and duration.
    """
    sized = mel.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n")).join(durations, "recording_id")
    grid = mel.select("recording_id", "frame_idx").join(sized, "recording_id").select("recording_id", "frame_idx", grid_time(F.col("frame_idx"), F.col("n"), F.col("duration")).alias("t"))
    at = written(interpolated(rates, grid, width, "rate").where("rate is not null"), "stretch-rates")
    steps = near_windows(at, 1, {"step": lambda o: w.step_in(F.col("t"), own=o) / F.greatest(F.col("rate"), F.lit(LEAST_RATE))}, block)
    played = scanned(steps, {"out": Scan("sum", F.col("step"))}, block)
    played = written(played.select("recording_id", "frame_idx", F.col("out").alias("t"), F.col("frame_idx").cast("double").alias("value")), "stretch-played")
    ends = played.groupBy("recording_id").agg(F.max("t").alias("end")).join(sized, "recording_id")
    n_out = F.greatest(F.lit(1), F.floor(F.col("end") / (F.col("duration") / F.col("n")))).cast("int")
    wanted = ends.withColumn("m", F.coalesce(n_out, F.lit(1))).withColumn("frame_idx", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    wanted = wanted.select("recording_id", "frame_idx", grid_time(F.col("frame_idx"), F.col("m"), F.col("end")).alias("t"))
    # where output time stands still, the last frame of that time counts, as for knots at one time
    src = written(interpolated(played, wanted, width).select("recording_id", "frame_idx", F.col("value").alias("src")), "stretch-places")
    slope = near_windows(src, 1, {"ratio": lambda o: w.gradient(F.col("src"), own=o)}, block)
    return slope.withColumn("ratio", F.greatest(F.coalesce("ratio", F.lit(1.0)), F.lit(LEAST_RATIO)))


def smoothed_frames(mel: DataFrame, sigma: float, block: int = BLOCK_FRAMES) -> DataFrame:
    """(recording_id, frame_idx, mel) after a Gaussian filter over time, ends reflected with repeat."""
    reach = int(4 * sigma + 0.5)

    def step(b: Block, _: dict) -> dict[str, np.ndarray]:
        x = rows_of(b)
        smooth, at = b.smoothed(x, sigma)
        return {"mel": smooth[b.own.start - at : b.own.stop - at].ravel()}

    return as_frames(map_frame_blocks(blocks_of_frames(mel, ["mel"], reach, reach, block), ["mel"], reach, block, step, "mel"), mel, block)


def mirrored_frames(mel: DataFrame, sigma: float, block: int = BLOCK_FRAMES) -> DataFrame:
    """(recording_id, frame_idx, mel) as of ``signal.smoothed_frames``: a Gaussian of the odd width at or after 6 sigma, ends reflected without repeat."""
    half = (int(6 * sigma + 1) | 1) // 2
    if sigma <= 0 or not half:
        return mel.select("recording_id", "frame_idx", "mel")
    weights = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    weights /= weights.sum()

    def step(b: Block, _: dict) -> dict[str, np.ndarray]:
        x, n = rows_of(b), b.held
        if b.at_start and b.at_end:
            if n < 2:
                return {"mel": x.ravel()}
            at = np.abs(np.arange(-half, n + half)) % (2 * (n - 1))
            padded, lo = x[np.minimum(at, 2 * (n - 1) - at)], 0
        else:
            padded = np.concatenate([x[half:0:-1] if b.at_start else x[:0], x, x[-2 : -half - 2 : -1] if b.at_end else x[:0]])
            lo = 0 if b.at_start else half
        smooth = np.tensordot(np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1, axis=0), weights, ([-1], [0]))
        return {"mel": smooth[b.own.start - lo : b.own.stop - lo].ravel()}

    # one frame more is lent, as a reflection leaves out the last
    return as_frames(map_frame_blocks(blocks_of_frames(mel, ["mel"], half + 1, half + 1, block), ["mel"], half + 1, block, step, "mel"), mel, block)


def resample_roundtrip(mel: DataFrame, rate: float, sigma: float = 0.0, block: int = BLOCK_FRAMES) -> DataFrame:
    """(recording_id, frame_idx, mel): smoothed, then down to ``round(n / rate)`` frames and back up, linearly."""
    sizes = mel.groupBy("recording_id").agg(F.count(F.lit(1)).cast("int").alias("n")).withColumn("short", F.greatest(F.lit(1), F.rint(F.col("n") / rate)).cast("int"))

    def grid(have: str, want: str) -> DataFrame:
        i = sizes.withColumn("frame_idx", F.explode(F.sequence(F.lit(0), F.col(want) - 1)))
        src = F.when(F.col(want) > 1, F.col("frame_idx") * (F.col(have) - 1) / (F.col(want) - 1)).otherwise(F.lit(0.0))
        return i.select("recording_id", "frame_idx", src.alias("src"))

    down = index_interpolate(mirrored_frames(mel, sigma, block), grid("n", "short")).drop("src")
    return index_interpolate(written(down, "roundtrip"), grid("short", "n")).drop("src")


def rows_of(b: Block) -> np.ndarray:
    return b.columns["mel"].reshape(b.held, -1)


def as_frames(blocks: DataFrame, mel: DataFrame, block: int) -> DataFrame:
    """Frames (recording_id, frame_idx, mel) of blocks whose ``mel`` holds one frame's values after another's."""
    bins = mel.groupBy("recording_id").agg(F.max(F.size("mel")).alias("_bins"))
    met = blocks.join(bins, "recording_id").withColumn("i", F.explode(F.sequence(F.lit(0), (F.size("mel") / F.col("_bins")).cast("int") - 1)))
    return met.select("recording_id", (F.col("block_idx") * block + F.col("i")).cast("int").alias("frame_idx"), F.slice("mel", F.col("i") * F.col("_bins") + 1, F.col("_bins")).alias("mel"))


def adaptive_smooth(frames: DataFrame, low: float = 0.3, high: float = 2.5, buckets: int = 4, fade: int = 4, block: int = BLOCK_FRAMES) -> DataFrame:
    """``frames`` (recording_id, frame_idx, ratio, mel), smoothed over time, more where the ratio is high.

    As ``rates.adaptive_smooth``: of ``buckets`` layers each frame takes the one
    nearest to what its ratio asks for; ``fade`` frames around a change are
    cross-faded, and a later change overwrites an earlier one's.
    """
    low = min(low, high)
    if high <= 0:
        return frames.select("recording_id", "frame_idx", "mel")
    levels = np.linspace(low, high, buckets)
    reach = int(4 * max(high, 0.01) + 0.5) + fade
    ranges = frames.groupBy("recording_id").agg(F.min("ratio").alias("least"), F.max("ratio").alias("most"), F.count(F.lit(1)).alias("total"))

    def step(b: Block, known: dict) -> dict[str, np.ndarray]:
        x, ratio = rows_of(b), b.columns["ratio"]
        least, most, n = known["least"], known["most"], known["total"]
        lo, hi = b.own.start, b.own.stop
        if n < 2:
            return {"mel": x[lo:hi].ravel()}
        if most - least <= EQUAL_RATIOS * most:
            smooth, at = b.smoothed(x, max(low, 0.01))
            return {"mel": smooth[lo - at : hi - at].ravel()}
        sigma = low + (ratio - least) / (most - least) * (high - low)
        chosen = np.abs(sigma[:, None] - levels).argmin(axis=1)
        # all layers for the own frames and those that a fade may read
        layers = []
        for s in levels:
            smooth, at = b.smoothed(x, max(s, 0.01))
            layers.append(smooth[lo - at : hi - at])
        layers = np.stack(layers)
        out = layers[chosen[lo:hi], np.arange(hi - lo)]
        if n > 2 * fade:
            for c in np.flatnonzero(np.diff(chosen)):
                a, z = max(0, b.first + c + 1 - fade // 2) - b.first, min(n, b.first + c + 1 + fade // 2) - b.first
                f = np.linspace(0, 1, z - a)
                for i in range(max(a, lo), min(z, hi)):
                    out[i - lo] = layers[chosen[c], i - lo] * (1 - f[i - a]) + layers[chosen[c + 1], i - lo] * f[i - a]
        return {"mel": out.ravel()}

    columns = ["ratio", "mel"]
    blocks = blocks_of_frames(frames, columns, reach, reach, block).join(ranges, "recording_id")
    return as_frames(map_frame_blocks(blocks, columns, reach, block, step, "mel", ("least", "most", "total")), frames, block)


def stretch_frames(mel: DataFrame, rates: DataFrame, durations: DataFrame, width: float = 60.0, block: int = BLOCK_FRAMES) -> DataFrame:
    """Time-stretched, smoothed frames: (recording_id, frame_idx, src, ratio, mel).

    What ``rates.stretch_frames`` gives, without a recording in one task:
    ``width`` is the width of the buckets of time, in seconds, in which rates
    and frames meet.  A recording without rates or a duration has no frames.
    """
    source = written(source_frames(mel, rates, durations, width, block), "stretch-source")
    moved = index_interpolate(smoothed_frames(mel, 2.0, block), source).join(source.drop("src"), ["recording_id", "frame_idx"])
    smooth = adaptive_smooth(written(moved, "stretch-moved"), block=block)
    return source.join(smooth, ["recording_id", "frame_idx"])
