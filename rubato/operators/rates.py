"""From importance to a playback-rate schedule.

The schedule's duration is fixed by iterating a whole recording until it meets
the target, so a recording is one group; groups run in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import gaussian_weights
from ..functions.scalars import MAX_RATE, MIN_RATE, grid_time
from .windows import to_arrays


def gaussian(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian filter along the first axis, edges reflected with repeat."""
    weights = np.array(gaussian_weights(sigma))
    n, radius = len(x), len(weights) // 2
    m = np.arange(-radius, n + radius) % (2 * n)
    padded = x[np.where(m < n, m, 2 * n - 1 - m)]
    if x.ndim == 1:
        return np.convolve(padded, weights, "valid")
    return np.stack([np.convolve(padded[:, j], weights, "valid") for j in range(x.shape[1])], axis=1)


def meet_duration(rates: np.ndarray, dt: np.ndarray, goal: float, rounds: int, tolerance: float) -> np.ndarray:
    """Scale and clip until the output duration is near ``goal``."""
    for _ in range(rounds):
        got = (dt / rates).sum()
        if abs(got - goal) / goal < tolerance:
            break
        rates = np.clip(rates * (got / goal), MIN_RATE, MAX_RATE)
    return rates


def rate_schedule(
    scores: np.ndarray, times: np.ndarray, speed: float, sigma: float = 15.0, rise: float = 0.3, gamma: float = 1.5
) -> np.ndarray:
    """Rates of one recording; constant where its times span nothing."""
    n = len(scores)
    if n == 0:
        return np.zeros(0)
    importance = np.clip(scores, 0, 1)
    if sigma > 0 and n > 1:
        importance = np.clip(gaussian(importance, sigma), 0, 1)
    dt = np.diff(times, prepend=0.0)
    if dt.sum() == 0:
        return np.full(n, float(speed))
    goal = times[-1] / speed
    raw = MIN_RATE + (1 - importance) * (MAX_RATE - MIN_RATE)
    rates = np.clip(raw * ((dt / raw).sum() / goal), MIN_RATE, MAX_RATE)
    rates = meet_duration(rates, dt, goal, 20, 1e-3)
    if gamma != 1:
        span = MAX_RATE - MIN_RATE
        rates = np.clip(MIN_RATE + ((rates - MIN_RATE) / span) ** gamma * span, MIN_RATE, MAX_RATE)
        rates = meet_duration(rates, dt, goal, 10, 1e-3)
    ramp = rise * np.arange(n)
    rates = np.minimum.accumulate(rates - ramp) + ramp
    if n > 4:
        rates = np.clip(gaussian(rates, 2.0), MIN_RATE, MAX_RATE)
    return meet_duration(rates, dt, goal, 10, 2e-3)


def check_speed(speed: float) -> None:
    if not speed > 0:
        raise ValueError("the speed has to be above 0")


def uniform_rate_schedule(durations: DataFrame, speed: float, resolution: float = 0.02) -> DataFrame:
    """A constant rate on a grid of ``max(1, int(duration / resolution))`` points, from (recording_id, duration)."""
    check_speed(speed)
    n = F.greatest(F.lit(1), F.floor(F.col("duration") / resolution)).cast("int")
    points = durations.withColumn("_n", n).withColumn("frame_idx", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return points.select("recording_id", "frame_idx", grid_time(F.col("frame_idx"), F.col("_n"), F.col("duration")).alias("t"), F.lit(float(speed)).alias("rate"))


def schedule_rates(scores: DataFrame, speed: float, **options: float) -> DataFrame:
    """(recording_id, frame_idx, t, rate) from (recording_id, frame_idx, t, score)."""

    check_speed(speed)

    from .signal import array_column, array_values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (score, at), (t, _) = (array_values(batch.column(c)) for c in ("score", "t"))
            out = [rate_schedule(score[a:b], t[a:b], speed, **options) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("recording_id", "frame_idx", "t")), array_column(out)], ["recording_id", "frame_idx", "t", "rate"])

    kind = scores.schema["recording_id"].dataType.simpleString()
    rows = scores.select("recording_id", F.col("frame_idx").cast("int"), F.col("t").cast("double"), F.coalesce(F.col("score").cast("double"), F.lit(float("nan"))).alias("score"))
    arrays = to_arrays(rows.withColumn("i", F.col("frame_idx")), "i", "t", "score").withColumnRenamed("i", "frame_idx")
    # dealt out anew, as few bytes of groups that take long would be put into one task
    dealt = arrays.repartition(int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions")), "recording_id")
    done = dealt.mapInArrow(run, f"recording_id {kind}, frame_idx array<int>, t array<double>, rate array<double>")
    return done.select("recording_id", F.explode(F.arrays_zip("frame_idx", "t", "rate")).alias("r")).select("recording_id", "r.*")


def time_map(rates: np.ndarray, times: np.ndarray, n_frames: int, duration: float) -> tuple[np.ndarray, np.ndarray]:
    """(source frame index, stretch ratio) of every output frame of one recording."""
    mel_times = np.linspace(0, duration, n_frames)
    at = np.maximum(np.interp(mel_times, times, rates), 0.5)
    out_times = np.cumsum(np.diff(mel_times, prepend=0.0) / at)
    n_out = max(1, int(out_times[-1] / (duration / n_frames)))
    source = np.interp(np.linspace(0, out_times[-1], n_out), out_times, np.arange(n_frames))
    ratio = np.gradient(source) if n_out > 1 else np.ones(1)
    return source, np.maximum(ratio, 0.1)


#: Ratios that differ by no more than this share are rounding, not a change of pace.
EQUAL_RATIOS = 1e-9


def adaptive_smooth(mel: np.ndarray, ratios: np.ndarray, low: float = 0.3, high: float = 2.5, buckets: int = 4, fade: int = 4) -> np.ndarray:
    """Smooth (frames, bins) over time, more where the ratio is high, with cross-faded changes."""
    n = len(mel)
    low = min(low, high)
    if n < 2 or high <= 0:
        return mel.copy()
    least, most = ratios.min(), ratios.max()
    if most - least <= EQUAL_RATIOS * most:
        return gaussian(mel, max(low, 0.01))
    levels = np.linspace(low, high, buckets)
    sigma = low + (ratios - least) / (most - least) * (high - low)
    chosen = np.abs(sigma[:, None] - levels).argmin(axis=1)
    layers = np.stack([gaussian(mel, max(s, 0.01)) for s in levels])
    out = layers[chosen, np.arange(n)]
    if n > 2 * fade:
        for c in np.flatnonzero(np.diff(chosen)):
            a, b = max(0, c + 1 - fade // 2), min(n, c + 1 + fade // 2)
            f = np.linspace(0, 1, b - a)[:, None]
            out[a:b] = layers[chosen[c], a:b] * (1 - f) + layers[chosen[c + 1], a:b] * f
    return out


def stretch_frames(mel: DataFrame, rates: DataFrame, durations: DataFrame) -> DataFrame:
    """Time-stretched, smoothed frames: (recording_id, frame_idx, src, ratio, mel).

    ``mel`` has recording_id, frame_idx, mel; ``rates`` recording_id, t, rate;
    ``durations`` recording_id, duration.  A recording is one group, to be cut
    into chunks beforehand where it is too long for one task.
    """
    kind = mel.schema["recording_id"].dataType.simpleString()

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["recording_id", "frame_idx", "src", "ratio", "mel"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in columns})
        left, right = left.sort_values("frame_idx"), right.sort_values("t")
        frames = np.array(left["mel"].tolist(), float)
        source, ratio = time_map(right["rate"].to_numpy(), right["t"].to_numpy(), len(frames), float(left["duration"].iloc[0]))
        smooth = gaussian(frames, 2.0)
        a = np.minimum(source.astype(int), len(frames) - 1)
        b = np.minimum(a + 1, len(frames) - 1)
        moved = smooth[a] + (smooth[b] - smooth[a]) * (source - a)[:, None]
        moved = adaptive_smooth(moved, ratio)
        return pd.DataFrame({"recording_id": key[0], "frame_idx": np.arange(len(source)), "src": source, "ratio": ratio, "mel": list(moved)})[columns]

    return (
        mel.join(durations, "recording_id")
        .groupBy("recording_id")
        .cogroup(rates.groupBy("recording_id"))
        .applyInPandas(run, f"recording_id {kind}, frame_idx int, src double, ratio double, mel array<double>")
    )
