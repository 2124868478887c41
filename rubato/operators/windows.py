"""Operators over ordered frames: (recording_id, frame_idx, t, value).

All windows share ``partitionBy(recording_id).orderBy(frame_idx)``, so a chain
of these operators shuffles and sorts once.  One recording is one partition of
such a window; ``frame_blocks`` has the forms that spread it over many tasks,
and takes the functions here that have ``own``, the window of a block.  Two
rows of one frame_idx come in any order; a null value is no frame's neighbour's
value, so what is computed from it is null unless stated otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.kernels import gaussian_weights


def ordered() -> WindowSpec:
    return Window.partitionBy("recording_id").orderBy("frame_idx")


def whole() -> WindowSpec:
    return Window.partitionBy("recording_id")


def frames_from_events(events: DataFrame) -> DataFrame:
    """A recording per user: frames by time, seconds from the first, the value as signal."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.min(F.unix_micros(F.col("ts").cast("timestamp"))).over(Window.partitionBy("user_id"))) / 1e6
    return events.select(
        F.col("user_id").alias("recording_id"), (F.row_number().over(w) - 1).alias("frame_idx"), seconds.alias("t"), "value", "event_type"
    )


def normalised(x: Column) -> Column:
    """Scaled to [0, 1] over the recording; a constant one becomes 0."""
    low, high = F.min(x).over(whole()), F.max(x).over(whole())
    return F.when(high > low, (x - low) / (high - low)).otherwise(F.lit(0.0))


def peak_normalised(x: Column) -> Column:
    high = F.max(x).over(whole())
    return F.when(high > 0, x / high).otherwise(x)


def step_in(t: Column, own: WindowSpec | None = None) -> Column:
    """Seconds since the previous frame; the first frame's own time."""
    return t - F.coalesce(F.lag(t).over(own or ordered()), F.lit(0.0))


def max_filter(x: Column, width: int = 7, own: WindowSpec | None = None) -> Column:
    """Greatest of ``width`` frames around each, fewer at the ends; nulls don't count."""
    half = width // 2
    return F.max(x).over((own or ordered()).rowsBetween(-half, half))


def slew_limited(x: Column, rise: float = 0.3) -> Column:
    """``y[i] = min(x[i], y[i-1] + rise)`` in closed form."""
    ramp = F.col("frame_idx") * rise
    return F.min(x - ramp).over(ordered().rowsBetween(Window.unboundedPreceding, 0)) + ramp


def running_total(x: Column) -> Column:
    return F.sum(x).over(ordered().rowsBetween(Window.unboundedPreceding, 0))


def gradient(x: Column, own: WindowSpec | None = None) -> Column:
    """Centred differences, one-sided at the ends and next to a null; null for a single frame."""
    before, after = F.lag(x).over(own or ordered()), F.lead(x).over(own or ordered())
    return F.when(before.isNull(), after - x).when(after.isNull(), x - before).otherwise((after - before) / 2)


def running_median(x: Column, width: int = 21, own: WindowSpec | None = None) -> Column:
    """Median of full frames of an odd ``width``, nulls not counted; null at the edges."""
    half = width // 2
    near = F.collect_list(x).over((own or ordered()).rowsBetween(-half, half))
    return F.when(F.size(near) == 2 * half + 1, F.get(F.sort_array(near), F.lit(half)))


def is_click(energy: Column, width: int = 21, threshold: float = 5.0, least: float = 1e-10, floor: float | None = None, own: WindowSpec | None = None) -> Column:
    """Far above a median that is above ``least``, or one that counts as ``floor`` at least; never at the edges."""
    median = running_median(energy, width, own)
    found = (median > least) & (energy > threshold * median) if floor is None else energy > threshold * F.greatest(median, F.when(median.isNotNull(), F.lit(floor)))
    return F.coalesce(found, F.lit(False))


def frame_energy(frames: DataFrame, hop: int) -> DataFrame:
    """Mean square and RMS of every full run of ``hop`` values."""
    block = F.floor(F.col("frame_idx") / hop).cast("int")
    return (
        frames.groupBy("recording_id", block.alias("frame_idx"))
        .agg(F.avg(F.col("value") * F.col("value")).alias("energy"), F.count("value").alias("n"))
        .where(F.col("n") == hop)
        .select("recording_id", "frame_idx", "energy", F.sqrt("energy").alias("rms"))
    )


def to_arrays(frames: DataFrame, *columns: str) -> DataFrame:
    """A row per recording with each column as an array in frame order."""
    rows = F.sort_array(F.collect_list(F.struct("frame_idx", *columns)))
    return frames.groupBy("recording_id").agg(rows.alias("rows")).select("recording_id", *[F.col(f"rows.{c}").alias(c) for c in columns])


def gaussian_smooth(frames: DataFrame, sigma: float) -> DataFrame:
    """(recording_id, frame_idx, smoothed) of ``value``, edges reflected with repeat.

    ``frame_idx`` runs from 0 without gaps.  A row reads its ``radius``
    neighbours on either side; only rows that near an end are reflected, by
    lists of the first and last ``radius`` values.  A recording shorter than
    the radius is reflected again and again, as it is one list.
    """
    weights = gaussian_weights(sigma)
    radius = len(weights) // 2
    if not radius:
        return frames.select("recording_id", "frame_idx", F.col("value").alias("smoothed"))
    own = ordered()
    near = F.collect_list(F.coalesce("value", F.lit(float("nan")))).over(own.rowsBetween(-radius, radius))
    n, i = F.count(F.lit(1)).over(whole()), F.col("frame_idx")
    rows = frames.select("recording_id", "frame_idx", near.alias("near"), n.alias("n"), F.greatest(i - radius, F.lit(0)).alias("first"))
    kernel = F.array(*[F.lit(w) for w in weights])
    blend = lambda values: F.aggregate(F.zip_with(kernel, values, lambda w, v: w * v), F.lit(0.0), lambda s, v: s + v)
    # reflected places of a row by the ends, all within its own neighbours while the recording is longer than the radius
    m = lambda j: F.pmod(j, 2 * F.col("n"))
    place = lambda j: F.when(m(j) < F.col("n"), m(j)).otherwise(2 * F.col("n") - 1 - m(j))
    inside = F.transform(F.sequence(i - radius, i + radius), lambda j: F.get("near", (place(j) - F.col("first")).cast("int")))
    return rows.select("recording_id", "frame_idx", F.when(F.size("near") == 2 * radius + 1, blend(F.col("near"))).otherwise(blend(inside)).alias("smoothed"))


def soft_clip(frames: DataFrame, target_rms: float) -> DataFrame:
    """Tame peaks above 0.8, match the RMS, then hold the peak at 0.99."""
    x = F.col("value")
    peak = F.max(F.abs(x)).over(whole())
    over = F.signum(x) * (0.8 + F.tanh((F.abs(x) - 0.8) / (peak - 0.8 + 1e-10)) * 0.2)
    clipped = frames.withColumn("clipped", F.when((peak > 0.8) & (F.abs(x) > 0.8), over).otherwise(x))
    rms = F.sqrt(F.avg(F.col("clipped") * F.col("clipped")).over(whole()))
    scaled = clipped.withColumn("scaled", F.when((rms > 0) & F.lit(target_rms > 0), F.col("clipped") * (target_rms / rms)).otherwise(F.col("clipped")))
    high = F.max(F.abs("scaled")).over(whole())
    return scaled.withColumn("out", F.when(high > 0.99, F.col("scaled") * (0.99 / high)).otherwise(F.col("scaled"))).select("recording_id", "frame_idx", "out")


def click_counts(energy: DataFrame, width: int = 25, threshold: float = 3.0, seconds_a_frame: float = 0.002) -> DataFrame:
    """Clicks and clicks a second of every recording, from (recording_id, frame_idx, energy)."""
    flagged = energy.withColumn("click", is_click(F.col("energy"), width, threshold, least=0.0))
    counted = flagged.groupBy("recording_id").agg(F.count_if("click").alias("n_clicks"), F.count(F.lit(1)).alias("n_frames"))
    duration = F.col("n_frames") * seconds_a_frame
    return counted.select("recording_id", "n_clicks", F.when(duration < 0.01, 0.0).otherwise(F.col("n_clicks") / duration).alias("clicks_per_second"))


def clicks_per_second(energy: DataFrame, spectral: DataFrame, durations: DataFrame) -> DataFrame:
    """(recording_id, n_clicks, clicks_per_second): the greater of the clicks in ``energy`` and in ``spectral``.

    ``energy`` is as in ``click_counts``, ``spectral`` has recording_id and
    n_clicks, ``durations`` recording_id and duration in seconds.
    """
    loud = click_counts(energy).select("recording_id", F.col("n_clicks").alias("_loud"))
    both = durations.join(loud, "recording_id", "left").join(spectral.select("recording_id", F.col("n_clicks").alias("_spectral")), "recording_id", "left")
    n = F.coalesce(F.greatest("_loud", "_spectral"), F.lit(0)).cast("long")
    return both.select("recording_id", n.alias("n_clicks"), F.when(F.col("duration") < 0.01, 0.0).otherwise(n / F.col("duration")).alias("clicks_per_second"))


def voice_activity(rms: Column) -> Column:
    return (peak_normalised(rms) > 0.05).cast("double")


