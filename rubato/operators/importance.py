"""Importance scores of frames: spectral, codec and phoneme class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import LABELS, class_floor, clip, grid_time, label_class, total
from .windows import max_filter, normalised, ordered, peak_normalised, voice_activity, whole


def spectral_flux(mel: Column, hf_boost: float = 2.5) -> Column:
    """Distance to the previous frame, the upper half of the bins weighing ``hf_boost`` times."""
    weighted = F.transform(mel, lambda v, i: F.when(i >= F.floor(F.size(mel) / 2), v * hf_boost).otherwise(v * 1.0))
    before = F.lag(weighted).over(ordered())
    square = F.zip_with(weighted, before, lambda a, b: (a - b) * (a - b))
    return F.when(before.isNull(), F.lit(0.0)).otherwise(F.sqrt(total(square)))


def mel_importance(
    mel: DataFrame, flux_weight: float = 0.50, energy_weight: float = 0.25, hf_weight: float = 0.15, silence_weight: float = 0.10,
    hf_boost: float = 2.5, peak_spread: int = 7, hf_start: float = 0.6, silence_threshold: float = 0.05, closure_threshold: float = 0.3,
) -> DataFrame:
    """Scores in [0, 1] from (recording_id, frame_idx, mel).

    ``peak_spread`` is the odd width of the flux's max filter, ``hf_start`` the
    share of the bins below the high ones; quieter frames than
    ``silence_threshold`` are protected near a flux above ``closure_threshold``.
    """
    m = F.transform("mel", lambda v: v.cast("double"))
    rows = mel.withColumn("mel", m).withColumn("flux", spectral_flux(F.col("mel"), hf_boost))
    start = (F.floor(F.size("mel") * hf_start) + 1).cast("int")
    rows = rows.withColumn("flux", peak_normalised(F.col("flux"))).withColumn("energy", total(F.col("mel")))
    rows = rows.withColumn("hf", total(F.slice("mel", start, F.size("mel")))).drop("mel")
    rows = rows.withColumn("flux", max_filter(F.col("flux"), peak_spread)).withColumn("energy", normalised(F.col("energy"))).withColumn("hf", normalised(F.col("hf")))
    protected = ((F.col("energy") < silence_threshold) & (max_filter(F.col("flux"), peak_spread) > closure_threshold)).cast("double")
    rows = rows.withColumn("protected", protected)
    blend = flux_weight * F.col("flux") + energy_weight * F.col("energy") + hf_weight * F.col("hf") + silence_weight * F.col("protected")
    rows = rows.withColumn("score", blend)
    low, high = F.min("score").over(whole()), F.max("score").over(whole())
    scaled = F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.col("score"))
    return rows.select("recording_id", "frame_idx", clip(scaled).alias("score"))


def codec_importance(codes: DataFrame) -> DataFrame:
    """Scores from (recording_id, frame_idx, cb, rms): code changes and voice activity."""
    before = F.lag("cb").over(ordered())
    changed = F.zip_with("cb", before, lambda a, b: (a != b).cast("double"))
    first = before.isNull()
    rows = codes.select(
        "recording_id", "frame_idx",
        F.when(first, 0.0).otherwise((F.get("cb", F.lit(0)) != F.get(before, F.lit(0))).cast("double")).alias("transition"),
        F.when(first, 0.0).otherwise(total(changed) / F.size("cb")).alias("share"),
        voice_activity(F.col("rms")).alias("voice"),
    )
    blend = 0.45 * F.col("transition") + 0.15 * F.col("voice") + 0.40 * F.col("share")
    rows = rows.withColumn("score", blend)
    low, high = F.min("score").over(whole()), F.max("score").over(whole())
    return rows.select("recording_id", "frame_idx", clip(F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.col("score"))).alias("score"))


def frame_class(log_probs: Column, blank_threshold: float = 0.8) -> Column:
    """Class of the likeliest label, or silence where blank is likely enough."""
    rest = F.slice(log_probs, 2, len(LABELS) - 1)
    label = F.get(F.array(*[F.lit(x) for x in LABELS[1:]]), (F.array_position(rest, F.array_max(rest)) - 1).cast("int"))
    return F.when(F.exp(F.get(log_probs, F.lit(0))) > blank_threshold, F.lit("silence")).otherwise(label_class(label))


def phoneme_floors(emissions: DataFrame, durations: DataFrame, blank_threshold: float = 0.8) -> DataFrame:
    """Floor per frame from (recording_id, frame_idx, log_probs) on the recording's grid."""
    n = F.count(F.lit(1)).over(whole())
    found = emissions.withColumn("n", n).join(durations, "recording_id")
    cls = frame_class(F.col("log_probs"), blank_threshold)
    return found.select(
        "recording_id", "frame_idx", grid_time(F.col("frame_idx"), F.col("n"), F.col("duration")).alias("t"), cls.alias("class"), class_floor(cls).alias("floor")
    )


def hf_deemphasis(mel: DataFrame, max_rolloff_db: float = 5.0, base_rolloff_db: float = 1.0, start_share: float = 0.4) -> DataFrame:
    """Roll off high bins, more where the ratio is high; (recording_id, frame_idx, mel, ratio).

    The decibels are taken off the natural-log mel as they are; that defines
    the result.  Recordings of one frame stay as they are.
    """
    low, high, n = F.min("ratio").over(whole()), F.max("ratio").over(whole()), F.count(F.lit(1)).over(whole())
    rows = mel.withColumn("_n", n).withColumn("_k", F.when(high > low + 0.1, (F.col("ratio") - low) / (high - low)).otherwise(F.lit(0.0)))
    bins = F.size("mel")
    start = F.floor(bins * start_share).cast("int")

    def lower(v: Column, i: Column) -> Column:
        p = F.pow(F.when(bins - start > 1, (i - start) / (bins - start - 1)).otherwise(F.lit(0.0)), F.lit(1.5))
        return F.when(i >= start, v - base_rolloff_db * p - max_rolloff_db * p * F.col("_k")).otherwise(v * 1.0)

    return rows.select("recording_id", "frame_idx", F.when(F.col("_n") < 2, F.col("mel")).otherwise(F.transform("mel", lower)).alias("mel"))
