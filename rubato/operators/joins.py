"""Join-shaped operators: interpolation, interval fill, lookups, pairing.

Joins by time become equi-joins on grid indices or one ordered window over the
union of both sides; there is no nested-loop join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import CLASS_FLOORS, class_floor, grid_time, label_class


def interpolate_at(knots: DataFrame, queries: DataFrame, value: str = "value") -> DataFrame:
    """As-of join with linear interpolation, clamped at both ends.

    ``knots`` has recording_id, t and ``value``; ``queries`` recording_id,
    frame_idx and t.  Adds ``value``, null where a recording has no knots.
    Of knots at one time the last in order of value counts.
    """
    k = knots.select("recording_id", "t", F.col(value).cast("double").alias("k"), F.lit(None).cast("int").alias("frame_idx"), F.lit(0).alias("side"))
    q = queries.select("recording_id", "t", F.lit(None).cast("double").alias("k"), F.col("frame_idx").cast("int").alias("frame_idx"), F.lit(1).alias("side"))
    both = k.unionByName(q)
    # growing frames from either end, so that each is linear in the rows; a frame that shrinks is computed anew for every row
    columns = [F.col(c) for c in ("t", "side", "k", "frame_idx")]
    forwards = Window.partitionBy("recording_id").orderBy(*[c.asc() for c in columns])
    backwards = Window.partitionBy("recording_id").orderBy(*[c.desc() for c in columns])
    knot = F.when(F.col("side") == 0, F.struct("t", "k"))
    before = F.last(knot, ignorenulls=True).over(forwards.rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(knot, ignorenulls=True).over(backwards.rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("b", before).withColumn("a", after).where("side = 1")
    b, a = F.col("b"), F.col("a")
    blend = b["k"] + (a["k"] - b["k"]) * ((F.col("t") - b["t"]) / (a["t"] - b["t"]))
    return found.select(
        "recording_id", "frame_idx", "t",
        F.when(b.isNull(), a["k"]).when(a.isNull() | (a["t"] <= b["t"]), b["k"]).otherwise(blend).alias(value),
    )


def time_grid(durations: DataFrame, n: Column) -> DataFrame:
    """Grid points of every recording, both ends included, from (recording_id, duration)."""
    sized = durations.withColumn("n", n.cast("int"))
    points = sized.select("recording_id", "duration", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("frame_idx"))
    return points.select("recording_id", "frame_idx", grid_time(F.col("frame_idx"), F.col("n"), F.col("duration")).alias("t"))


def resample_importance(scores: DataFrame, resolution: float) -> DataFrame:
    """Scores on a grid of ``max(1, int(duration / resolution))`` points."""
    durations = scores.groupBy("recording_id").agg(F.max("t").alias("duration"))
    grid = time_grid(durations, F.greatest(F.lit(1), F.floor(F.col("duration") / resolution)))
    return interpolate_at(scores, grid)


def index_interpolate(frames: DataFrame, sources: DataFrame, vector: str = "mel", extrapolate: bool = False) -> DataFrame:
    """Vectors at fractional frame indices.

    ``sources`` has recording_id, frame_idx and src; the two equi-joins fetch
    the frames at floor(src) and the one after (the last frame at the end).  A
    source before the first frame or after the last has no vector, or with
    ``extrapolate`` one on the line through the two frames nearest to it.
    """
    low = F.floor("src").cast("int")
    if extrapolate:
        sizes = frames.groupBy("recording_id").agg(F.max("frame_idx").alias("_last"))
        sources = sources.join(sizes, "recording_id")
        low = F.greatest(F.lit(0), F.least(low, F.col("_last") - 1)).cast("int")
    own = frames.select("recording_id", F.col("frame_idx").alias("_i"), F.col(vector).alias("_x"))
    want = sources.withColumn("_low", low).withColumn("_part", F.col("src") - low)
    got = want.join(own.withColumnRenamed("_i", "_low").withColumnRenamed("_x", "_a"), ["recording_id", "_low"])
    after = own.select("recording_id", (F.col("_i") - 1).alias("_low"), F.col("_x").alias("_b"))
    met = got.join(after, ["recording_id", "_low"], "left")
    blend = F.zip_with("_a", F.coalesce("_b", "_a"), lambda a, b: a + (b - a) * F.col("_part"))
    return met.select("recording_id", "frame_idx", "src", blend.alias(vector))


def interval_floors(segments: DataFrame, durations: DataFrame, frame_rate: float = 50.0) -> DataFrame:
    """Floor per frame from (recording_id, seq, label, start, end); a later segment overwrites.

    Segments are exploded to their frames, so the range join is an equi-join.
    Frames without a segment have the floor of silence.
    """
    n = F.greatest(F.lit(1), F.floor(F.col("duration") * frame_rate)).cast("int")
    grid = durations.select("recording_id", n.alias("n"))
    frames = grid.select("recording_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("frame_idx"))
    lo, hi = F.floor(F.col("start") * frame_rate).cast("int"), F.least(F.floor(F.col("end") * frame_rate).cast("int"), F.col("n"))
    spans = segments.join(grid, "recording_id").select("recording_id", "seq", "label", lo.alias("lo"), hi.alias("hi")).where("hi > lo")
    hits = spans.select("recording_id", "seq", "label", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("frame_idx"))
    won = hits.groupBy("recording_id", "frame_idx").agg(F.max_by("label", "seq").alias("label"))
    return frames.join(won, ["recording_id", "frame_idx"], "left").select(
        "recording_id", "frame_idx", "label",
        F.when(F.col("label").isNull(), F.lit(CLASS_FLOORS["silence"])).otherwise(class_floor(label_class(F.col("label")))).alias("floor"),
    )


def first_matches(left: DataFrame, right: DataFrame, parts: int = 3) -> DataFrame:
    """Pairs of stems that agree in their first ``parts`` underscore parts; the first right one."""
    key = F.array_join(F.slice(F.split("stem", "_"), 1, parts), "_").alias("key")
    first = right.select(key, F.col("stem").alias("right_stem")).groupBy("key").agg(F.min("right_stem").alias("right_stem"))
    return left.select(key, F.col("stem").alias("left_stem")).join(first, "key")


def config_grid(*axes: DataFrame) -> DataFrame:
    """All combinations of a few settings; each axis is a small literal table."""
    out = axes[0]
    for axis in axes[1:]:
        out = out.crossJoin(F.broadcast(axis))
    return out
