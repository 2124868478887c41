"""Blocks of frames and two-level scans against the forms over whole recordings."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from rubato.operators import frame_blocks as fb
from rubato.operators import joins, rates, schedules
from rubato.operators import windows as w

RNG = np.random.default_rng(11)


@pytest.fixture(scope="module")
def frames(spark):
    """Recordings of awkward lengths around blocks of 64, one of them most of all rows."""
    rows = []
    for k, n in enumerate((1, 2, 5, 63, 64, 65, 70, 128, 200, 3000)):
        t = np.cumsum(RNG.random(n)) if k % 3 else np.arange(n) / 50
        rows += [(k, i, float(t[i]), float(v), float(s)) for i, (v, s) in enumerate(zip(RNG.normal(size=n) * 5, RNG.random(n), strict=True))]
    return spark.createDataFrame(rows, "recording_id long, frame_idx int, t double, value double, score double").repartition(4).cache()


def table(df, *columns: str) -> dict:
    return {(r["recording_id"], r["frame_idx"]): [r[c] for c in columns] for r in df.collect()}


def same(found: dict, want: dict, rel: float = 1e-9) -> bool:
    numbers = lambda rows: np.array([[np.nan if v is None else v for v in rows[k]] for k in sorted(want)], float)
    return found.keys() == want.keys() and np.allclose(numbers(found), numbers(want), rtol=rel, atol=1e-12, equal_nan=True)


def test_scans_equal_windows(frames):
    own = w.ordered().rowsBetween(Window.unboundedPreceding, 0)
    some = F.when(F.col("frame_idx") % 5 == 3, F.col("value"))
    want = frames.withColumn("s", F.sum("value").over(own)).withColumn("m", F.min("value").over(own)).withColumn("h", F.max("value").over(own)).withColumn("l", F.last(some, ignorenulls=True).over(own))
    scans = {"s": fb.Scan("sum", F.col("value")), "m": fb.Scan("min", F.col("value")), "h": fb.Scan("max", F.col("value")), "l": fb.Scan("last", some)}
    found, whole = table(fb.scanned(frames, scans, 64), "s", "m", "h", "l"), table(want, "s", "m", "h", "l")
    assert same(found, whole)


def test_slew_limit_and_near_windows_equal_the_whole(frames):
    assert same(table(fb.slew_limited(frames, "value", block=64), "limited"), table(frames.withColumn("limited", w.slew_limited(F.col("value"))), "limited"))
    columns = {"highest": lambda o: F.max("value").over(o.rowsBetween(-3, 3)), "step": lambda o: F.col("t") - F.coalesce(F.lag("t").over(o), F.lit(0.0))}
    want = frames.withColumn("highest", w.max_filter(F.col("value"))).withColumn("step", w.step_in(F.col("t")))
    assert table(fb.near_windows(frames, 3, columns, 64), "highest", "step") == table(want, "highest", "step")


def test_numbers_equal_row_number(spark):
    rows = [(k % 4 if k % 3 else 0, float(v), k) for k, v in enumerate(RNG.integers(0, 40, 500))]
    df = spark.createDataFrame(rows, "key int, at double, id int")
    found = {(r["id"]): r["frame_idx"] for r in fb.numbered(df, "key", ["at", "id"], F.floor(F.col("at") / 5)).collect()}
    for key in range(4):
        own = sorted((a, i) for k, a, i in rows if k == key)
        assert [found[i] for _, i in own] == list(range(len(own)))


@pytest.mark.parametrize("width", [0.5, 7.0, 1e9])
def test_interpolation_equals_the_window_form(frames, spark, width):
    queries = spark.createDataFrame([(k, i, float(q)) for k in range(11) for i, q in enumerate(RNG.random(40) * 30 - 3)], "recording_id long, frame_idx int, t double")
    ties = frames.unionByName(frames.where("frame_idx % 7 = 1").withColumn("value", F.col("value") + 1)).where("recording_id <> 4")
    found, want = table(fb.interpolated(ties, queries, width), "value"), table(joins.interpolate_at(ties, queries), "value")
    assert same(found, want)


@pytest.mark.parametrize("options", [{}, {"gamma": 1.0}, {"sigma": 0.0}, {"speed": 8.0, "rise": 0.05}])
def test_long_schedules_equal_whole_ones(frames, options):
    speed = options.pop("speed", 3.0) if options else 3.0
    still = frames.withColumn("t", F.when(F.col("recording_id") == 2, F.lit(0.0)).otherwise(F.col("t")))
    found = table(schedules.schedule_long(still, speed, block=128, **options), "t", "rate")
    want = table(rates.schedule_rates(still, speed, **options), "t", "rate")
    assert same(found, want, 1e-6)


def test_equal_frames_meet_the_duration(spark):
    """All of a recording in one bucket, and bounds that go through it."""
    rows = [(1, i, i / 50, 0.4) for i in range(5000)] + [(2, i, i / 50, float(i % 2)) for i in range(5000)]
    df = spark.createDataFrame(rows, "recording_id long, frame_idx int, t double, score double")
    for speed in (1.5, 9.0):
        found, want = table(schedules.schedule_long(df, speed, block=512), "rate"), table(rates.schedule_rates(df, speed), "rate")
        assert same(found, want, 1e-6)


def test_a_long_recording_is_spread(spark):
    """No task has more than a few blocks of the one recording, and the rates are those of the whole."""
    n = 400_000
    rows = spark.range(n).select(F.lit(7).alias("recording_id"), F.col("id").cast("int").alias("frame_idx"), (F.col("id") / 50).alias("t"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("score"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        base = fb.blocks_of_frames(rows, ["t", "score"], 68, 68)
        sizes = base.groupBy(F.spark_partition_id()).agg(F.sum("n").alias("n")).collect()
        assert len(sizes) > 25 and max(r["n"] for r in sizes) < n / 5
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    local = rows.orderBy("frame_idx").toPandas()
    want = rates.rate_schedule(local["score"].to_numpy(), local["t"].to_numpy(), 3.0)
    found = schedules.schedule_long(rows, 3.0).orderBy("frame_idx").toPandas()["rate"].to_numpy()
    assert np.allclose(found, want, rtol=1e-6)
