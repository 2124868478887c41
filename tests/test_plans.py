"""Whole plans against their steps on whole recordings."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from rubato.operators import chunks, importance, rates, signal, signal_blocks
from rubato.operators import windows as w
from rubato.plans import analysis

RNG = np.random.default_rng(41)
BLOCK = 4800


def blocks_of(spark, recordings: dict):
    rows = [(k, i // BLOCK, i, x[i : i + BLOCK].tolist()) for k, x in recordings.items() for i in range(0, len(x), BLOCK)]
    return spark.createDataFrame(rows, "recording_id long, block_idx int, start_sample long, samples array<double>").repartition(3)


def whole(df) -> dict:
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: r.start_sample):
        out.setdefault(r.recording_id, []).append(r.samples)
    return {k: np.concatenate(v) for k, v in out.items()}


def mel_scores(spark, x: np.ndarray) -> np.ndarray:
    mel = signal.extract_mel(x)
    df = spark.createDataFrame([(1, i, m.tolist()) for i, m in enumerate(mel)], "recording_id int, frame_idx int, mel array<double>")
    return importance.mel_importance(df).orderBy("frame_idx").toPandas()["score"].to_numpy()


def test_accelerated_recordings_equal_the_steps(spark):
    recordings = {k: np.sin(np.arange(n) / (9 + k)) * np.repeat(RNG.random(-(-n // 1200)), 1200)[:n] + RNG.normal(size=n) * 0.02 for k, n in enumerate((24_000, 31_003))}
    found = whole(analysis.accelerate(blocks_of(spark, recordings), 2.0, BLOCK, prosody=True))
    for k, x in recordings.items():
        clean, duration = signal.spectral_gate(x), len(x) / 24_000
        scores = mel_scores(spark, clean)
        n = max(1, int(duration / 0.02))
        grid = np.linspace(0, duration, n)
        scores = np.interp(grid, np.linspace(0, duration, len(scores)), scores)
        scores = signal.prosodic_modulation(scores, grid, clean)
        played = chunks.play_at_rates(clean, grid, rates.rate_schedule(scores, grid, 2.0), 24_000)
        tilted = signal.match_tilt(clean, played)
        df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(tilted)], "recording_id int, frame_idx int, value double")
        clipped = w.soft_clip(df, float(np.sqrt((x**2).mean()))).orderBy("frame_idx").toPandas()["out"].to_numpy()
        want = signal.post_process(clipped)
        assert abs(len(found[k]) / len(x) - 0.5) < 0.02 and len(found[k]) == len(want)
        assert np.allclose(found[k], want, atol=1e-6), k


def test_uniform_speed_and_guards(spark):
    recordings = {1: RNG.normal(size=20_000)}
    blocks = blocks_of(spark, recordings)
    found = whole(analysis.accelerate(blocks, 4.0, BLOCK, noise="none", uniform=True, chunk_seconds=0.4, overlap_seconds=0.02, with_room=False, dither=False))
    assert abs(len(found[1]) - 5000) < 30
    with pytest.raises(ValueError):
        analysis.accelerate(blocks, 0, BLOCK)
    with pytest.raises(ValueError):
        analysis.accelerate(blocks, 2.0, BLOCK, noise="demix")


def test_codes_and_floors(spark):
    codes = spark.createDataFrame([(1, i, [i // 3, i % 5], float(i % 7)) for i in range(50)], "recording_id int, frame_idx int, cb array<int>, rms double")
    floors = spark.createDataFrame([(1, 0.0, 0.6), (1, 10.0, 0.6)], "recording_id int, t double, floor double")
    plain, held = (analysis.analyse_codes(codes, 0.1, floors=f).orderBy("frame_idx").toPandas() for f in (None, floors))
    assert len(plain) == int(49 / 12.5 / 0.1) and (held["score"] >= 0.6 - 1e-12).all() and (held["score"] >= plain["score"] - 1e-12).all()


def test_soft_clip_and_even_blocks(spark):
    recordings = {1: RNG.normal(size=9000), 2: RNG.normal(size=5000) * 0.1, 3: np.zeros(10)}
    blocks = blocks_of(spark, recordings)
    targets = spark.createDataFrame([(k, 0.2) for k in recordings], "recording_id long, target double")
    found = whole(signal_blocks.soft_clip(blocks, targets))
    rows = chunks.samples_of(blocks).withColumnRenamed("sample_idx", "frame_idx")
    want = w.soft_clip(rows, 0.2).orderBy("frame_idx").toPandas()
    for k in recordings:
        assert np.allclose(found[k], want["out"][want["recording_id"] == k])
    pieces = blocks.withColumn("n", F.size("samples")).select("recording_id", F.explode(F.array(F.struct(F.col("start_sample"), F.slice("samples", 1, 7).alias("samples")), F.struct((F.col("start_sample") + 7).alias("start_sample"), F.slice("samples", F.lit(8), F.greatest(F.lit(0), F.col("n") - 7)).alias("samples")))).alias("p")).select("recording_id", "p.*")
    even = chunks.even_blocks(pieces, 1000).collect()
    assert all(len(r.samples) == 1000 or r.start_sample + len(r.samples) == len(recordings[r.recording_id]) for r in even)
    joined = whole(chunks.even_blocks(pieces, 1000))
    assert all(np.array_equal(joined[k], x) for k, x in recordings.items())


def test_recordings_of_one_block_need_no_halo(spark):
    recordings = {k: np.sin(np.arange(n) / (9 + k)) * np.repeat(RNG.random(-(-n // 600)), 600)[:n] + RNG.normal(size=n) * 0.02 for k, n in enumerate((4000, 2667, 4799, 4800, 9001))}
    found = whole(analysis.accelerate(blocks_of(spark, recordings), 2.0, BLOCK))
    for k, x in recordings.items():
        clean, duration = signal.spectral_gate(x), len(x) / 24_000
        scores = mel_scores(spark, clean)
        grid = np.linspace(0, duration, max(1, int(duration / 0.02)))
        scores = signal.prosodic_modulation(np.interp(grid, np.linspace(0, duration, len(scores)), scores), grid, clean)
        tilted = signal.match_tilt(clean, chunks.play_at_rates(clean, grid, rates.rate_schedule(scores, grid, 2.0), 24_000))
        want = signal.post_process(signal.soft_clip(tilted, float(np.sqrt((x**2).mean()))))
        assert len(found[k]) == len(want) and np.allclose(found[k], want, atol=1e-6), k
    out = analysis.accelerate(blocks_of(spark, {k: recordings[k] for k in range(3)}), 2.0, BLOCK)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "first(samples" not in plan  # the edges that blocks lend


def test_a_step_may_make_more_than_a_block(spark):
    x = RNG.normal(size=3000)
    out = analysis.accelerate(blocks_of(spark, {1: x}), 2.0, BLOCK, step=lambda x, t, r, sr: np.tile(x, 4), noise="none", uniform=True, declick=False, with_room=False, dither=False)
    assert sorted((r.block_idx, r.start_sample, len(r.samples)) for r in out.collect()) == [(0, 0, 4800), (1, 4800, 4800), (2, 9600, 2400)]


def test_soft_clip_of_a_recording_equals_that_of_its_block(spark):
    recordings = {1: RNG.normal(size=900), 2: RNG.normal(size=500) * 0.1, 3: np.zeros(10)}
    targets = spark.createDataFrame([(k, 0.2) for k in recordings], "recording_id long, target double")
    found = whole(signal_blocks.soft_clip(blocks_of(spark, recordings), targets))
    assert all(np.allclose(signal.soft_clip(x, 0.2), found[k]) for k, x in recordings.items())
