"""Block forms of spectra, finishing and filters against the forms over whole recordings."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from rubato.operators import chunks, recurrences, signal
from rubato.operators import signal_blocks as sb

RNG = np.random.default_rng(21)


def blocks_of(spark, recordings: dict, block: int):
    rows = [(k, i // block, i, x[i : i + block].tolist()) for k, x in recordings.items() for i in range(0, len(x), block)]
    return spark.createDataFrame(rows, "recording_id long, block_idx int, start_sample long, samples array<double>").repartition(4)


def whole(df) -> dict:
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: r.start_sample):
        out.setdefault(r.recording_id, []).append(r.samples)
    return {k: np.concatenate(v) for k, v in out.items()}


def some(lengths) -> dict:
    return {i: np.sin(np.arange(n) / (7 + i)) * 0.4 + RNG.normal(size=n) * 0.1 for i, n in enumerate(lengths)}


@pytest.mark.parametrize(("n_fft", "hop"), [(64, 16), (64, 24), (128, 128)])
def test_mel_frames(spark, n_fft, hop):
    recordings = some((1, 20, 32, 33, 96, 97, 192, 250, 1000))
    found: dict = {}
    for r in sb.mel_frames(blocks_of(spark, recordings, 96), 96, 8000, n_fft, hop, 10).collect():
        found.setdefault(r.recording_id, {})[r.frame_idx] = r.mel
    for k, x in recordings.items():
        want = signal.extract_mel(x, 8000, n_fft, hop, 10)
        assert sorted(found[k]) == list(range(len(want)))
        assert np.allclose([found[k][i] for i in range(len(want))], want)


def test_match_tilt(spark):
    recordings = some((1, 40, 63, 64, 96, 128, 200, 201, 256, 1000, 1500))
    references = {k: np.cumsum(x) / 10 + 0.1 for k, x in recordings.items() if k != 4}
    found = whole(sb.match_tilt(blocks_of(spark, references, 200), blocks_of(spark, recordings, 200), 200, 64))
    for k, x in recordings.items():
        assert np.allclose(found[k], signal.match_tilt(references[k], x, 64) if k in references else x), k


def test_lower_halves_of_sliding_windows():
    for half, n in ((1, 5), (3, 40), (17, 100), (94, 70)):
        wide = RNG.random((n + 2 * half, 3))
        want = [np.sort(wide[i : i + 2 * half + 1], axis=0)[: half + 1].mean(axis=0) for i in range(n)]
        assert np.allclose(signal.lower_half_means(wide, half), want)


def test_quietest_frames(spark):
    values = {1: RNG.random(500), 2: np.zeros(100), 3: np.r_[np.zeros(50), RNG.random(50)], 4: RNG.integers(0, 3, 70).astype(float), 5: np.ones(1)}
    rows = [(k, i, float(v)) for k, x in values.items() for i, v in enumerate(x)]
    found = {r.recording_id: r for r in sb.quietest(spark.createDataFrame(rows, "recording_id long, frame_idx long, power double"), 0.12).collect()}
    for k, x in values.items():
        n = max(1, int(0.12 * len(x)))
        at = int(np.argsort(x, kind="stable")[n - 1])
        assert (found[k].k, found[k].frame_idx, found[k].power) == (n, at, x[at])


@pytest.mark.parametrize("deep", [False, True])
def test_spectral_gate(spark, deep):
    block = 51_200 if deep else 4096
    recordings = some((100, 1024, 5000, 4096, 8192, 20_000, 8193, block + 100, 4 * block) if not deep else (100, 5000, block, block + 1, 130_000))
    for x in recordings.values():
        x[len(x) // 3 : len(x) // 2] *= 0.05
    found = whole(sb.denoise(blocks_of(spark, recordings, block), block, "deep" if deep else "gate"))
    for k, x in recordings.items():
        assert np.allclose(found[k], signal.spectral_gate(x, deep=deep), atol=1e-9), k
    with pytest.raises(ValueError):
        sb.denoise(blocks_of(spark, {1: x}, 100), 100, "demix")


def test_clicks_of_the_spectrum(spark):
    recordings = some((10, 200, 5000, 4800))
    for x in recordings.values():
        x[len(x) // 2 : len(x) // 2 + 40] += 5
    recordings[9] = np.zeros(3000)
    recordings[9][1500] = 1
    found = {r.recording_id: r.n_clicks for r in sb.spectral_click_counts(blocks_of(spark, recordings, 480), 480).collect()}
    assert found == {k: signal.spectral_clicks(x) for k, x in recordings.items()} and found[9] == 1
    assert signal.spectral_clicks(np.ones(100), sample_rate=400) == 0


def test_post_processing(spark):
    recordings = some((3, 500, 3000, 3001, 20_000))
    recordings[4][9000:9040] += 3
    block = 2400
    found = whole(sb.post_process(blocks_of(spark, recordings, block), block))
    for k, x in recordings.items():
        assert np.allclose(found[k], signal.post_process(x), atol=1e-10), k
    dry = whole(sb.post_process(blocks_of(spark, recordings, block), block, clicks=False, with_room=False, dither=False))
    assert all(np.array_equal(dry[k], x) for k, x in recordings.items())


def test_sections_go_on_from_their_state():
    for section in [*signal.lowpass_sections(3, 0.1), *signal.lowpass_sections(2, 0.16)]:
        x, parts, state = RNG.normal(size=500), [], np.zeros(2)
        for lo, hi in ((0, 1), (1, 2), (2, 200), (200, 200), (200, 500)):
            y, state = sb.run_section(x[lo:hi], section, state)
            parts.append(y)
        assert np.allclose(np.concatenate(parts), signal.run_sections(x, section[None, :]))
        steady = recurrences.steady_state(section, 2.5)
        assert np.allclose(sb.run_section(np.full(40, 2.5), section, steady)[0], 2.5 * section[:3].sum() / (1 + section[3:].sum()))


@pytest.fixture(scope="module")
def series(spark):
    values = {k: RNG.normal(size=n) + 1 for k, n in enumerate((1, 9, 12, 13, 16, 17, 32, 33, 41, 1000))}
    rows = [(k, i, float(v)) for k, x in values.items() for i, v in enumerate(x)]
    return values, spark.createDataFrame(rows, "recording_id long, frame_idx int, value double").repartition(3)


def gathered(df) -> dict:
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: r.frame_idx):
        out.setdefault(r.recording_id, []).append(r.value)
    return {k: np.array(v) for k, v in out.items()}


@pytest.mark.parametrize("steady", [False, True])
def test_recurrences_equal_whole_runs(series, steady):
    values, frames = series
    for section in (signal.lowpass_sections(2, 0.16)[0], np.array([0.2, 0.0, 0.0, -0.8, 0.0])):
        found = gathered(recurrences.filtered(frames, "value", section, steady, 16))
        for k, x in values.items():
            assert np.allclose(found[k], signal.run_sections(x, section[None, :], steady))


def test_zero_phase_filter_equals_the_whole(series):
    values, frames = series
    found = gathered(recurrences.zero_phase(frames, "value", signal.lowpass_sections(2, 0.16), 16))
    for k, x in values.items():
        assert np.allclose(found[k], signal.zero_phase_lowpass(x, 0.16) if len(x) > 12 else x), k


def test_prosodic_envelope_and_modulation(spark):
    recordings = some((100, 480, 480 * 13, 480 * 40 + 7))
    recordings[7] = np.zeros(480 * 20)
    envelope = sb.prosodic_envelope(blocks_of(spark, recordings, 960), 960)
    found = gathered(envelope)
    for k, x in recordings.items():
        want = signal.prosodic_envelope(x)
        assert np.allclose(found.get(k, np.zeros(0)), want), k
    scores = spark.createDataFrame([(k, i, i * 0.013, float(v)) for k in recordings for i, v in enumerate(RNG.random(60))], "recording_id long, frame_idx int, t double, score double")
    changed = gathered(sb.prosodic_modulation(scores, envelope, width=0.1).withColumnRenamed("score", "value"))
    for k, x in recordings.items():
        own = scores.where(F.col("recording_id") == k).orderBy("frame_idx").toPandas()
        assert np.allclose(changed[k], signal.prosodic_modulation(own["score"].to_numpy(), own["t"].to_numpy(), x))


def test_codec_frames(spark):
    rows = [(1, i, float(i)) for i in range(70)] + [(2, i, 1.0) for i in range(64)] + [(3, 0, None)]
    found = chunks.codec_frames(spark.createDataFrame(rows, "recording_id long, frame_idx int, value double"), 32)
    got = {k: np.array([r.value for r in sorted(found.where(F.col("recording_id") == k).collect(), key=lambda r: (r.frame_idx, r.sample_idx))]) for k in (1, 2, 3)}
    assert np.array_equal(got[1], signal.codec_frames(np.arange(70.0), 32).ravel()) and len(got[2]) == 64 and got[3].tolist() == [0.0] * 32


def test_a_recording_of_five_million_samples(spark):
    """One recording over many tasks; no task has more than a few of its blocks."""
    n, block = 5_000_000, 24_000
    ids = spark.range(-(-n // block)).select(F.lit(1).alias("recording_id"), F.col("id").cast("int").alias("block_idx"), (F.col("id") * block).alias("start_sample"))
    last = F.least(F.col("start_sample") + block, F.lit(n)) - 1
    blocks = ids.withColumn("samples", F.transform(F.sequence(F.col("start_sample"), last), lambda i: F.sin(i * i % 7919) / 2))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        halo = chunks.with_halo(blocks, 500, 500)
        assert max(r["count"] for r in halo.groupBy(F.spark_partition_id().alias("p")).count().collect()) < 14
        frames = sb.mel_frames(blocks, block, n_mels=4)
        assert frames.count() == sb.frame_count(n, signal.HOP)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_noise_is_not_sent_through_the_driver(spark):
    """Noise is as long as the recordings, however few they are; lengths that occur twice have it once."""
    recordings = some((2400 * 3 + 5, 2400 * 3 + 5, 700, 700, 1))
    blocks = blocks_of(spark, recordings, 2400)
    found = sb.dithered(blocks, 2400)
    assert {"noise", "state"}.isdisjoint(found.columns)
    got = whole(found)
    for k, x in recordings.items():
        assert np.allclose(got[k], signal.warm_dither(x), atol=1e-12), k
    lengths = spark.createDataFrame([(2400 * 3 + 5,), (700,)], "n_samples long")
    states = sb.noise_states(lengths, 2400).collect()
    assert sorted((r.n_samples, r.block_idx, r.state is None) for r in states) == [(700, 0, True), (7205, 0, True), (7205, 1, False), (7205, 2, False), (7205, 3, False)]
    assert all(len(r.state) < 3000 for r in states if r.state)


def test_edges_are_lent_only_where_a_block_may_be(spark):
    rows = [(k, b, b * 100, [float(b)] * 100) for k in range(3) for b in range(k + 1)]
    blocks = spark.createDataFrame(rows, "recording_id long, block_idx int, start_sample long, samples array<double>")
    plan = chunks.with_halo(blocks, 2, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "block_idx#" in plan and "> 0" in plan  # the first block lends nothing to one before it
    found = {(r.recording_id, r.block_idx): (r.left, r.right) for r in chunks.with_halo(blocks, 2, 3).collect()}
    assert found == {(k, b): ([b - 1.0] * 2 if b else None, [b + 1.0] * 3 if b < k else None) for k, b, *_ in rows}
