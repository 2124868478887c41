"""Properties and hand-computed values of the operators."""

from __future__ import annotations

import json
import os
import subprocess
import sys
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from rubato.functions.scalars import LABELS, augmentation_ratio, grid_time, label_class, parse_resolution, rate_contrast
from rubato.operators import chunks, evaluation, importance, joins, rates, signal
from rubato.operators import windows as w
from rubato.sources import audio
from rubato.streaming.tumbling import tumbling_energy

RNG = np.random.default_rng(42)


@pytest.mark.parametrize("gamma", [1.0, 1.5, 2.0])
def test_schedule_meets_the_target_duration(gamma):
    times = np.linspace(0, 10, 200)
    r = rates.rate_schedule(RNG.random(200), times, 3.0, gamma=gamma)
    assert abs(np.sum(np.diff(times, prepend=0) / r) - 10 / 3) < 10 / 3 * 0.01
    assert r.min() >= 1 and r.max() <= 10


def test_schedule_of_odd_recordings():
    assert len(rates.rate_schedule(np.zeros(0), np.zeros(0), 2.0)) == 0
    assert rates.rate_schedule(np.ones(3), np.zeros(3), 2.0).tolist() == [2, 2, 2]
    gentle, strong = (rates.rate_schedule(np.linspace(0, 1, 50), np.linspace(0, 5, 50), 3.0, gamma=g) for g in (1.0, 2.0))
    assert np.ptp(strong) > np.ptp(gentle)


def test_slew_limit_equals_the_loop(spark):
    x = RNG.random(60) * 9
    want = x.copy()
    for i in range(1, 60):
        want[i] = min(want[i], want[i - 1] + 0.3)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "recording_id int, frame_idx int, value double")
    found = df.select("frame_idx", w.slew_limited(F.col("value")).alias("y")).orderBy("frame_idx").collect()
    assert np.allclose([r.y for r in found], want)


def test_gaussian_native_and_numpy_agree(spark):
    x = RNG.random(40)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "recording_id int, frame_idx int, value double")
    found = w.gaussian_smooth(df, 15.0).orderBy("frame_idx").collect()
    assert np.allclose([r.smoothed for r in found], rates.gaussian(x, 15.0))


def test_interpolation_equals_numpy(spark):
    t, v, q = np.sort(RNG.random(30)), RNG.random(30), RNG.random(100) * 1.4 - 0.2
    knots = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(t, v, strict=True)], "recording_id int, t double, value double")
    want = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(q)] + [(2, 0, 0.5)], "recording_id int, frame_idx int, t double")
    found = {(r.recording_id, r.frame_idx): r.value for r in joins.interpolate_at(knots, want).collect()}
    assert np.allclose([found[1, i] for i in range(100)], np.interp(q, t, v)) and found[2, 0] is None


def test_index_interpolation_goes_on_beyond_the_ends(spark):
    frames = spark.createDataFrame([(1, i, [float(i * i), -2.0 * i]) for i in range(4)] + [(2, 0, [5.0, 1.0])], "recording_id int, frame_idx int, mel array<double>")
    at = [-1.0, -0.5, 0.0, 1.5, 3.0, 3.5, 5.0]
    sources = spark.createDataFrame([(k, i, s) for k in (1, 2) for i, s in enumerate(at)], "recording_id int, frame_idx int, src double")
    found = {(r.recording_id, r.src): r.mel for r in joins.index_interpolate(frames, sources, extrapolate=True).collect()}
    assert [found[1, s] for s in at] == [[-1, 2], [-0.5, 1], [0, 0], [2.5, -3], [9, -6], [11.5, -7], [19, -10]]
    assert all(found[2, s] == [5, 1] for s in at)
    inside = {(r.recording_id, r.src) for r in joins.index_interpolate(frames, sources).collect()}
    assert inside == {(1, 0.0), (1, 1.5), (1, 3.0), (1, 3.5), (2, 0.0)}


def test_intervals_later_wins_and_empty_is_silence(spark):
    segments = spark.createDataFrame([(1, 0, "t", 0.0, 0.1), (1, 1, "a", 0.1, 1.0), (1, 2, "?", 0.5, 0.5)], "recording_id int, seq int, label string, start double, end double")
    durations = spark.createDataFrame([(1, 1.0), (2, 0.1)], "recording_id int, duration double")
    found = {(r.recording_id, r.frame_idx): r.floor for r in joins.interval_floors(segments, durations).collect()}
    assert [found[1, i] for i in range(50)] == [0.5] * 5 + [0.1] * 45
    assert [found[2, i] for i in range(5)] == [0.02] * 5


def test_frame_classes(spark):
    def frame(blank, label=None):
        x = [-10.0] * 29
        x[0] = float(np.log(blank))
        if label:
            x[LABELS.index(label)] = float(np.log(0.7))
        return x

    rows = [(frame(0.9),), (frame(0.1, "t"),), (frame(0.1, "a"),), (frame(0.1, "s"),), (frame(0.1, "*"),), (frame(0.1, "'"),)]
    found = [r.c for r in spark.createDataFrame(rows, "lp array<double>").select(importance.frame_class(F.col("lp")).alias("c")).collect()]
    assert found == ["silence", "plosive", "vowel", "fricative", "plosive", "plosive"]
    letters = spark.createDataFrame([("m",), ("w",), ("é",)], "x string").select(label_class(F.col("x")).alias("c")).collect()
    assert [r.c for r in letters] == ["nasal", "liquid_glide", "plosive"]


def test_mel_importance_spreads_a_peak(spark):
    rows = [(1, i, [5.0 if i == 25 else 0.0] * 100) for i in range(50)]
    found = importance.mel_importance(spark.createDataFrame(rows, "recording_id int, frame_idx int, mel array<double>")).orderBy("frame_idx").collect()
    scores = [r.score for r in found]
    assert min(scores) == 0 and max(scores) == 1 and all(s > 0 for s in scores[22:30]) and scores[10] == 0


def test_scalars(spark):
    row = spark.range(1).select(
        parse_resolution(F.lit(" 20MS ")).alias("a"), parse_resolution(F.lit("1s")).alias("b"), parse_resolution(F.lit("50")).alias("c"), augmentation_ratio(F.lit(2000)).alias("d"),
        grid_time(F.lit(0), F.lit(1), F.lit(9.0)).alias("e"), rate_contrast(F.lit(5.5), 1.5).alias("f"),
    ).first()
    assert tuple(row)[:5] == (0.02, 1.0, 0.05, pytest.approx(0.2), 0.0) and row.f == pytest.approx(1 + 0.5**1.5 * 9)


def test_chunks_cover_and_crossfade_restores(spark):
    plan = chunks.plan_chunks(spark.createDataFrame([(1, 2050), (2, 0), (3, 1000)], "recording_id int, n_samples long"), 1000, 100).orderBy("recording_id", "index").collect()
    assert [tuple(r)[1:] for r in plan if r.recording_id == 1] == [(0, 0, 1100, 0, 100), (1, 900, 2050, 100, 50), (2, 1900, 2050, 100, 0)]
    assert len([r for r in plan if r.recording_id in (2, 3)]) == 2
    x = RNG.random(100)
    parts = [(1, 0, x[:60].tolist(), 0, 10), (1, 1, x[50:].tolist(), 10, 0)]
    joined = chunks.crossfade_concat(spark.createDataFrame(parts, "recording_id int, index int, samples array<double>, fade_in int, fade_out int"))
    assert np.allclose([r.value for r in joined.orderBy("sample_idx").collect()], x)


def test_rates_in_empty_chunks_and_wide_overlaps(spark):
    points = [0.5, 1.0, 4.5, 5.0]
    plan = [(1, i, max(0, i * 10 - 25), min(i * 10 + 35, 60)) for i in range(6)] + [(2, 0, 0, 10), (2, 1, 10, 20), (2, 2, 20, 25)]
    df = spark.createDataFrame(plan, "recording_id int, index int, start_sample long, end_sample long")
    rows = [(1, t, 1 + t) for t in points] + [(2, 0.0, 1.0), (2, 2.4, 3.4)]
    found = chunks.rates_in_chunks(df, spark.createDataFrame(rows, "recording_id int, t double, rate double"), 10.0, 10).collect()
    want = [(r, i, t - a / 10, 1 + t) for r, i, a, b in plan for q, t, _ in rows if q == r and a / 10 <= t <= b / 10]
    want += [(2, 1, 0.0, 2.5), (2, 1, 1.0, 2.5)]
    assert np.allclose(sorted(tuple(r) for r in found), sorted(want))


def test_clicks_of_the_spectrum_count(spark):
    quiet = [(1, i, 1.0) for i in range(60)] + [(2, i, 9.0 if i in (20, 30, 40) else 1.0) for i in range(60)]
    energy = spark.createDataFrame(quiet, "recording_id int, frame_idx int, energy double")
    spectral = spark.createDataFrame([(1, 2), (2, 1), (3, 4)], "recording_id int, n_clicks long")
    durations = spark.createDataFrame([(1, 0.12), (2, 0.12), (3, 0.001), (4, 1.0)], "recording_id int, duration double")
    found = w.clicks_per_second(energy, spectral, durations).orderBy("recording_id").collect()
    assert [r.n_clicks for r in found] == [2, 3, 4, 0]
    silence = np.zeros(24_000)
    silence[12_000] = 1.0
    assert signal.spectral_clicks(silence) == 1
    assert np.allclose([r.clicks_per_second for r in found], [2 / 0.12, 3 / 0.12, 0, 0])


def test_signal_round_trips_and_properties():
    x = RNG.normal(size=5000) * 0.1
    assert np.allclose(signal.istft(signal.stft(x, 1024, 256), 1024, 256, 5000)[100:-200], x[100:-200])
    assert signal.extract_mel(x).shape == (20, 100)
    click = np.full(24_000, 0.01)
    for at in (6000, 12_000, 18_000):
        click[at : at + 6] = 1.0
    assert np.abs(signal.declick(click)).max() < 0.8 and len(signal.declick(np.ones(3))) == 3
    assert np.array_equal(signal.declick(np.zeros(24_000)), np.zeros(24_000))
    assert signal.spectral_clicks(click) >= 3 and signal.spectral_clicks(np.zeros(24_000)) == 0
    assert len(signal.post_process(x)) == len(x) and np.abs(signal.room(x)).max() == pytest.approx(np.abs(x).max())
    assert np.allclose(signal.match_tilt(x, x)[300:-300], x[300:-300], atol=1e-6)


def test_lowpass_passes_slow_and_stops_fast():
    t = np.arange(500) / 50
    slow, fast = np.sin(2 * np.pi * 0.5 * t), np.sin(2 * np.pi * 20 * t)
    assert np.allclose(signal.zero_phase_lowpass(slow, 4 / 25)[50:-50], slow[50:-50], atol=0.01)
    assert np.abs(signal.zero_phase_lowpass(fast, 4 / 25)[50:-50]).max() < 0.01
    assert np.allclose(signal.run_sections(np.ones(50), signal.lowpass_sections(2, 0.2), True), 1)


def test_gate_lowers_noise_in_the_gap():
    t = np.arange(48_000) / 24_000
    voice = np.sin(2 * np.pi * 120 * t) * ((t < 0.8) | (t > 1.2)) * 0.3
    noisy = voice + RNG.normal(size=48_000) * 0.03
    gap = slice(21_000, 27_000)
    assert np.std(signal.spectral_gate(noisy)[gap]) < 0.5 * np.std(noisy[gap])


def test_adaptive_smoothing_and_roundtrip():
    mel = RNG.normal(size=(200, 20))
    assert np.allclose(rates.adaptive_smooth(mel, np.ones(200)), rates.gaussian(mel, 0.3))
    out = rates.adaptive_smooth(mel, np.r_[np.ones(100), np.full(100, 8.0)])
    assert out[120:].std() < out[:80].std()
    near, far = (np.abs(signal.resample_roundtrip(mel, r) - mel).mean() for r in (1.5, 5.0))
    assert near < far and signal.resample_roundtrip(mel, 3.0).shape == mel.shape


def brute_distance(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_word_errors(spark):
    rng = np.random.default_rng(1)
    text = lambda k: " ".join(rng.choice(["a", "bb", "ccc", "é", "中", "\U0001f600", "d"], k))
    pairs = [("a b c", "a x c d"), ("", "a"), (None, None), ("a", None), ("a  b\tc", "a b c")] + [(text(k), text(k + 2)) for k in range(12)]
    pairs.append((" ".join(f"w{i}" for i in range(900)), " ".join(f"w{i}" for i in range(0, 900, 2))))
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "pair_id int, reference string, hypothesis string")
    for r in evaluation.word_error_rates(rows).collect():
        ref, hyp = ((x or "").split() for x in pairs[r.pair_id])
        assert r.wer == (pytest.approx(brute_distance(ref, hyp) / len(ref)) if ref else None)


def test_the_alphabet_of_a_pair_is_made_once_not_for_every_word(spark):
    rows = spark.createDataFrame([(0, "a b", "a c")], "pair_id int, reference string, hypothesis string")
    plan = evaluation.word_error_rates(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct") == 1


def test_expected_phase_advance_has_no_deviation(spark):
    step = 2 * np.pi * 256 / 1024
    rows = [(0, b, f, float(b * step * f), 1.0) for b in range(8) for f in range(5)]
    loss = evaluation.frequency_deviation(spark.createDataFrame(rows, "batch int, bin int, frame_idx int, phase double, mag double")).first().loss
    assert loss < 1e-5


def test_wav_files_and_documents(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    x = np.sin(np.arange(300_000) / 50) * 0.5
    payload = audio.wav_payloads(spark.createDataFrame([(1, x.tolist()), (2, [])], "recording_id int, samples array<double>"), 24_000)
    for r in payload.collect():
        with open(f"{folder}/{r.recording_id}.wav", "wb") as f:
            f.write(r.payload)
    with open(f"{folder}/bad.wav", "wb") as f:
        f.write(b"no audio")
    blocks = audio.read_wav(spark, folder).orderBy("path", "block_idx").collect()
    assert [(os.path.basename(b.path), b.block_idx, len(b.samples)) for b in blocks] == [("1.wav", 0, 120_000), ("1.wav", 1, 120_000), ("1.wav", 2, 60_000), ("2.wav", 0, 0), ("bad.wav", 0, 0)]
    assert np.allclose(np.concatenate([b.samples for b in blocks[:3]]), x, atol=1e-4) and blocks[4].sample_rate is None
    scores = spark.createDataFrame([(1, 1, 0.5, 0.25), (1, 0, 0.0, 1.0)], "recording_id int, frame_idx int, t double, score double")
    document = json.loads(audio.analysis_documents(scores, 0.02).first().document)
    assert document["scores"] == [1.0, 0.25] and document["n_frames"] == 2 and document["frame_rate"] == 50


def test_stream_gives_the_batch_result(spark, small_dir):
    rows = spark.read.parquet(f"{small_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("recording_id"), "value")
    folder = tempfile.mkdtemp(prefix="spark-")
    rows.write.mode("overwrite").parquet(folder)
    stream = tumbling_energy(spark.readStream.schema(rows.schema).parquet(folder), "1 hour")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("energies").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("energies").collect())) == sorted(map(tuple, tumbling_energy(rows, "1 hour").collect()))


def by_loop(x, sections, steady=False):
    """Second-order sections, sample by sample."""
    level = float(x[0]) if steady else 0.0
    for b0, b1, b2, a1, a2 in sections:
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        z1, z2, out = level * (gain - b0), level * (b2 - a2 * gain), []
        for v in x:
            out.append(b0 * v + z1)
            z1, z2 = b1 * v - a1 * out[-1] + z2, b2 * v - a2 * out[-1]
        x, level = np.array(out), level * gain
    return x


@pytest.mark.parametrize("n", [1, 9, 700, 40_000])
def test_filters_and_convolution_equal_plain_ones(n):
    x = RNG.normal(size=n)
    for response in (RNG.normal(size=1), RNG.normal(size=1920)):
        assert np.allclose(signal.convolve(x, response), np.convolve(x, response)[:n])
    for order, cutoff in ((2, 0.16), (3, 0.125), (2, 0.01)):
        sections = signal.lowpass_sections(order, cutoff)
        for steady in (False, True):
            assert np.allclose(signal.run_sections(x, sections, steady), by_loop(x, sections, steady), atol=1e-12)


def test_post_processing_equals_its_formulas():
    x = RNG.normal(size=30_000) * 0.1
    draws = np.random.RandomState(42)
    taps = np.zeros(1920)
    taps[0] = 1
    for i in range(6):
        at = int(24_000 * (1 + draws.uniform(1, 15)) / 1000)
        taps[at] += 0.15 * 0.6**i * draws.choice([-1, 1])
    taps += draws.randn(1920) * 0.02 * np.exp(-6.9 * np.arange(1920) / 24_000 / 0.08)
    taps /= np.abs(taps).max()
    assert np.sort(np.abs(taps))[-2] > 0.1  # an early reflection
    wet = np.convolve(x, taps)[:30_000]
    wet *= np.abs(x).max() / np.abs(wet).max()
    assert np.allclose(signal.room(x), wet)
    noise = by_loop(np.random.RandomState(30_000).randn(30_000), signal.lowpass_sections(3, 1500 / 12_000))
    assert np.allclose(signal.warm_dither(x), x + noise * 1e-3 / noise.std())
    assert np.allclose(signal.post_process(x), signal.warm_dither(signal.room(signal.declick(x))))
    assert np.array_equal(signal.post_process(x, clicks=False, with_room=False, dither=False), x)
    assert not len(signal.post_process(np.zeros(0))) and not signal.room(np.zeros(10)).any()


def test_clicks_of_known_signals(spark):
    t = np.arange(48_000) / 24_000
    spikes = np.sin(2 * np.pi * 440 * t) * 0.01
    spikes[[10_000, 30_000, 40_000]] = 0.9
    impulse = np.zeros(24_000)
    impulse[12_000] = 1.0
    assert signal.spectral_clicks(np.sin(2 * np.pi * 440 * t) * 0.3) == 0 and signal.spectral_clicks(spikes) >= 3
    assert signal.spectral_clicks(impulse) >= 1 and signal.spectral_clicks(np.zeros(100)) == 0
    quiet = [(1, i, 1e-13 * (9 if i == 30 else 1)) for i in range(60)]  # a median of any size above 0 counts here
    found = w.click_counts(spark.createDataFrame(quiet, "recording_id int, frame_idx int, energy double")).first()
    assert found.n_clicks == 1


BLOCK_TYPE = "recording_id int, block_idx int, start_sample long, samples array<double>"


def as_blocks(spark, recordings, block):
    rows = [(k, i // block, i, x[i : i + block].tolist()) for k, x in recordings.items() for i in range(0, len(x), block)]
    return spark.createDataFrame(rows, BLOCK_TYPE)


def whole(blocks):
    out = {}
    for r in sorted(blocks.collect(), key=lambda r: (r.recording_id, r.start_sample)):
        assert r.start_sample == len(out.get(r.recording_id, ()))
        out[r.recording_id] = np.r_[out.get(r.recording_id, np.zeros(0)), r.samples]
    return out


def test_blocks_give_what_the_whole_gives(spark):
    recordings = {k: RNG.normal(size=n) * 0.01 for k, n in enumerate((1, 100, 1056, 20_000, 300_007))}
    for x in recordings.values():
        for at in range(500, len(x), 3100):
            x[at : at + 7] = 1.0
    for block in (1056, 48_000):
        found = whole(chunks.declick_blocks(as_blocks(spark, recordings, block), block))
        assert all(np.allclose(found[k], signal.declick(x)) for k, x in recordings.items())
    found = whole(chunks.room_blocks(as_blocks(spark, recordings, 48_000), 48_000))
    assert all(np.allclose(found[k], signal.room(x)) for k, x in recordings.items())
    with pytest.raises(ValueError):
        chunks.declick_blocks(as_blocks(spark, recordings, 1000), 1000)


def test_a_long_recording_in_blocks(spark):
    n, block = 5_000_000, 240_000
    blocks = spark.range(n // block + 1).select(
        F.lit(1).alias("recording_id"), F.col("id").cast("int").alias("block_idx"), (F.col("id") * block).alias("start_sample"),
        F.transform(F.sequence(F.lit(0), F.least(F.lit(block), n - F.col("id") * block).cast("int") - 1), lambda i: F.sin((i + F.col("id") * block) / 50.0) / 100 + F.when((i + F.col("id") * block) % 1_000_003 < 6, 1.0).otherwise(0.0)).alias("samples"),
    )
    at = np.arange(n)
    want = signal.room(signal.declick(np.sin(at / 50) / 100 + (at % 1_000_003 < 6)))
    declicked = chunks.declick_blocks(blocks, block)
    out = chunks.room_blocks(declicked, block)
    got = out.select(F.sum(F.aggregate("samples", F.lit(0.0), lambda a, v: a + F.abs(v))).alias("s"), F.sum(F.size("samples")).alias("n"), F.count("*").alias("k")).first()
    assert (got.n, got.k) == (n, 21) and got.s == pytest.approx(np.abs(want).sum())


def brute_merge(parts):
    """Parts (samples, fade in, fade out) one after another onto what there is."""
    done = []
    for i, (x, a, z) in enumerate(parts):
        k = min(a, len(done[-1]), len(x)) if i and a else 0
        if k:
            rise = np.linspace(0, 1, k)
            blended = done[-1][len(done[-1]) - k :] * (1 - rise) + x[:k] * rise
            done[-1] = done[-1][: len(done[-1]) - k]
            done.append(blended)
        done.append(x[k : max(k, len(x) - z)])
    return np.concatenate(done) if done else np.zeros(0)


def test_merging_equals_appending_one_by_one(spark):
    rng = np.random.default_rng(3)
    recordings = {k: [(rng.normal(size=rng.integers(0, 12)), int(rng.integers(0, 5)), int(rng.integers(0, 5))) for _ in range(rng.integers(1, 6))] for k in range(60)}
    rows = [(k, i, x.tolist(), a if i else 0, z if i + 1 < len(p) else 0) for k, p in recordings.items() for i, (x, a, z) in enumerate(p)]
    merged = chunks.merge_parts(spark.createDataFrame(rows, "recording_id int, index int, samples array<double>, fade_in int, fade_out int"))
    got = {(r.recording_id, r.sample_idx): r.value for r in chunks.samples_of(merged).collect()}
    for k in recordings:
        want = brute_merge([(np.array(x), a, z) for key, _, x, a, z in rows if key == k])
        assert [got.get((k, i)) for i in range(len(want))] == pytest.approx(want.tolist()) and (k, len(want)) not in got


def test_chunked_equals_unchunked(spark):
    recordings = {k: np.sin(np.arange(n) / 9) for k, n in enumerate((1, 40, 700, 2011))}
    blocks = as_blocks(spark, recordings, 64)
    same = whole(chunks.process_chunked(blocks, 1.0, 10, 64, lambda x, t, r: x, 20.0, 2.0))
    assert all(np.allclose(same[k], x) for k, x in recordings.items())
    slow = whole(chunks.process_chunked(blocks, 2.0, 10, 64, lambda x, t, r: chunks.play_at_rates(x, t, r, 10), 20.0, 2.0))
    for k, x in recordings.items():
        alone = chunks.play_at_rates(x, np.array([0.0, len(x) / 10]), np.array([2.0, 2.0]), 10)
        assert abs(len(slow[k]) - len(alone)) <= 2 + len(x) // 200 and np.abs(slow[k][: len(alone)][:95] - alone[: len(slow[k])][:95]).max() < 0.25  # a sample's step apart at most
    curve = spark.createDataFrame([(k, float(t), 1.0 + t % 2) for k in range(4) for t in range(0, 200, 50)], "recording_id int, t double, rate double")
    assert set(whole(chunks.process_chunked(blocks, 1.5, 10, 64, lambda x, t, r: x[: len(t)] * 0 + r[: len(x[: len(t)])], 20.0, 2.0, curve))) == set(recordings)
    with pytest.raises(ValueError):
        chunks.process_chunked(blocks, 0.0, 10, 64, lambda x, t, r: x)


def test_mel_importance_takes_its_parameters(spark):
    rows = [(1, i, [3.0 * (i == 5)] * 50 + [1.0 * (i == 15)] * 50) for i in range(30)]
    mel = spark.createDataFrame(rows, "recording_id int, frame_idx int, mel array<double>")
    score = lambda **o: {r.frame_idx: r.score for r in importance.mel_importance(mel, **o).collect()}
    assert score(hf_boost=2.5)[15] > score(hf_boost=2.0)[15]
    above = lambda k: sum(s > 0.5 for s in score(peak_spread=k).values())
    assert above(7) > above(1)
    assert score(hf_start=0.0) != score() and score(silence_threshold=0.0) == score(closure_threshold=2.0)


def test_roundtrip_smooths_and_draws_its_rate():
    mel = RNG.normal(size=(94, 5))
    padded = np.pad(mel, ((6, 6), (0, 0)), mode="reflect")
    weights = np.exp(-0.5 * (np.arange(-6, 7) / 2.0) ** 2)
    want = np.stack([np.convolve(padded[:, j], weights / weights.sum(), "valid") for j in range(5)], axis=1)
    assert np.allclose(signal.smoothed_frames(mel, 2.0), want)
    assert signal.random_resample_roundtrip(mel, 1).shape == mel.shape and np.allclose(signal.random_resample_roundtrip(mel, 1), signal.random_resample_roundtrip(mel, 1))
    assert np.allclose(signal.resample_roundtrip(mel, 1.0), mel) and not len(signal.resample_roundtrip(mel[:0], 2.0))


def test_noise_can_be_taken_off_in_ways_that_are_there():
    x = RNG.normal(size=24_000) * 0.03
    assert signal.denoise(x, "none") is x and np.std(signal.denoise(x, "deep")) < np.std(x) > np.std(signal.denoise(x))
    with pytest.raises(ValueError):
        signal.denoise(x, "demucs")


def test_small_operators(spark):
    durations = spark.createDataFrame([(1, 1.0), (2, 0.0)], "recording_id int, duration double")
    rows = rates.uniform_rate_schedule(durations, 2.0).collect()
    assert np.allclose([r.t for r in rows if r.recording_id == 1], np.linspace(0, 1, 50)) and len(rows) == 51 and {r.rate for r in rows} == {2.0}
    with pytest.raises(ValueError):
        rates.uniform_rate_schedule(durations, 0)
    results = spark.createDataFrame([(1, "a", 0.2, 0.1), (1, "b", 0.1, 0.3), (1, "c", None, None), (2, "a", None, None)], "recording_id int, label string, wer double, cer double")
    assert sorted((r.recording_id, r.label) for r in evaluation.evaluation_report(results).where("best").collect()) == [(1, "b")]
    assert signal.codec_frames(np.ones(2000)).sum(axis=1).tolist() == [1920, 80] and signal.codec_frames(np.zeros(0)).shape == (0, 1920)
    items = spark.range(100).withColumnRenamed("id", "k")
    draw = [[r.k for r in evaluation.drawn_trials(items, "k", 10, s).collect()] for s in (1, 1, 2)]
    assert draw[0] == draw[1] != draw[2] and len(set(draw[0])) == 10
    assert signal.fixed_length(np.array([0.5, -1.0]), 5, 0.0).tolist() == [0.5, -1, 0.5, -1, 0.5] and np.abs(signal.fixed_length(RNG.normal(size=900), 100)).max() <= 10 ** (-3 / 20)


def test_wav_files_in_slices(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    x = np.sin(np.arange(100_000) / 40) * 0.5
    for name, rate in (("a", 24_000), ("b", 48_000)):
        with open(f"{folder}/{name}.wav", "wb") as f:
            f.write(audio.encode_wav(x, rate))
    with open(f"{folder}/bad.wav", "wb") as f:
        f.write(b"RIFF no audio")
    durations = {os.path.basename(r.path): r.duration for r in audio.probe_durations(spark, folder).collect()}
    assert durations == {"a.wav": pytest.approx(100_000 / 24_000), "b.wav": pytest.approx(100_000 / 48_000), "bad.wav": None}
    for seconds in (0.7, 60.0):
        found = {os.path.basename(k): v for k, v in whole(audio.read_wav_parallel(spark, folder, 24_000, seconds)).items()}
        assert set(found) == {"a.wav", "b.wav"} and abs(len(found["b.wav"]) - 50_000) <= 4
        assert np.allclose(found["a.wav"], x, atol=1e-4)
        assert np.allclose(found["b.wav"][100:49_000], x[200:98_000:2], atol=2e-3)
    part = audio.samples_between(audio.read_wav(spark, f"{folder}/a.wav"), 1.0, 2.0).collect()
    assert [(r.start_sample, len(r.samples)) for r in part] == [(24_000, 48_000)] and np.allclose(part[0].samples, x[24_000:72_000], atol=1e-4)
    raw = audio.pcm_payloads(spark.createDataFrame([(1, x.tolist()), (2, None)], "recording_id int, samples array<double>")).orderBy("recording_id").collect()
    assert np.allclose(np.frombuffer(raw[0].payload, "<f4"), x, atol=1e-7) and raw[1].payload == b""
    for suffix in (".mp3", ".xyz"):
        with pytest.raises(ValueError):
            audio.payloads(None, 24_000, suffix)
    two = as_blocks(spark, {1: x[:10], 2: x[10:25]}, 8)
    order = spark.createDataFrame([(2, 0), (1, 1)], "recording_id int, file_idx int")
    joined = np.concatenate([r.samples for r in audio.concatenated(two, order).orderBy("start_sample").collect()])
    assert np.allclose(joined, np.r_[x[10:25], x[:10]])


def test_training_items_and_file_lists(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    with open(f"{folder}/list.txt", "w") as f:
        f.write("a.wav\n\n  b.wav \n   \n")
    assert [r.path for r in audio.read_file_list(spark, folder).collect()] == ["a.wav", "b.wav"]
    values = {1: RNG.normal(size=6000), 2: RNG.normal(size=48_000), 4: np.zeros(100)}
    recordings = as_blocks(spark, values, 1000).union(spark.createDataFrame([(3, 0, 0, []), (5, 0, 0, None), (None, 0, 0, [1.0])], "recording_id long, block_idx int, start_sample long, samples array<double>"))
    for train in (True, False):
        rows = {r.recording_id: np.array(r.samples) for r in audio.training_items(recordings, 1000, 24_000, train).collect()}
        assert set(rows) == {1, 2, 4} and all(len(x) == 24_000 for x in rows.values()) and not rows[4].any()
        assert 10 ** (-6.01 / 20) <= np.abs(rows[1]).max() <= 10 ** (-0.99 / 20) and np.array_equal(rows[1][:6000], rows[1][6000:12_000])
        scale = rows[2][0] / values[2]
        at = int(np.argmin(np.abs(np.abs(scale * np.abs(values[2]).max()) - 10 ** (-3 / 20)))) if not train else next(i for i in range(24_001) if np.allclose(values[2][i : i + 50] * (rows[2][0] / values[2][i]), rows[2][:50]))
        assert np.allclose(rows[2], values[2][at : at + 24_000] * (rows[2][0] / values[2][at]))


def test_training_items_of_files_read_their_bytes_alone(spark, monkeypatch):
    folder = tempfile.mkdtemp(prefix="spark-")
    x = RNG.uniform(-1, 1, 2_000_000)
    for name, n in (("long", len(x)), ("short", 500), ("empty", 0)):
        with open(f"{folder}/{name}.wav", "wb") as f:
            f.write(audio.encode_wav(x[:n], 24_000))
    with open(f"{folder}/bad.wav", "wb") as f:
        f.write(b"nothing")
    found = {os.path.basename(r.recording_id): np.array(r.samples) for r in audio.read_training_items(spark, folder, 1000).collect()}
    assert set(found) == {"long.wav", "short.wav"} and np.allclose(found["short.wav"][:500], found["short.wav"][500:])
    read = []

    class System:
        def open_input_file(self, path):
            f = audio.wav_source.fs.LocalFileSystem().open_input_file(path)

            class File:
                def __enter__(self):
                    return self

                def __exit__(self, *_):
                    f.close()

                def read_at(self, n, at):
                    read.append(n)
                    return f.read_at(n, at)

            return File()

    monkeypatch.setattr(audio.wav_source, "file_system", lambda path: (System(), path))
    path = f"{folder}/long.wav"
    assert np.allclose(audio.read_samples(path, os.path.getsize(path), 1_234_567, 1000), x[1_234_567:1_235_567], atol=1e-4)
    assert sum(read) < 2 * 1000 + 3 * 4096


def test_sliding_stream_gives_the_batch_result(spark, small_dir):
    rows = spark.read.parquet(f"{small_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("recording_id"), "value")
    folder = tempfile.mkdtemp(prefix="spark-")
    rows.write.mode("overwrite").parquet(folder)
    stream = tumbling_energy(spark.readStream.schema(rows.schema).parquet(folder), "1 hour", slide="30 minutes")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("sliding").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("sliding").collect())) == sorted(map(tuple, tumbling_energy(rows, "1 hour", slide="30 minutes").collect()))


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and 'rate_schedule' in q"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), check=False).returncode == 0


def broadcasts(df) -> list[str]:
    """Nodes of the plan as executed that send a table through the driver."""
    df.collect()
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines() if "BroadcastExchange" in line]


def test_exploded_chunks_are_not_sent_through_the_driver(spark):
    """Chunks, their cells and the ends of empty ones grow with the recordings' lengths, however few the recordings are."""
    recordings = spark.createDataFrame([(r, 1000) for r in range(20)], "recording_id long, n_samples long")
    sizes = recordings.groupBy("recording_id").agg(F.max("n_samples").alias("n_samples"))
    points = spark.createDataFrame([(r, i * 0.7, 1.0 + i % 3) for r in range(20) for i in range(60)], "recording_id long, t double, rate double")
    plan = chunks.plan_chunks(sizes, 10, 2)
    assert not broadcasts(chunks.points_in_chunks(plan, points, 10.0, 10))
    found = chunks.rates_in_chunks(plan, points, 10.0, 10)
    assert not broadcasts(found)
    assert found.select("recording_id", "index").distinct().count() == plan.count() == 2000
