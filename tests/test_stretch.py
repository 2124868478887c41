"""Stretched frames in blocks against the form over whole recordings."""

from __future__ import annotations

import numpy as np
import pytest
from rubato.operators import rates, signal, stretch

RNG = np.random.default_rng(31)


@pytest.fixture(scope="module")
def recordings(spark):
    mels, curves, durations = [], [], []
    for k, n in enumerate((2, 3, 9, 30, 33, 64, 65, 200, 700)):
        mels += [(k, i, RNG.normal(size=5).tolist()) for i in range(n)]
        t = np.sort(RNG.random(12)) * n / 20
        curves += [(k, float(a), float(r)) for a, r in zip(t, RNG.uniform(0.2, 4, 12) if k != 5 else np.full(12, 2.0), strict=True)]
        durations.append((k, n / 20))
    make = lambda rows, kind: spark.createDataFrame(rows, kind).repartition(3)
    return make(mels, "recording_id long, frame_idx int, mel array<double>"), make(curves, "recording_id long, t double, rate double"), make(durations, "recording_id long, duration double")


def rows(df) -> dict:
    return {(r.recording_id, r.frame_idx): (r.src, r.ratio, r.mel) for r in df.collect()}


def test_blocks_equal_whole_recordings(recordings):
    found, want = rows(stretch.stretch_frames(*recordings, width=2.0, block=32)), rows(rates.stretch_frames(*recordings))
    assert found.keys() == want.keys()
    for k, (src, ratio, mel) in want.items():
        assert found[k][0] == pytest.approx(src, abs=1e-9) and found[k][1] == pytest.approx(ratio, abs=1e-9)
        assert np.allclose(found[k][2], mel), k


def test_recordings_without_rates_have_no_frames(recordings):
    mel, curve, durations = recordings
    found = rows(stretch.stretch_frames(mel, curve.where("recording_id = 3"), durations, block=32))
    assert {k for k, _ in found} == {3}


@pytest.mark.parametrize(("rate", "sigma"), [(3.0, 2.0), (1.7, 0.0)])
def test_round_trips_equal_whole_ones(recordings, spark, rate, sigma):
    mel = recordings[0].union(spark.createDataFrame([(99, 0, [1.0] * 5)], recordings[0].schema))
    found: dict = {}
    for r in stretch.resample_roundtrip(mel, rate, sigma, block=32).collect():
        found.setdefault(r.recording_id, {})[r.frame_idx] = r.mel
    whole: dict = {}
    for r in mel.collect():
        whole.setdefault(r.recording_id, {})[r.frame_idx] = r.mel
    for k, rows_ in whole.items():
        want = signal.resample_roundtrip(np.array([rows_[i] for i in range(len(rows_))]), rate, sigma)
        assert np.allclose([found[k][i] for i in range(len(want))], want), k
