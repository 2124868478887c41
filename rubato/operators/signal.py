"""Signal operators in numpy.

FFTs, recursive filters and seeded noise have no DataFrame form.  Each function
works on the samples of one recording, or of one block of it; ``per_recording``
applies one to a table (recording_id, samples), whose rows Spark spreads over
the cluster, and ``blocks`` has the forms that work block by block.  Empty
input gives empty output everywhere; samples are taken as they are, so a NaN
spreads to what depends on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .rates import gaussian

# Analysis sizes of the spectra, and the taps of the room response.
N_FFT, HOP, N_MELS, SAMPLE_RATE = 1024, 256, 100, 24_000
ROOM_SEED, REFLECTIONS, FIRST_REFLECTION, REFLECTION_FALL, TAIL_LEVEL, TAIL_DECAY = 42, 6, 0.15, 0.6, 0.02, 6.9
#: Samples that per_recording sends back at a time.
SAMPLES_AT_A_TIME = 1 << 20


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def mel_filters(sample_rate: int = SAMPLE_RATE, n_fft: int = N_FFT, n_mels: int = N_MELS) -> np.ndarray:
    """Triangles on the HTK mel scale, (n_mels, n_fft / 2 + 1)."""
    top = 2595 * np.log10(1 + sample_rate / 2 / 700)
    points = 700 * (10 ** (np.linspace(0, top, n_mels + 2) / 2595) - 1)
    freqs = np.linspace(0, sample_rate / 2, n_fft // 2 + 1)
    rise = (freqs - points[:-2, None]) / np.diff(points)[:-1, None]
    fall = (points[2:, None] - freqs) / np.diff(points)[1:, None]
    return np.maximum(0, np.minimum(rise, fall))


def stft(x: np.ndarray, n_fft: int, hop: int, cover: bool = False) -> np.ndarray:
    """(frames, bins) of the signal reflected by half a window at both ends.

    ``cover`` adds zeros so that the last frame reaches past the last sample.
    """
    half = n_fft // 2
    padded = np.pad(x, half, mode="reflect" if len(x) > half else "constant")
    if cover:
        padded = np.pad(padded, (0, -(len(padded) - n_fft) % hop))
    frames = np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop]
    return np.fft.rfft(frames * hann(n_fft), axis=1)


def istft(spectrum: np.ndarray, n_fft: int, hop: int, length: int | None = None) -> np.ndarray:
    """Overlap-add of windowed frames over the sum of squared windows, half a window cut off each end."""
    window = hann(n_fft)
    frames = np.fft.irfft(spectrum, n_fft, axis=1) * window
    size = n_fft + hop * (len(frames) - 1)
    at = (hop * np.arange(len(frames)))[:, None] + np.arange(n_fft)
    out = np.bincount(at.ravel(), frames.ravel(), size)
    norm = np.bincount(at.ravel(), np.broadcast_to(window**2, frames.shape).ravel(), size)
    out = (out / np.maximum(norm, 1e-8))[n_fft // 2 : size - n_fft // 2]
    return out if length is None else np.pad(out, (0, max(0, length - len(out))))[:length]


def extract_mel(x: np.ndarray, sample_rate: int = SAMPLE_RATE, n_fft: int = N_FFT, hop: int = HOP, n_mels: int = N_MELS) -> np.ndarray:
    """(frames, mel bins), natural log of the filtered magnitudes, 1e-5 at least."""
    return np.log(np.maximum(np.abs(stft(x, n_fft, hop)) @ mel_filters(sample_rate, n_fft, n_mels).T, 1e-5))


def lowpass_sections(order: int, cutoff: float) -> np.ndarray:
    """Butterworth low-pass of ``order``, ``cutoff`` relative to Nyquist, as rows b0 b1 b2 a1 a2."""
    warped = np.tan(np.pi * cutoff / 2)
    out = []
    for k in range(order // 2):
        q = 2 * np.cos(np.pi * (2 * k + 1 + order % 2) / (2 * order)) if order % 2 == 0 else 2 * np.cos(np.pi * (k + 1) / order)
        a0 = 1 + q * warped + warped**2
        gain = warped**2 / a0
        out.append([gain, 2 * gain, gain, 2 * (warped**2 - 1) / a0, (1 - q * warped + warped**2) / a0])
    if order % 2:
        gain = warped / (1 + warped)
        out.append([gain, gain, 0.0, (warped - 1) / (warped + 1), 0.0])
    return np.array(out)


def convolve(x: np.ndarray, response: np.ndarray) -> np.ndarray:
    """The first ``len(x)`` samples of the convolution, in blocks by overlap-add."""
    if not len(x):
        return np.zeros(0)
    tail = len(response) - 1
    size = 1 << max(2 * tail + 1, min(1 << 14, len(x) + tail)).bit_length()
    step = size - tail
    n = -(-len(x) // step)
    parts = np.zeros((n, size))
    parts[:, :step] = np.pad(x, (0, n * step - len(x))).reshape(n, step)
    wet = np.fft.irfft(np.fft.rfft(parts, axis=1) * np.fft.rfft(response, size), size, axis=1)
    out = wet[:, :step].copy()
    out[1:, :tail] += wet[:-1, step:]
    return out.ravel()[: len(x)]


@lru_cache(64)
def section_responses(b0: float, b1: float, b2: float, a1: float, a2: float) -> tuple[np.ndarray, np.ndarray]:
    """A section's answer to a single 1, and what it adds if 1 had gone on for ever before, until both have died away."""
    gain = (b0 + b1 + b2) / (1 + a1 + a2)
    found = []
    for v, z1, z2 in ((1.0, 0.0, 0.0), (0.0, gain - b0, b2 - a2 * gain)):
        out = []
        while not out or max(abs(z1), abs(z2)) > 1e-19:
            y = b0 * v + z1
            z1, z2 = b1 * v - a1 * y + z2, b2 * v - a2 * y
            out.append(y)
            v = 0.0
        found.append(np.array(out))
    return found[0], found[1]


def run_sections(x: np.ndarray, sections: np.ndarray, steady: bool = False) -> np.ndarray:
    """Second-order sections one after another; ``steady`` starts as if x[0] had gone on for ever."""
    level = float(x[0]) if steady and len(x) else 0.0
    for section in sections.tolist():
        response, before = section_responses(*section)
        x = convolve(x, response[: max(1, len(x))])
        if level:
            k = min(len(x), len(before))
            x[:k] += level * before[:k]
        b0, b1, b2, a1, a2 = section
        level *= (b0 + b1 + b2) / (1 + a1 + a2)
    return x


def zero_phase_lowpass(x: np.ndarray, cutoff: float, order: int = 2) -> np.ndarray:
    """Forwards and backwards, with an odd extension of 9 samples."""
    pad = 9
    sections = lowpass_sections(order, cutoff)
    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    wide = run_sections(wide, sections, True)
    return run_sections(wide[::-1], sections, True)[::-1][pad:-pad]


def prosodic_envelope(x: np.ndarray, sample_rate: int = SAMPLE_RATE, window_ms: float = 20.0, cutoff_hz: float = 4.0) -> np.ndarray:
    """Slow loudness contour in [0, 1], a value per full window."""
    hop = int(sample_rate * window_ms / 1000)
    n = len(x) // hop
    rms = np.sqrt((x[: n * hop].reshape(n, hop).astype(float) ** 2).mean(axis=1))
    if n > 12:
        rms = zero_phase_lowpass(rms, cutoff_hz / (sample_rate / hop / 2))
    rms = np.maximum(rms, 0)
    return rms / rms.max() if n and rms.max() > 0 else rms


def prosodic_modulation(scores: np.ndarray, times: np.ndarray, x: np.ndarray, sample_rate: int = SAMPLE_RATE, floor: float = 0.5) -> np.ndarray:
    envelope = prosodic_envelope(x, sample_rate)
    if not len(envelope):
        return scores
    at = np.interp(times, 0.02 * np.arange(len(envelope)), envelope)
    return np.clip(scores * (floor + (1 - floor) * at), 0, 1)


def click_frames(energy: np.ndarray, width: int, threshold: float, floored: bool = False) -> np.ndarray:
    """Frames far above the running median of full windows; a median of 1e-10 or less counts as 1e-10 if ``floored``, else it has no clicks."""
    half, found = width // 2, np.zeros(len(energy), bool)
    if len(energy) > 2 * half:
        median = np.median(np.lib.stride_tricks.sliding_window_view(energy, 2 * half + 1), axis=1)
        inner = energy[half : len(energy) - half]
        found[half : len(energy) - half] = (floored | (median > 1e-10)) & (inner > threshold * np.maximum(median, 1e-10))
    return found


def declick(
    x: np.ndarray, sample_rate: int = SAMPLE_RATE, frame_ms: float = 2, median_ms: float = 40, threshold: float = 5, attenuation: float = 0.5, fade_ms: float = 2
) -> np.ndarray:
    """Turn down frames that stand out, with ramps before and after."""
    size, fade = max(1, int(sample_rate * frame_ms / 1000)), max(1, int(sample_rate * fade_ms / 1000))
    n = len(x) // size
    if n < 5:
        return x
    energy = (x[: n * size].reshape(n, size).astype(np.float32) ** 2).mean(axis=1, dtype=np.float32)
    clicks = np.flatnonzero(click_frames(energy, max(3, int(median_ms / frame_ms)) | 1, threshold))
    if not len(clicks):
        return x
    gain = np.ones(len(x))
    for c in clicks:
        gain[c * size : (c + 1) * size] = np.minimum(gain[c * size : (c + 1) * size], attenuation)
        a = max(0, c * size - fade)
        gain[a : c * size] = np.minimum(gain[a : c * size], np.linspace(1, attenuation, fade)[fade - (c * size - a) :])
        b = min(n * size, (c + 1) * size + fade)
        gain[(c + 1) * size : b] = np.minimum(gain[(c + 1) * size : b], np.linspace(attenuation, 1, fade)[: b - (c + 1) * size])
    return x * gain


def spectral_clicks(x: np.ndarray, sample_rate: int = SAMPLE_RATE, frame_ms: float = 2, median_ms: float = 50, threshold: float = 4, low_hz: float = 300) -> int:
    """Frames whose broadband or low-band spectral energy stands out."""
    size = max(1, int(sample_rate * frame_ms / 1000))
    n = len(x) // size
    if n < 5:
        return 0
    power = np.abs(np.fft.rfft(x[: n * size].reshape(n, size), axis=1)) ** 2
    low = power[:, np.fft.rfftfreq(size, 1 / sample_rate) <= low_hz].mean(axis=1)
    width = max(3, int(median_ms / frame_ms)) | 1
    return int((click_frames(power.mean(axis=1), width, threshold, True) | click_frames(low, width, threshold, True)).sum())


def match_tilt(reference: np.ndarray, x: np.ndarray, n_fft: int = 2048, max_db: float = 4.5) -> np.ndarray:
    """Bring the average spectrum of ``x`` towards the reference's, within ``max_db``."""
    hop, window = n_fft // 2, hann(n_fft)

    def average(s: np.ndarray) -> np.ndarray:
        s = np.pad(s, (0, max(0, n_fft - len(s))))
        count = max(1, (len(s) - n_fft) // hop)
        frames = np.lib.stride_tricks.sliding_window_view(s, n_fft)[: count * hop : hop]
        return np.maximum(np.abs(np.fft.rfft(frames * window, axis=1)).mean(axis=0), 1e-10)

    ratio = average(reference) / (average(x) + 1e-10)
    gain = gaussian(10 ** (np.clip(20 * np.log10(ratio + 1e-10), -max_db, max_db) / 20), 5.0)
    return istft(stft(x, n_fft, hop, cover=True) * gain, n_fft, hop, len(x))


def room_response(sample_rate: int = SAMPLE_RATE, rt60_ms: float = 80) -> np.ndarray:
    """Direct sound, a few early reflections and a fading tail, the highest tap 1; the seeded draws come in this order."""
    n = max(1, int(sample_rate * rt60_ms / 1000))
    draws = np.random.RandomState(ROOM_SEED)
    taps = np.zeros(n)
    taps[0] = 1
    for strength in FIRST_REFLECTION * REFLECTION_FALL ** np.arange(REFLECTIONS):
        at = int(sample_rate * (1 + draws.uniform(1, 15)) / 1000)
        if at < n:
            taps[at] += strength * draws.choice([-1, 1])
    taps += TAIL_LEVEL * np.exp(-TAIL_DECAY * np.arange(n) / sample_rate / (rt60_ms / 1000)) * draws.randn(n)
    return taps / np.abs(taps).max()


def room(x: np.ndarray, sample_rate: int = SAMPLE_RATE, rt60_ms: float = 80) -> np.ndarray:
    """A short seeded room, then the peak as before."""
    wet = convolve(x, room_response(sample_rate, rt60_ms))
    return wet * ((np.abs(x).max(initial=0) + 1e-10) / (np.abs(wet).max(initial=0) + 1e-10))


def warm_noise(n: int, sample_rate: int = SAMPLE_RATE) -> np.ndarray:
    """Low-passed noise for ``n`` samples, seeded by their number."""
    return run_sections(np.random.RandomState(n % (1 << 32)).randn(n), lowpass_sections(3, 1500 / (sample_rate / 2)))


def warm_dither(x: np.ndarray, sample_rate: int = SAMPLE_RATE, level_db: float = -60) -> np.ndarray:
    noise = warm_noise(len(x), sample_rate)
    return x + noise * (10 ** (level_db / 20) / (noise.std() + 1e-10)) if len(x) else x


def soft_clip(x: np.ndarray, target: float) -> np.ndarray:
    """Peaks above 0.8 tamed, the RMS brought to ``target``, the peak held at 0.99."""
    size = np.abs(x)
    peak = size.max(initial=0)
    y = np.where(size > 0.8, np.sign(x) * (0.8 + np.tanh((size - 0.8) / (peak - 0.8 + 1e-10)) * 0.2), x) if peak > 0.8 else x
    rms, high = float(np.sqrt((y * y).mean())) if len(y) else 0.0, np.abs(y).max(initial=0)
    scale = target / rms if rms > 0 and target > 0 else 1.0
    return y * (0.99 / high if high * scale > 0.99 else scale)


def post_process(
    x: np.ndarray, sample_rate: int = SAMPLE_RATE, clicks: bool = True, with_room: bool = True, dither: bool = True,
    threshold: float = 5, rt60_ms: float = 80, level_db: float = -60,
) -> np.ndarray:
    if clicks:
        x = declick(x, sample_rate, threshold=threshold)
    if with_room:
        x = room(x, sample_rate, rt60_ms)
    return warm_dither(x, sample_rate, level_db) if dither else x


#: Windows whose common frames are sorted once.
SHARED_WINDOWS = 16


def lower_half_means(wide: np.ndarray, half: int) -> np.ndarray:
    """Mean of the ``half + 1`` smallest values of each column in every window of ``2 * half + 1`` rows.

    Windows that follow each other have most rows in common.  Of a number of
    them the common rows are sorted once; the least sum of k values of two
    sorted lists is the least of the sums of j of one and k - j of the other.
    """
    k, n = half + 1, len(wide) - 2 * half
    share = min(SHARED_WINDOWS, half)
    out = np.empty((n, wide.shape[1]))
    for lo in range(0, n, share):
        m = min(share, n - lo)
        core = np.sort(wide[lo + m - 1 : lo + 2 * half + 1], axis=0)[:k]
        sums = np.concatenate([np.zeros((1, wide.shape[1])), np.cumsum(core, axis=0)])
        for i in range(lo, lo + m):
            rest = np.sort(np.concatenate([wide[i : lo + m - 1], wide[lo + 2 * half + 1 : i + 2 * half + 1]]), axis=0)
            least = sums[k].copy() if len(sums) > k else np.full(wide.shape[1], np.inf)
            for j, taken in enumerate(np.cumsum(rest, axis=0)[:k], 1):
                if k - j < len(sums):
                    np.minimum(least, taken + sums[k - j], out=least)
            out[i] = least
    return out / k


def gate_gains(magnitude: np.ndarray, floor: np.ndarray, deep: bool) -> np.ndarray:
    """How much of each bin is kept, averaged over three frames; at either end the frame itself stands in for what is beyond."""
    gain = np.clip((magnitude / (floor + 1e-10) - 1) / (10 ** ((9 if deep else 6) / 20) - 1), 0, 1) ** 2
    padded = np.pad(gain, ((1, 1), (0, 0)), mode="edge")
    return (padded[:-2] + padded[1:-1] + padded[2:]) / 3


# Sizes of the gate's spectra, and how many frames its floor follows on either side.
GATE_FFT, GATE_HOP, GATE_REACH = 2048, 512, 94


def floor_reach(n_frames: int) -> int:
    return min(GATE_REACH, max(1, n_frames // 2))


def following_floor(magnitude: np.ndarray, half: int) -> np.ndarray:
    wide = np.pad(magnitude, ((half, half), (0, 0)), mode="reflect" if len(magnitude) > half else "edge")
    return lower_half_means(wide, half)


def spectral_gate(x: np.ndarray, share: float = 0.12, deep: bool = False) -> np.ndarray:
    """Turn down bins near the noise floor.

    The floor is the mean of the quietest ``share`` of the frames; ``deep``
    lets it follow the recording, as the mean of the lower half of the bin's
    values within about two seconds on either side, and takes off more.
    """
    spectrum = stft(x, GATE_FFT, GATE_HOP, cover=True)
    magnitude = np.abs(spectrum)
    if deep:
        floor = following_floor(magnitude, floor_reach(len(magnitude)))
    else:
        quiet = np.argsort((magnitude**2).mean(axis=1), kind="stable")[: max(1, int(share * len(magnitude)))]
        floor = magnitude[quiet].mean(axis=0)
    return istft(spectrum * gate_gains(magnitude, floor, deep), GATE_FFT, GATE_HOP, len(x))


def denoise(x: np.ndarray, method: str | None = "gate") -> np.ndarray:
    """``gate``, ``deep`` or none; source separation needs a model that is not here."""
    if method in (None, "none"):
        return x
    if method not in ("gate", "deep"):
        raise ValueError(f"no such way to take off noise here: {method}")
    return spectral_gate(x, deep=method == "deep") if len(x) else x


def codec_frames(x: np.ndarray, size: int = 1920) -> np.ndarray:
    """Frames of ``size`` samples, the last one filled up with zeros."""
    return np.pad(x, (0, -len(x) % size)).reshape(-1, size)


def fixed_length(x: np.ndarray, n: int, gain_db: float = -3.0, start: int = 0) -> np.ndarray:
    """Peak at ``gain_db``, then ``n`` samples: repeated where too short, else those from ``start``."""
    peak = np.abs(x).max(initial=0)
    x = x / peak * 10 ** (gain_db / 20) if peak > 0 else x
    return np.resize(x, n) if 0 < len(x) < n else np.pad(x, (0, max(0, n - len(x))))[start : start + n]


def smoothed_frames(mel: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian over time, edges reflected without repeat; the width is the odd number at or after 6 sigma."""
    half = (int(6 * sigma + 1) | 1) // 2
    if sigma <= 0 or not half or len(mel) < 2:
        return mel
    weights = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    at = np.abs(np.arange(-half, len(mel) + half))
    at %= 2 * (len(mel) - 1)
    padded = mel[np.minimum(at, 2 * (len(mel) - 1) - at)]
    return np.tensordot(np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1, axis=0), weights / weights.sum(), ([-1], [0]))


def resample_roundtrip(mel: np.ndarray, rate: float, sigma: float = 0.0) -> np.ndarray:
    """Smooth, then down to ``round(T / rate)`` frames and back up, linearly."""
    n = len(mel)
    if not n:
        return mel
    short = max(1, round(n / rate))
    stretch = lambda m, k: np.stack([np.interp(np.linspace(0, len(m) - 1, k), np.arange(len(m)), m[:, j]) for j in range(m.shape[1])], axis=1)
    return stretch(stretch(smoothed_frames(mel, sigma), short), n)


def random_resample_roundtrip(mel: np.ndarray, seed: int, low: float = 1.5, high: float = 5.0, sigma: float = 2.0) -> np.ndarray:
    return resample_roundtrip(mel, np.random.default_rng(seed).uniform(low, high), sigma)


def array_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all values of an array column, where each row's begin and the last ends); a null row has none."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float), np.r_[0, np.cumsum(lengths)]


def array_column(rows: list[np.ndarray]) -> pa.Array:
    bounds = np.r_[0, np.cumsum([len(x) for x in rows])].astype(np.int32)
    return pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(rows) if rows else np.zeros(0), pa.float64()))


def per_recording(recordings: DataFrame, step: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Apply ``step`` to the samples of each (recording_id, samples) row; no samples, null included, stay none."""
    kind = recordings.schema["recording_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at = array_values(batch.column("samples"))
            out, begun, held = [], 0, 0
            for i in range(batch.num_rows):
                x = values[at[i] : at[i + 1]]
                out.append(np.asarray(step(x) if len(x) else x, float))
                held += len(out[-1])
                if held >= SAMPLES_AT_A_TIME or i + 1 == batch.num_rows:
                    ids = batch.column("recording_id").slice(begun, len(out))
                    yield pa.RecordBatch.from_arrays([ids, array_column(out)], ["recording_id", "samples"])
                    out, begun, held = [], i + 1, 0

    return recordings.select("recording_id", "samples").mapInArrow(run, f"recording_id {kind}, samples array<double>")
