"""Spectra, gates, filters and finishing of long recordings, block by block.

A recording comes as blocks (recording_id, block_idx, start_sample, samples) of
``block`` samples each but the last, which may be shorter, as in ``chunks``.
Each form here gives what its namesake in ``signal`` gives for the whole
recording; no task holds more than some blocks and their halos.  Where a whole
recording matters, its blocks are summed up and the sums joined back.  A
recording without samples has no blocks and gives no rows; NaNs spread to what
depends on them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import dealt, written
from .chunks import declick_blocks, over_blocks, room_blocks
from .frame_blocks import near_windows
from .rates import gaussian
from .signal import (
    GATE_FFT,
    GATE_HOP,
    GATE_REACH,
    HOP,
    N_FFT,
    N_MELS,
    SAMPLE_RATE,
    array_column,
    array_values,
    floor_reach,
    following_floor,
    gate_gains,
    hann,
    lowpass_sections,
    mel_filters,
)
from .windows import is_click


def frame_count(n: int, hop: int) -> int:
    """Frames of a recording of ``n`` samples reflected by half a window at both ends."""
    return 1 + n // hop


def reflected(x: np.ndarray, half: int, at_start: bool, at_end: bool) -> np.ndarray:
    """``half`` more samples at an end of the recording, its own in reverse without the last; zeros where it is too short."""
    if at_start and at_end and len(x) <= half:
        return np.pad(x, half)
    return np.concatenate([x[half:0:-1] if at_start else x[:0], x, x[-2 : -half - 2 : -1] if at_end else x[:0]])


def frames_within(x: np.ndarray, a: int, z: int, start: int, n_fft: int, hop: int) -> tuple[int, np.ndarray]:
    """(index of the first, windows) of the frames that are centred in a block; the halo is half a window on either side."""
    half, n = n_fft // 2, len(x) - a - z
    at_start, at_end = a == 0, z < half
    wide = reflected(x, half, at_start, at_end)
    base = start - a - (half if at_start else 0)  # place of wide[0]
    first = -(-start // hop)
    last = (start + n) // hop if at_end and z == 0 else (start + n - 1) // hop
    if last < first:
        return first, np.zeros((0, n_fft))
    views = np.lib.stride_tricks.sliding_window_view(wide, n_fft)
    return first, views[first * hop - half - base : last * hop - half - base + 1 : hop]


def mel_frames(blocks: DataFrame, block: int, sample_rate: int = SAMPLE_RATE, n_fft: int = N_FFT, hop: int = HOP, n_mels: int = N_MELS, alone: bool = False) -> DataFrame:
    """(recording_id, frame_idx, mel): ``signal.extract_mel`` as a row a frame; ``block`` is at least half a window.

    ``alone``: every recording is one block, so none has neighbours to read from.
    """
    check_block(block, n_fft // 2 + 1)
    filters, window = mel_filters(sample_rate, n_fft, n_mels).T, hann(n_fft)

    def step(x: np.ndarray, a: int, z: int, start: int) -> tuple[int, int, np.ndarray]:
        first, frames = frames_within(x, a, z, start, n_fft, hop)
        mel = np.log(np.maximum(np.abs(np.fft.rfft(frames * window, axis=1)) @ filters, 1e-5))
        return first, len(frames), mel.ravel()

    halo = 0 if alone else n_fft // 2
    rows = over_blocks(blocks, halo, halo, step, "first long, n long, mel array<double>").where("n > 0")
    i = F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("i")
    return rows.select("recording_id", "first", "mel", i).select("recording_id", (F.col("first") + F.col("i")).cast("int").alias("frame_idx"), F.slice("mel", F.col("i") * n_mels + 1, n_mels).alias("mel"))


def check_block(block: int, least: int) -> None:
    if block < least:
        raise ValueError(f"a block has to have at least {least} samples")


def mean_spectra(blocks: DataFrame, block: int, n_fft: int = 2048) -> DataFrame:
    """(recording_id, spectrum): mean magnitudes of frames half a window apart, the last whole one left out, as an array.

    A recording of fewer samples than for two frames has one, filled up with zeros.
    """
    hop, window = n_fft // 2, hann(n_fft)
    check_block(block, n_fft + hop)

    def step(x: np.ndarray, a: int, z: int, start: int) -> tuple[int, np.ndarray]:
        own = np.arange(-(-start // hop) * hop, start + len(x) - z, hop) - start
        own = own[own + hop + n_fft <= len(x)]
        if not len(own) and start == 0:
            x, own = np.pad(x, (0, max(0, n_fft - len(x)))), np.zeros(1, np.int64)
        if not len(own):
            return 0, np.zeros(hop + 1)
        frames = np.lib.stride_tricks.sliding_window_view(x, n_fft)[own]
        return len(own), np.abs(np.fft.rfft(frames * window, axis=1)).sum(axis=0)

    parts = over_blocks(blocks, 0, n_fft + hop, step, "n long, s array<double>")
    bins = parts.select("recording_id", "n", F.posexplode("s").alias("bin", "s")).groupBy("recording_id", "bin").agg((F.sum("s") / F.sum("n")).alias("mean"))
    rows = F.sort_array(F.collect_list(F.struct("bin", "mean")))  # a recording's bins, as many as half a window
    return bins.groupBy("recording_id").agg(rows.alias("r")).select("recording_id", F.transform("r.mean", lambda v: F.greatest(v, F.lit(1e-10))).alias("spectrum"))


def tilt_gains(reference: DataFrame, spectra: DataFrame, max_db: float = 4.5) -> DataFrame:
    """(recording_id, gain) from two tables (recording_id, spectrum): their ratio within ``max_db``, smoothed over the bins."""
    kind = spectra.schema["recording_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (want, at), (have, _) = (array_values(batch.column(c)) for c in ("want", "spectrum"))
            gains = []
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                db = 20 * np.log10(want[lo:hi] / (have[lo:hi] + 1e-10) + 1e-10)
                gains.append(gaussian(10 ** (np.clip(db, -max_db, max_db) / 20), 5.0))
            yield pa.RecordBatch.from_arrays([batch.column("recording_id"), array_column(gains)], ["recording_id", "gain"])

    both = spectra.join(reference.withColumnRenamed("spectrum", "want"), "recording_id").select("recording_id", "want", "spectrum")
    return both.mapInArrow(run, f"recording_id {kind}, gain array<double>")


def resynthesised(x: np.ndarray, a: int, z: int, start: int, n_fft: int, hop: int, change, margin: int = 0) -> np.ndarray:
    """A block's own samples after ``change`` (spectra, index of the first frame) of the frames that reach into it, overlapped and added.

    ``change`` gets ``margin`` more frames on either side, as far as there are
    any.  The halo is a window and ``margin`` hops on either side.  Frames go on
    until one is centred at or past the recording's end; what they reach beyond
    its reflection is zero.
    """
    half, n = n_fft // 2, len(x) - a - z
    at_start, at_end = a == 0, z < n_fft + margin * hop
    wide = reflected(x, half, at_start, at_end)
    base = start - a - (half if at_start else 0)
    first = max(0, -(-(start - half + 1) // hop) - margin)
    last = (start + n - 1 + half) // hop + margin
    if at_end:
        last = min(last, -(-(start + n + z) // hop))
    lo = first * hop - half - base
    need = lo + (last - first) * hop + n_fft
    wide = np.pad(wide, (max(0, -lo), max(0, need - len(wide))))
    lo = max(0, lo)
    window = hann(n_fft)
    frames = np.lib.stride_tricks.sliding_window_view(wide, n_fft)[lo : lo + (last - first) * hop + 1 : hop]
    out = np.fft.irfft(change(np.fft.rfft(frames * window, axis=1), first), n_fft, axis=1) * window
    size = (last - first) * hop + n_fft
    total, norm = np.zeros(size), np.zeros(size)
    square = window**2
    for k in range(len(out)):
        total[k * hop : k * hop + n_fft] += out[k]
        norm[k * hop : k * hop + n_fft] += square
    own = slice(start - (first * hop - half), start - (first * hop - half) + n)
    found = (total / np.maximum(norm, 1e-8))[own]
    return np.pad(found, (0, n - len(found)))


def match_tilt(reference: DataFrame, blocks: DataFrame, block: int, n_fft: int = 2048, max_db: float = 4.5) -> DataFrame:
    """``signal.match_tilt``: blocks whose recording's mean spectrum is brought towards that of ``reference``'s blocks.

    Two passes: sums of spectra by recording, then each block with its
    recording's gains.  A recording without a reference stays as it is.
    """
    gains = tilt_gains(mean_spectra(reference, block, n_fft), mean_spectra(blocks, block, n_fft), max_db)

    def step(x: np.ndarray, a: int, z: int, start: int, gain: list | None) -> tuple[np.ndarray]:
        own = x[a : len(x) - z]
        return (own if gain is None else resynthesised(x, a, z, start, n_fft, n_fft // 2, lambda s, _: s * np.array(gain)),)

    return over_blocks(blocks.join(gains, "recording_id", "left"), n_fft, n_fft, step, "samples array<double>", ("gain",))


def covering_frames(x: np.ndarray, a: int, z: int, start: int) -> tuple[int, np.ndarray]:
    """(index of the first, magnitudes) of the gate's frames that are centred in a block, and past the last sample in the last one."""
    n_fft, hop = GATE_FFT, GATE_HOP
    half, n = n_fft // 2, len(x) - a - z
    at_start, at_end = a == 0, z < half
    wide = reflected(x, half, at_start, at_end)
    base = start - a - (half if at_start else 0)
    first = -(-start // hop)
    last = -(-(start + n) // hop) if at_end and z == 0 else (start + n - 1) // hop
    if last < first:
        return first, np.zeros((0, half + 1))
    lo = first * hop - half - base
    wide = np.pad(wide, (0, max(0, lo + (last - first) * hop + n_fft - len(wide))))
    frames = np.lib.stride_tricks.sliding_window_view(wide, n_fft)[lo : lo + (last - first) * hop + 1 : hop]
    return first, np.abs(np.fft.rfft(frames * hann(n_fft), axis=1))


def quietest(powers: DataFrame, share: float) -> DataFrame:
    """(recording_id, k, power, frame_idx): the k-th quietest frame, ties by place, of max(1, int(share * frames)).

    Found without sorting a recording: frames are counted by narrow ranges of
    their power, the running count tells in which range the k-th lies, and only
    that one is numbered.
    """
    placed = powers.withColumn("_range", F.coalesce(F.floor(F.log2("power") * 64), F.lit(-(1 << 40))))
    counts = placed.groupBy("recording_id", "_range").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("recording_id")
    upto = F.sum("n").over(whole.orderBy("_range"))
    k = F.greatest(F.lit(1), F.floor(F.sum("n").over(whole) * share)).cast("long")
    edge = counts.select("recording_id", "_range", k.alias("k"), upto.alias("upto"), (upto - F.col("n")).alias("before")).where("before < k and k <= upto")
    place = F.row_number().over(Window.partitionBy("recording_id").orderBy("power", "frame_idx")) + F.col("before")
    met = placed.join(edge.drop("upto"), ["recording_id", "_range"]).withColumn("place", place)
    return met.where("place = k").select("recording_id", "k", "power", "frame_idx")


def spectral_gate(blocks: DataFrame, block: int, share: float = 0.12, deep: bool = False) -> DataFrame:
    """``signal.spectral_gate``: bins near the noise floor are turned down.

    Three passes over the blocks: the powers of all frames, the mean spectrum of
    the quietest ``share`` of them, and the gate.  The deep floor follows the
    recording, so it takes one pass with a longer halo.  ``block`` is at least
    the halo, ``gate_halo(deep)``.
    """
    check_block(block, gate_halo(deep))
    half = GATE_FFT // 2
    if deep:
        sizes = blocks.groupBy("recording_id").agg(F.sum(F.size("samples")).alias("total"))

        def follow(x: np.ndarray, a: int, z: int, start: int, total: int) -> tuple[np.ndarray]:
            n_frames = -(-total // GATE_HOP) + 1
            reach = floor_reach(n_frames)

            def change(spectrum: np.ndarray, first: int) -> np.ndarray:
                magnitude = np.abs(spectrum)
                return spectrum * gate_gains(magnitude, following_floor(magnitude, reach), True)

            return (resynthesised(x, a, z, start, GATE_FFT, GATE_HOP, change, GATE_REACH + 1),)

        return over_blocks(blocks.join(sizes, "recording_id"), gate_halo(True), gate_halo(True), follow, "samples array<double>", ("total",))

    def powers(x: np.ndarray, a: int, z: int, start: int) -> tuple[int, np.ndarray]:
        first, magnitude = covering_frames(x, a, z, start)
        return first, (magnitude**2).mean(axis=1)

    rows = over_blocks(blocks, half, half, powers, "first long, power array<double>").select("recording_id", "first", F.posexplode("power").alias("p", "power"))
    powers_of_frames = written(rows.select("recording_id", (F.col("first") + F.col("p")).alias("frame_idx"), "power"), "frame-powers")
    edges = written(quietest(powers_of_frames, share), "quiet-frames")

    def quiet(x: np.ndarray, a: int, z: int, start: int, power: float, frame_idx: int) -> tuple[np.ndarray]:
        first, magnitude = covering_frames(x, a, z, start)
        own = (magnitude**2).mean(axis=1)
        chosen = (own < power) | ((own == power) & (first + np.arange(len(own)) <= frame_idx))
        return (magnitude[chosen].sum(axis=0),)

    sums = over_blocks(blocks.join(edges, "recording_id"), half, half, quiet, "s array<double>", ("power", "frame_idx"))
    bins = sums.select("recording_id", F.posexplode("s").alias("bin", "s")).groupBy("recording_id", "bin").agg(F.sum("s").alias("s"))
    ordered = F.sort_array(F.collect_list(F.struct("bin", "s")))  # a recording's bins, as many as half a window
    floors = bins.groupBy("recording_id").agg(ordered.alias("r")).join(edges.select("recording_id", "k"), "recording_id").select("recording_id", F.transform("r.s", lambda v: v / F.col("k")).alias("floor"))

    def gate(x: np.ndarray, a: int, z: int, start: int, floor: list) -> tuple[np.ndarray]:
        level = np.array(floor)
        return (resynthesised(x, a, z, start, GATE_FFT, GATE_HOP, lambda s, _: s * gate_gains(np.abs(s), level, False), 1),)

    return over_blocks(blocks.join(floors, "recording_id"), gate_halo(False), gate_halo(False), gate, "samples array<double>", ("floor",))


def gate_halo(deep: bool) -> int:
    """Samples that the gate reads on either side of a block."""
    return GATE_FFT + (GATE_REACH + 1 if deep else 1) * GATE_HOP


def check_method(method: str | None) -> None:
    if method not in (None, "none", "gate", "deep"):
        raise ValueError(f"no such way to take off noise here: {method}")


def denoise(blocks: DataFrame, block: int, method: str | None = "gate") -> DataFrame:
    """``gate``, ``deep`` or none; source separation needs a model that is not here."""
    check_method(method)
    if method in (None, "none"):
        return blocks
    return spectral_gate(blocks, block, deep=method == "deep")


def spectral_click_counts(blocks: DataFrame, block: int, sample_rate: int = SAMPLE_RATE, frame_ms: float = 2, median_ms: float = 50, threshold: float = 4, low_hz: float = 300) -> DataFrame:
    """(recording_id, n_clicks): ``signal.spectral_clicks``; ``block`` is a whole number of frames of ``frame_ms``."""
    size = max(1, int(sample_rate * frame_ms / 1000))
    if block % size:
        raise ValueError(f"a block has to be whole frames of {size} samples")
    low = np.fft.rfftfreq(size, 1 / sample_rate) <= low_hz
    width = max(3, int(median_ms / frame_ms)) | 1

    def step(x: np.ndarray, a: int, z: int, start: int) -> tuple[int, np.ndarray, np.ndarray]:
        power = np.abs(np.fft.rfft(x[: len(x) // size * size].reshape(-1, size), axis=1)) ** 2
        return start // size, power.mean(axis=1), power[:, low].mean(axis=1)

    parts = over_blocks(blocks, 0, 0, step, "first long, wide array<double>, low array<double>")
    frames = parts.select("recording_id", "first", F.posexplode(F.arrays_zip("wide", "low")).alias("p", "e")).select("recording_id", (F.col("first") + F.col("p")).alias("frame_idx"), "e.*")
    floored = lambda c: F.greatest(F.col(c), F.lit(0.0))
    clicks = {c: (lambda o, c=c: is_click(floored(c), width, threshold, floor=1e-10, own=o)) for c in ("wide", "low")}
    flagged = near_windows(frames.withColumns({"_wide": F.col("wide"), "_low": F.col("low")}), width // 2, {f"click_{c}": make for c, make in clicks.items()})
    counted = flagged.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("click_wide") | F.col("click_low")).alias("c"))
    ids = blocks.select("recording_id").distinct()
    return ids.join(counted, "recording_id", "left").select("recording_id", F.when(F.col("n") >= 5, F.col("c")).otherwise(0).cast("long").alias("n_clicks"))


def noise_states(lengths: DataFrame, block: int, sample_rate: int = SAMPLE_RATE) -> DataFrame:
    """(n_samples, block_idx, state, n, total, square) of (n_samples): where the draws and filters of ``signal.warm_noise`` stand when a block begins, and its sums.

    Recordings of one length have the same noise, so its draws, which come one
    after another, are made once a length.  A state takes 3 KB, null for the
    first block; the block's own task draws its noise again from there.
    """
    sections = lowpass_sections(3, 1500 / (sample_rate / 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in batch.column("n_samples").to_pylist():
                for rows in _some_at_a_time(states_of(n)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["n_samples", "block_idx", "state", "n", "total", "square"])

    def states_of(n: int) -> Iterator[tuple]:
        draws, states = first_noise(n, len(sections))
        for k, lo in enumerate(range(0, n, block)):
            begun = packed_noise(draws, states) if k else None
            x = noise_from(draws, states, sections, min(block, n - lo))
            yield n, k, begun, len(x), x.sum(), (x * x).sum()

    # lengths come from a grouping; one more key keeps the deal, which would pass for that grouping's and be put together
    own = dealt(lengths.select(F.col("n_samples").cast("long").alias("n_samples")).withColumn("_deal", F.hash("n_samples")), "_deal", "n_samples").select("n_samples")
    return own.mapInArrow(run, "n_samples long, block_idx int, state binary, n long, total double, square double")


def _some_at_a_time(rows: Iterator[tuple], n: int = 256) -> Iterator[list[tuple]]:
    while found := list(islice(rows, n)):
        yield found


def first_noise(n: int, sections: int) -> tuple[np.random.RandomState, list[np.ndarray]]:
    return np.random.RandomState(n % (1 << 32)), [np.zeros(2) for _ in range(sections)]


def noise_from(draws: np.random.RandomState, states: list[np.ndarray], sections: np.ndarray, n: int) -> np.ndarray:
    """The next ``n`` values; ``draws`` and ``states`` go on."""
    x = draws.randn(n)
    for s, section in enumerate(sections):
        x, states[s] = run_section(x, section, states[s])
    return x


def packed_noise(draws: np.random.RandomState, states: list[np.ndarray]) -> bytes:
    _, keys, *rest = draws.get_state()
    return keys.astype("<u4").tobytes() + np.array([*rest, *np.concatenate(states)], "<f8").tobytes()


def unpacked_noise(state: bytes) -> tuple[np.random.RandomState, list[np.ndarray]]:
    draws, rest = np.random.RandomState(0), np.frombuffer(state, "<f8", offset=624 * 4)
    draws.set_state(("MT19937", np.frombuffer(state, "<u4", 624), int(rest[0]), int(rest[1]), float(rest[2])))
    return draws, list(rest[3:].reshape(-1, 2))


def run_section(x: np.ndarray, section: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a second-order section's output from a state on, the state after it).

    The output is the convolution with the section's answer to a single 1, and
    what the state adds; the state after ``x`` follows from its last values.
    """
    from .signal import convolve, section_responses

    if not len(x):
        return x, state
    b0, b1, b2, a1, a2 = section
    response, _ = section_responses(*section.tolist())
    y = convolve(x, response[: len(x)])
    ring = ringing(float(a1), float(a2))[: len(x)]
    y[: len(ring)] += ring @ state
    # in transposed form: z2 = b2 x - a2 y, z1 = b1 x - a1 y + the z2 before
    z2 = b2 * x[-1] - a2 * y[-1]
    before = b2 * x[-2] - a2 * y[-2] if len(x) > 1 else state[1]
    return y, np.array([b1 * x[-1] - a1 * y[-1] + before, z2])


@lru_cache(64)
def ringing(a1: float, a2: float) -> np.ndarray:
    """(values, 2): what each number of a state adds to the outputs that follow, until it has died away."""
    state, out = np.eye(2), []
    while np.abs(state).max() > 1e-19:
        out.append(state[0])
        state = np.stack([state[1] - a1 * state[0], -a2 * state[0]])
    return np.array(out).reshape(-1, 2)


def dithered(blocks: DataFrame, block: int, sample_rate: int = SAMPLE_RATE, level_db: float = -60, like: DataFrame | None = None) -> DataFrame:
    """``signal.warm_dither``: low-passed noise, seeded by the number of samples, at ``level_db``.

    ``like`` are blocks of the same sizes that are cheaper to have.  Noise is
    made where it is added; what is joined is where it stands.
    """
    sizes = written((blocks if like is None else like).groupBy("recording_id").agg(F.sum(F.size("samples")).alias("n_samples")), "sizes")
    states = written(noise_states(sizes.select("n_samples").distinct(), block, sample_rate), "noise-states")
    own = states.groupBy("n_samples").agg(F.sum("n").alias("n"), F.sum("total").alias("t"), F.sum("square").alias("q"))
    mean = F.col("t") / F.col("n")
    level = (F.lit(10 ** (level_db / 20)) / (F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)) + 1e-10)).alias("level")
    known = states.select("n_samples", "block_idx", "state").join(own.select("n_samples", level), "n_samples")
    met = blocks.withColumn("block_idx", F.col("block_idx").cast("int")).join(sizes, "recording_id").join(known, ["n_samples", "block_idx"])
    sections = lowpass_sections(3, 1500 / (sample_rate / 2))

    def step(x: np.ndarray, a: int, z: int, start: int, n: int, state: bytes | None, level: float) -> tuple[np.ndarray]:
        draws, states = first_noise(n, len(sections)) if state is None else unpacked_noise(state)
        return (x + noise_from(draws, states, sections, len(x)) * level,)

    return over_blocks(met, 0, 0, step, "samples array<double>", ("n_samples", "state", "level"))


def post_process(
    blocks: DataFrame, block: int, sample_rate: int = SAMPLE_RATE, clicks: bool = True, with_room: bool = True, dither: bool = True,
    threshold: float = 5, rt60_ms: float = 80, level_db: float = -60,
) -> DataFrame:
    """``signal.post_process``: clicks turned down, a short room, and warm noise, each if wanted."""
    raw = blocks
    if clicks:
        blocks = declick_blocks(blocks, block, sample_rate, threshold)
    if with_room:
        blocks = room_blocks(blocks, block, sample_rate, rt60_ms)
    return dithered(blocks, block, sample_rate, level_db, raw) if dither else blocks


def soft_clip(blocks: DataFrame, targets: DataFrame) -> DataFrame:
    """``windows.soft_clip`` of blocks, with a target RMS of each recording from (recording_id, target).

    Three sums of a recording are joined back: its peak, and after the clipping
    its mean square and peak.
    """
    of = lambda f: F.transform("samples", f)
    peaks = blocks.groupBy("recording_id").agg(F.max(F.array_max(of(F.abs))).alias("_peak"))

    def clip(x):
        over = F.signum(x) * (0.8 + F.tanh((F.abs(x) - 0.8) / (F.col("_peak") - 0.8 + 1e-10)) * 0.2)
        return F.when((F.col("_peak") > 0.8) & (F.abs(x) > 0.8), over).otherwise(x)

    clipped = blocks.join(peaks, "recording_id").withColumn("samples", of(clip)).drop("_peak")
    square = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v * v)
    sums = clipped.groupBy("recording_id").agg(F.sqrt(F.sum(square) / F.sum(F.size("samples"))).alias("rms"), F.max(F.array_max(of(F.abs))).alias("high")).join(targets, "recording_id")
    scale = F.when((F.col("rms") > 0) & (F.col("target") > 0), F.col("target") / F.col("rms")).otherwise(F.lit(1.0))
    held = F.when(F.col("high") * scale > 0.99, 0.99 / F.col("high")).otherwise(scale)
    return clipped.join(sums.select("recording_id", held.alias("_scale")), "recording_id").withColumn("samples", of(lambda v: v * F.col("_scale"))).drop("_scale")


def prosodic_frames(blocks: DataFrame, block: int, sample_rate: int = SAMPLE_RATE, window_ms: float = 20.0) -> DataFrame:
    """(recording_id, frame_idx, rms) of every full window; ``block`` is a whole number of them."""
    hop = int(sample_rate * window_ms / 1000)
    if block % hop:
        raise ValueError(f"a block has to be whole windows of {hop} samples")

    def step(x: np.ndarray, a: int, z: int, start: int) -> tuple[int, np.ndarray]:
        return start // hop, np.sqrt((x[: len(x) // hop * hop].reshape(-1, hop) ** 2).mean(axis=1))

    rows = over_blocks(blocks, 0, 0, step, "first long, rms array<double>")
    return rows.select("recording_id", "first", F.posexplode("rms").alias("p", "rms")).select("recording_id", (F.col("first") + F.col("p")).cast("int").alias("frame_idx"), "rms")


def prosodic_envelope(blocks: DataFrame, block: int, sample_rate: int = SAMPLE_RATE, window_ms: float = 20.0, cutoff_hz: float = 4.0) -> DataFrame:
    """(recording_id, frame_idx, t, value): ``signal.prosodic_envelope``, a slow loudness contour in [0, 1]."""
    from .recurrences import zero_phase

    frames = written(prosodic_frames(blocks, block, sample_rate, window_ms), "loudness")
    hop = int(sample_rate * window_ms / 1000)
    slow = zero_phase(frames, "rms", lowpass_sections(2, cutoff_hz / (sample_rate / hop / 2)))
    held = written(slow.withColumn("rms", F.greatest("rms", F.lit(0.0))), "contour")
    most = held.groupBy("recording_id").agg(F.max("rms").alias("most"))
    share = F.when(F.col("most") > 0, F.col("rms") / F.col("most")).otherwise(F.col("rms"))
    return held.join(most, "recording_id").select("recording_id", "frame_idx", (F.col("frame_idx") * (window_ms / 1000)).alias("t"), share.alias("value"))


def prosodic_modulation(scores: DataFrame, envelope: DataFrame, floor: float = 0.5, width: float = 60.0) -> DataFrame:
    """``scores`` (recording_id, frame_idx, t, score), lowered where the loudness contour is low, clipped to [0, 1].

    A recording without a contour keeps its scores.
    """
    from .frame_blocks import interpolated

    at = interpolated(envelope, scores, width).select("recording_id", "frame_idx", F.col("value").alias("_at"))
    met = scores.join(at, ["recording_id", "frame_idx"], "left")
    changed = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") * (floor + (1 - floor) * F.col("_at"))))
    return met.withColumn("score", F.when(F.col("_at").isNull(), F.col("score")).otherwise(changed)).drop("_at")
