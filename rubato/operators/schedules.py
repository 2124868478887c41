"""Rate schedules of recordings of any length, block by block.

``rates.rate_schedule`` scales and clips a recording's rates again and again
until they meet a duration.  Scaling and clipping compose to one clamp,
``clip(a * x, lo, hi)``, so three numbers a recording are all that the rounds
change.  What they read of its frames is the sum of ``dt / clip(a * x, lo, hi)``:
frames are added up by narrow buckets of x beforehand, each with its sums of dt
and dt / x, whose quotient stands for the bucket.  A bucket within the clamp or
beyond it counts exactly; one that a bound of the clamp goes through is off by
less than 1e-9 of its share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import MAX_RATE, MIN_RATE
from ..scratch import dealt, written
from .frame_blocks import BLOCK_FRAMES, Block, blocks_of_frames, map_frame_blocks
from .rates import check_speed
from .signal import array_values

#: Buckets of rates of a recording; bounds what its rounds hold.
BUCKETS = 1 << 16
#: Width of the last smoothing, and how far it reaches.
LAST_SIGMA, LAST_REACH = 2.0, 8
STATE = "a double, lo double, hi double, a2 double, lo2 double, hi2 double"


def clamp_to_duration(a: float, lo: float, hi: float, x: np.ndarray, dt: np.ndarray, goal: float, rounds: int, tolerance: float) -> tuple[float, float, float]:
    """The clamp ``clip(a * x, lo, hi)`` after scaling and clipping until the duration is near ``goal``."""
    for _ in range(rounds):
        scale = (dt / np.clip(a * x, lo, hi)).sum() / goal
        if abs(scale - 1) < tolerance:
            break
        a, lo, hi = a * scale, *np.clip([lo * scale, hi * scale], MIN_RATE, MAX_RATE)
    return float(a), float(lo), float(hi)


def contrasted(rates: np.ndarray, gamma: float) -> np.ndarray:
    span = MAX_RATE - MIN_RATE
    return rates if gamma == 1 else np.clip(MIN_RATE + ((rates - MIN_RATE) / span) ** gamma * span, MIN_RATE, MAX_RATE)


def first_clamps(x: np.ndarray, dt: np.ndarray, goal: float, gamma: float) -> tuple[float, ...]:
    """The clamps before and after the contrast."""
    a, lo, hi = clamp_to_duration(float((dt / x).sum() / goal), MIN_RATE, MAX_RATE, x, dt, goal, 20, 1e-3)
    if gamma == 1:
        return a, lo, hi, 1.0, MIN_RATE, MAX_RATE
    return a, lo, hi, *clamp_to_duration(1.0, MIN_RATE, MAX_RATE, contrasted(np.clip(a * x, lo, hi), gamma), dt, goal, 10, 1e-3)


def rates_of(x: np.ndarray, state: dict, gamma: float) -> np.ndarray:
    bent = contrasted(np.clip(state["a"] * x, state["lo"], state["hi"]), gamma)
    return np.clip(state["a2"] * bent, state["lo2"], state["hi2"])


def bucketed(blocks: DataFrame) -> DataFrame:
    """(recording_id, d, g, goal): sums of dt and dt / x by bucket of x, as arrays, and the last time; from arrays x, dt, t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, at), (dt, _), (t, _) = (array_values(batch.column(c)) for c in ("x", "dt", "t"))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(at))
            bucket = np.clip(np.nan_to_num((x - MIN_RATE) / (MAX_RATE - MIN_RATE) * BUCKETS, nan=-1), -1, BUCKETS).astype(np.int64)
            keys, where = np.unique(owner * (BUCKETS + 2) + bucket + 1, return_inverse=True)
            sums = [np.bincount(where, v, len(keys)) for v in (dt, dt / x)]
            last = np.full(batch.num_rows, -np.inf)
            np.maximum.at(last, owner, t)
            owner, bucket = np.divmod(keys, BUCKETS + 2)
            yield pa.RecordBatch.from_arrays([batch.column("recording_id").take(pa.array(owner)), pa.array(bucket), *map(pa.array, sums), pa.array(last[owner])], ["recording_id", "bucket", "d", "g", "last"])

    kind = blocks.schema["recording_id"].dataType.simpleString()
    parts = blocks.select("recording_id", "x", "dt", "t").mapInArrow(run, f"recording_id {kind}, bucket long, d double, g double, last double")
    sums = parts.groupBy("recording_id", "bucket").agg(F.sum("d").alias("d"), F.sum("g").alias("g"), F.max("last").alias("last"))
    rows = F.sort_array(F.collect_list(F.struct("bucket", "d", "g")))
    return dealt(sums, "recording_id").groupBy("recording_id").agg(rows.alias("r"), F.max("last").alias("last")).select("recording_id", F.col("r.d").alias("d"), F.col("r.g").alias("g"), "last")


def clamps(sums: DataFrame, speed: float, find, schema: str) -> DataFrame:
    """(recording_id, ``schema``): what ``find`` (x, dt, goal) gives for each recording; nulls where its times span nothing."""
    kind = sums.schema["recording_id"].dataType.simpleString()
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (d, at), (g, _) = (array_values(batch.column(c)) for c in ("d", "g"))
            found = []
            for i, last in enumerate(batch.column("last").to_pylist()):
                dt, own = d[at[i] : at[i + 1]], g[at[i] : at[i + 1]]
                here = dt != 0
                x = np.divide(dt, own, out=np.ones(len(dt)), where=here)
                found.append(find(x[here], dt[here], last / speed) if last else (None,) * len(names))
            yield pa.RecordBatch.from_arrays([batch.column("recording_id"), *(pa.array(c, pa.float64()) for c in zip(*found, strict=True))] if found else [batch.column("recording_id"), *(pa.array([], pa.float64()) for _ in names)], ["recording_id", *names])

    return sums.mapInArrow(run, f"recording_id {kind}, {schema}")


def schedule_long(scores: DataFrame, speed: float, sigma: float = 15.0, rise: float = 0.3, gamma: float = 1.5, block: int = BLOCK_FRAMES) -> DataFrame:
    """(recording_id, frame_idx, t, rate) from (recording_id, frame_idx, t, score): ``rates.rate_schedule`` of every recording.

    ``frame_idx`` runs from 0 without gaps.  No task holds more than some
    blocks of frames, and of a whole recording at most ``BUCKETS`` pairs of
    sums and a row a block.  A null score makes the recording's rates NaN, as a
    NaN does; a recording of one frame, or whose times span nothing, is not
    smoothed or has the constant ``speed``.  Repeated rows are not allowed.
    """
    check_speed(speed)
    reach = int(4 * sigma + 0.5) + LAST_REACH
    rows = scores.select("recording_id", "frame_idx", F.col("t").cast("double").alias("t"), F.coalesce(F.col("score").cast("double"), F.lit(float("nan"))).alias("score"))
    base = blocks_of_frames(rows, ["t", "score"], reach, reach, block)

    def raw_rates(b: Block, _: dict) -> dict[str, np.ndarray]:
        """Rates, times and steps of the own frames and ``LAST_REACH`` on either side, as far as there are any."""
        importance, t = np.clip(b.columns["score"], 0, 1), b.columns["t"]
        smooth, at = (importance, 0)
        if sigma > 0 and (len(importance) > 1):
            smooth, at = b.smoothed(importance, sigma)
            smooth = np.clip(smooth, 0, 1)
        lo, hi = max(0, b.own.start - LAST_REACH), min(len(t), b.own.stop + LAST_REACH)
        x = MIN_RATE + (1 - smooth[lo - at : hi - at]) * (MAX_RATE - MIN_RATE)
        dt = np.diff(t, prepend=t[0] if not b.at_start else 0.0)[lo:hi]
        ends = np.array([b.first + lo, b.own.start - lo, b.own.stop - b.own.start, b.at_start, b.at_end])
        return {"near": x, "x": x[b.own.start - lo : b.own.stop - lo], "dt": dt[b.own.start - lo : b.own.stop - lo], "t": t[b.own], "ends": ends}

    raw = written(map_frame_blocks(base, ["t", "score"], reach, block, raw_rates, "near x dt t ends"), "schedule-raw")
    first = clamps(bucketed(raw), speed, lambda x, dt, goal: first_clamps(x, dt, goal, gamma), STATE)
    known = raw.join(written(first, "schedule-clamps"), "recording_id")
    names = [c.split()[0] for c in STATE.split(", ")]

    def lowest(x: np.ndarray, state: dict, start: int, own: slice) -> tuple[float, float]:
        """Least rate above the ramp of the own frames, and of those but the last ``LAST_REACH``."""
        above = rates_of(x, state, gamma)[own] - rise * (start + own.start + np.arange(own.stop - own.start))
        return above.min(), above[: max(0, len(above) - LAST_REACH)].min(initial=np.inf)

    lows = _per_block(known, names, lambda x, ends, state: np.array(lowest(x, state, int(ends[0]), slice(int(ends[1]), int(ends[1] + ends[2])))), "low")
    own = Window.partitionBy("recording_id").orderBy("block_idx")
    before = F.min(F.get("low", F.lit(0))).over(own.rowsBetween(Window.unboundedPreceding, -2))
    carried = lows.select("recording_id", "block_idx", F.coalesce(F.least(before, F.lag(F.get("low", F.lit(1))).over(own)), F.lit(float("inf"))).alias("carry"))

    def eased(x: np.ndarray, ends: np.ndarray, state: dict) -> np.ndarray:
        start, lead, n, at_start, at_end = (int(v) for v in ends)
        if state["a"] is None:
            return np.full(n, float(speed))
        ramp = rise * (start + np.arange(len(x)))
        limited = np.minimum.accumulate(np.minimum(rates_of(x, state, gamma) - ramp, state["carry"])) + ramp
        if at_start and at_end and len(x) <= 4:
            return limited[lead : lead + n]
        smooth, at = Block(0, start, {}, slice(lead, lead + n), bool(at_start), bool(at_end)).smoothed(limited, LAST_SIGMA)
        return np.clip(smooth[lead - at : lead - at + n], MIN_RATE, MAX_RATE)

    last = _per_block(known.join(carried, ["recording_id", "block_idx"]), [*names, "carry"], eased, "x", ("dt", "t", "block_idx"))
    last = written(last, "schedule-eased")
    end = clamps(bucketed(last), speed, lambda x, dt, goal: clamp_to_duration(1.0, MIN_RATE, MAX_RATE, x, dt, goal, 10, 2e-3), "a double, lo double, hi double")
    # the blocks may hold constant recordings too, whose clamp is null
    done = last.join(end, "recording_id").select("recording_id", (F.col("block_idx") * block).alias("_at"), F.posexplode(F.arrays_zip("t", "x")).alias("p", "r"), "a", "lo", "hi")
    scaled = F.greatest("lo", F.least(F.col("a") * F.col("r.x"), F.col("hi")))
    rate = F.when(F.col("a").isNull() | F.isnan("r.x"), F.col("r.x")).when((F.col("a") == 1) & (F.col("lo") == MIN_RATE) & (F.col("hi") == MAX_RATE), F.col("r.x")).otherwise(scaled)
    return done.select("recording_id", (F.col("_at") + F.col("p")).cast("int").alias("frame_idx"), F.col("r.t").alias("t"), rate.alias("rate"))


def _per_block(blocks: DataFrame, state: list[str], step, out: str, keep: tuple[str, ...] = ("block_idx",)) -> DataFrame:
    """``keep`` and the array column ``out`` of ``step(near, ends, state)``; a null state gives an infinite one."""
    kinds = {c: blocks.schema[c].dataType.simpleString() for c in ("recording_id", *keep)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .signal import array_column

        for batch in batches:
            (x, at), (ends, where) = (array_values(batch.column(c)) for c in ("near", "ends"))
            rows = zip(*(batch.column(c).to_pylist() for c in state), strict=True)
            found = []
            for i, row in enumerate(rows):
                values = dict(zip(state, row, strict=True))
                if out == "low" and values["a"] is None:
                    found.append(np.full(2, np.inf))
                else:
                    found.append(step(x[at[i] : at[i + 1]], ends[where[i] : where[i + 1]], values))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kinds), array_column(found)], [*kinds, out])

    schema = ", ".join([*(f"{c} {k}" for c, k in kinds.items()), f"{out} array<double>"])
    return blocks.select(*kinds, "near", "ends", *state).mapInArrow(run, schema)
