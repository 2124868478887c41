"""Linear recurrences over frames, block by block.

A recurrence of order k maps its state, k numbers, through a block of n frames
to ``A**n @ state + v``, where v is what the block's own values leave in a
state that was zero.  Such maps compose, so the states at the beginning of all
blocks of a recording follow from a row a block; then each block runs on its
own.  A filter that runs forwards and backwards does so twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .frame_blocks import BLOCK_FRAMES, blocks_of_frames
from .signal import array_column, array_values
from .signal_blocks import run_section

#: Frames that a zero-phase filter adds at either end.
EXTENSION = 9
#: Recordings of no more frames than this are left as they are by a zero-phase filter.
UNFILTERED = 12


def transition(section: np.ndarray) -> np.ndarray:
    """The state's map over a frame without a value of its own, in transposed form."""
    _, _, _, a1, a2 = section
    return np.array([[-a1, 1.0], [-a2, 0.0]])


def steady_state(section: np.ndarray, x: float) -> np.ndarray:
    """The state as if ``x`` had gone on for ever."""
    b0, b1, b2, a1, a2 = section
    y = x * (b0 + b1 + b2) / (1 + a1 + a2)
    return np.array([y - b0 * x, b2 * x - a2 * y])


def carried_states(blocks: DataFrame, section: np.ndarray, backwards: bool) -> DataFrame:
    """(recording_id, block_idx, state): the state at which each block begins; from (recording_id, block_idx, n, v, begin).

    ``begin`` is the state at the recording's first block in the order, and is
    taken from there; ``v`` and n are the block's.  A row a block is all that a
    recording's group holds.
    """
    kind = blocks.schema["recording_id"].dataType.simpleString()
    rows = F.sort_array(F.collect_list(F.struct("block_idx", "n", F.get("v", F.lit(0)).alias("v0"), F.get("v", F.lit(1)).alias("v1"), F.get("begin", F.lit(0)).alias("s0"), F.get("begin", F.lit(1)).alias("s1"))), not backwards)
    step = transition(section)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, v0, v1, s0, s1 = (array_values(batch.column(c))[0] for c in ("n", "v0", "v1", "s0", "s1"))
            at = array_values(batch.column("n"))[1]
            powers: dict[int, np.ndarray] = {}
            states = []
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                state, own = np.array([s0[lo], s1[lo]]), []
                for i in range(lo, hi):
                    own.append(state)
                    k = int(n[i])
                    if k not in powers:
                        powers[k] = np.linalg.matrix_power(step, k)
                    state = powers[k] @ state + (v0[i], v1[i])
                states.append(np.concatenate(own))
            yield pa.RecordBatch.from_arrays([batch.column("recording_id"), batch.column("block_idx"), array_column(states)], ["recording_id", "block_idx", "states"])

    grouped = blocks.groupBy("recording_id").agg(rows.alias("r")).select("recording_id", F.transform("r.block_idx", lambda b: b.cast("long")).alias("block_idx"), *[F.transform(f"r.{c}", lambda v: v.cast("double")).alias(c) for c in ("n", "v0", "v1", "s0", "s1")])
    done = grouped.mapInArrow(run, f"recording_id {kind}, block_idx array<long>, states array<double>")
    each = done.select("recording_id", "states", F.posexplode("block_idx").alias("i", "block_idx"))
    return each.select("recording_id", "block_idx", F.slice("states", F.col("i") * 2 + 1, 2).alias("state"))


def _over(blocks: DataFrame, arrays: tuple[str, ...], scalars: tuple[str, ...], step, out: tuple[str, ...], keep: tuple[str, ...]) -> DataFrame:
    """``keep`` and the arrays ``out`` of ``step(arrays, scalars)`` for every block."""
    kinds = {c: blocks.schema[c].dataType.simpleString() for c in keep}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [array_values(batch.column(c)) for c in arrays]
            plain = [batch.column(c).to_pylist() for c in scalars]
            found = [step(*(x[at[i] : at[i + 1]] for x, at in values), *(p[i] for p in plain)) for i in range(batch.num_rows)]
            columns = zip(*found, strict=True) if found else [[] for _ in out]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(array_column(list(c)) for c in columns)], [*keep, *out])

    needed = dict.fromkeys([*keep, *arrays, *scalars])
    return blocks.select(*needed).mapInArrow(run, ", ".join([*(f"{c} {k}" for c, k in kinds.items()), *(f"{c} array<double>" for c in out)]))


def filtered(frames: DataFrame, column: str, section: np.ndarray, steady: bool = False, block: int = BLOCK_FRAMES) -> DataFrame:
    """``frames`` (recording_id, frame_idx, ``column``) after a second-order section b0 b1 b2 a1 a2, from rest or as if the first value had gone on for ever."""
    ids = ("recording_id", "block_idx")
    base = blocks_of_frames(frames, [column], 0, 0, block)
    begins = lambda x: steady_state(section, x[0]) if steady else np.zeros(2)
    sums = _over(base, (column,), (), lambda x: (run_section(x, section, np.zeros(2))[1], begins(x)), ("v", "begin"), (*ids, "n"))
    met = base.join(carried_states(sums, section, False), [*ids])
    done = _over(met, (column, "state"), (), lambda x, s: (run_section(x, section, s)[0],), (column,), ids)
    rows = done.select("recording_id", "block_idx", F.posexplode(column).alias("p", column))
    return rows.select("recording_id", (F.col("block_idx") * block + F.col("p")).cast("int").alias("frame_idx"), column)


def zero_phase(frames: DataFrame, column: str, sections: np.ndarray, block: int = BLOCK_FRAMES) -> DataFrame:
    """``frames`` (recording_id, frame_idx, ``column``) filtered forwards and backwards by one second-order section.

    As ``signal.zero_phase_lowpass``: the ends are extended by ``EXTENSION``
    frames turned around them, and either run begins as if its first value had
    gone on for ever.  Recordings of ``UNFILTERED`` frames or fewer stay as they
    are.
    """
    if len(sections) != 1:
        raise ValueError("one second-order section")
    section, e, ids = sections[0], EXTENSION, ("recording_id", "block_idx")
    base = blocks_of_frames(frames, [column], e + 1, 1, block).withColumn("whole", F.size(column) - F.col("n"))
    sized = base.join(frames.groupBy("recording_id").agg(F.count(F.lit(1)).alias("total")), "recording_id").withColumn("last", (F.col("block_idx") + 1) * block >= F.col("total"))

    def own(x: np.ndarray, index: int, first: int, n: int) -> tuple[np.ndarray, int]:
        lo = index * block - first
        return x[lo : lo + n], lo

    def entering(x: np.ndarray, index: int, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        mine, _ = own(x, index, first, n)
        begin = np.zeros(2)
        if index == 0 and n > e:
            before = 2 * mine[0] - mine[e:0:-1]
            begin = run_section(before, section, steady_state(section, before[0]))[1]
        return run_section(mine, section, np.zeros(2))[1], begin

    sums = _over(sized, (column,), ("block_idx", "first", "n"), entering, ("v", "begin"), (*ids, "n"))
    forwards = sized.join(carried_states(sums, section, False), [*ids])

    def ahead(x: np.ndarray, state: np.ndarray, index: int, first: int, n: int, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mine, lo = own(x, index, first, n)
        y, left = run_section(mine, section, state)
        begin = np.zeros(2)
        if last and lo + n > e:
            upto = x[: lo + n]
            after = run_section(2 * upto[-1] - upto[-2 : -e - 2 : -1], section, left)[0][::-1]
            begin = run_section(after, section, steady_state(section, after[0]))[1]
        return y, run_section(y[::-1], section, np.zeros(2))[1], begin

    there = written(_over(forwards, (column, "state"), ("block_idx", "first", "n", "last"), ahead, ("y", "v", "begin"), (*ids, "n", "total", column, "first")), "forwards")
    back = there.join(carried_states(there.select(*ids, "n", "v", "begin"), section, True), [*ids])

    def home(y: np.ndarray, state: np.ndarray, x: np.ndarray, index: int, first: int, n: int, total: int) -> tuple[np.ndarray]:
        return (own(x, index, first, n)[0] if total <= UNFILTERED else run_section(y[::-1], section, state)[0][::-1],)

    done = _over(back, ("y", "state", column), ("block_idx", "first", "n", "total"), home, ("out",), ids)
    rows = done.select("recording_id", "block_idx", F.posexplode("out").alias("p", column))
    return rows.select("recording_id", (F.col("block_idx") * block + F.col("p")).cast("int").alias("frame_idx"), column)
