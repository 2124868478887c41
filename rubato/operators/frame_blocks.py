"""Frames of long recordings in blocks, so that one recording is spread over many tasks.

A block holds ``block`` frames that follow each other, and some of its
neighbours' on either side, which are lent to it as rows before the one shuffle
that puts blocks together.  What runs through a whole recording, such as a sum
or a minimum, is scanned in two levels: each block on its own, the summaries of
the blocks, and the blocks again with what comes before them.  ``frame_idx``
runs from 0 without gaps in every recording.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.kernels import gaussian_weights
from ..scratch import dealt
from .signal import array_column, array_values

BLOCK_FRAMES = 4096


def lent(frames: DataFrame, before: int, after: int, block: int) -> DataFrame:
    """``frames`` with ``block_idx``: every row in its own block, and again in a neighbour that it lies within reach of."""
    if max(before, after) > block:
        raise ValueError("a block has to be as long as what is lent to it")
    i = F.col("frame_idx").cast("long")
    own, at = F.floor(i / block), i % block
    blocks = F.array(own, F.when(at >= block - before, own + 1), F.when((at < after) & (own > 0), own - 1))
    return frames.withColumn("block_idx", F.explode(F.filter(blocks, lambda b: b.isNotNull()))).withColumn("_own", F.col("block_idx") == own)


def in_block() -> WindowSpec:
    return Window.partitionBy("recording_id", "block_idx").orderBy("frame_idx")


def near_windows(frames: DataFrame, reach: int, columns: dict[str, Callable[[WindowSpec], Column]], block: int = BLOCK_FRAMES) -> DataFrame:
    """``frames`` and columns over windows that reach at most ``reach`` rows to either side.

    Each of ``columns`` takes the ordered window of a block, and gives what it
    would over the whole recording.
    """
    w = in_block()
    found = lent(frames, reach, reach, block).select("*", *[make(w).alias(name) for name, make in columns.items()])
    return found.where("_own").select(*frames.columns, *columns)


@dataclass(frozen=True)
class Scan:
    """A running ``sum``, ``min``, ``max`` or ``last`` (that is not null) of a column."""

    kind: str
    column: Column

    def over(self, w: WindowSpec) -> Column:
        makers = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
        return makers[self.kind](self.column).over(w)

    def of_block(self, order: str) -> Column:
        if self.kind == "last":
            return F.max_by(F.when(self.column.isNotNull(), self.column), F.when(self.column.isNotNull(), F.col(order)))
        return {"sum": F.sum, "min": F.min, "max": F.max}[self.kind](self.column)

    def joined(self, before: Column, own: Column) -> Column:
        """What comes before a block and what its own rows have so far; either may be null."""
        if self.kind == "last":
            return F.coalesce(own, before)
        both = {"sum": before + own, "min": F.least(before, own), "max": F.greatest(before, own)}[self.kind]
        return F.when(before.isNull(), own).when(own.isNull(), before).otherwise(both)


def scanned(frames: DataFrame, scans: dict[str, Scan], block: int = BLOCK_FRAMES, keys: tuple[str, ...] = ("recording_id",), order: str = "frame_idx", place: Column | None = None) -> DataFrame:
    """``frames`` with running values in order, each row included, in two levels.

    The blocks are those of ``place``, a whole number that grows with the order
    (by default ``block`` frames each).  A key's summaries, a row a block, are
    all of it that meets in one task.
    """
    rows = frames.withColumn("_block", F.floor(F.col(order) / block) if place is None else place)
    summaries = rows.groupBy(*keys, "_block").agg(*[s.of_block(order).alias(f"_{n}") for n, s in scans.items()])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = summaries.select(*keys, "_block", *[Scan(s.kind, F.col(f"_{n}")).over(earlier).alias(f"_{n}") for n, s in scans.items()])
    own = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    met = rows.join(carried, [*keys, "_block"])
    return met.select(*frames.columns, *[s.joined(F.col(f"_{n}"), s.over(own)).alias(n) for n, s in scans.items()])


def numbered(rows: DataFrame, key: str, order: list[str], place: Column) -> DataFrame:
    """``rows`` with ``frame_idx`` from 0 by ``order`` within ``key``, in two levels; ``place`` is a whole number that grows with the order."""
    placed = rows.withColumn("_block", place)
    counts = placed.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = placed.join(counts.select(key, "_block", before.alias("_before")), [key, "_block"])
    own = F.row_number().over(Window.partitionBy(key, "_block").orderBy(*order)) - 1
    return met.select(*rows.columns, (F.col("_before") + own).cast("int").alias("frame_idx"))


def slew_limited(frames: DataFrame, x: str, rise: float = 0.3, block: int = BLOCK_FRAMES) -> DataFrame:
    """``frames`` with ``limited``: ``y[i] = min(x[i], y[i-1] + rise)``, a running minimum of what is left above a ramp."""
    ramp = F.col("frame_idx") * rise
    found = scanned(frames, {"limited": Scan("min", F.col(x) - ramp)}, block)
    return found.withColumn("limited", F.col("limited") + ramp)


def interpolated(knots: DataFrame, queries: DataFrame, width: float, value: str = "value") -> DataFrame:
    """As ``joins.interpolate_at``, in two levels: knots and queries meet in buckets of ``width`` seconds.

    A query's knot before it is the last of its own bucket so far, or of the
    buckets before; likewise after it, from the other end.
    """
    k = knots.select("recording_id", "t", F.col(value).cast("double").alias("k"), F.lit(None).cast("int").alias("frame_idx"), F.lit(0).alias("side"))
    q = queries.select("recording_id", "t", F.lit(None).cast("double").alias("k"), F.col("frame_idx").cast("int").alias("frame_idx"), F.lit(1).alias("side"))
    both = k.unionByName(q)
    knot = F.when(F.col("side") == 0, F.struct("t", "k"))
    order = F.struct("t", "side", "k", "frame_idx")
    place = F.floor(F.col("t") / width)
    summaries = both.groupBy("recording_id", place.alias("_block")).agg(F.max_by(knot, F.when(F.col("side") == 0, order)).alias("_b"), F.min_by(knot, F.when(F.col("side") == 0, order)).alias("_a"))
    blocks = Window.partitionBy("recording_id").orderBy("_block")
    backwards = Window.partitionBy("recording_id").orderBy(F.col("_block").desc())
    earlier = lambda c, w: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    # of knots at one time the last counts from either side, and they share a bucket
    carried = summaries.select("recording_id", "_block", earlier("_b", blocks).alias("_b"), earlier("_a", backwards).alias("_a"))
    met = both.withColumn("_block", place).join(carried, ["recording_id", "_block"])
    columns = [F.col(c) for c in ("t", "side", "k", "frame_idx")]
    own = Window.partitionBy("recording_id", "_block")
    so_far = lambda w: F.last(knot, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    found = met.select("*", so_far(own.orderBy(*[c.asc() for c in columns])).alias("b"), so_far(own.orderBy(*[c.desc() for c in columns])).alias("a")).where("side = 1")
    b, a = F.coalesce("b", "_b"), F.coalesce("a", "_a")
    blend = b["k"] + (a["k"] - b["k"]) * ((F.col("t") - b["t"]) / (a["t"] - b["t"]))
    return found.select("recording_id", "frame_idx", "t", F.when(b.isNull(), a["k"]).when(a.isNull() | (a["t"] <= b["t"]), b["k"]).otherwise(blend).alias(value))


@dataclass
class Block:
    """A block's frames with what is lent to it; its own are ``own``, and beyond ``lo`` and ``hi`` the recording ends if so marked."""

    index: int
    first: int  # frame_idx of the first frame here
    columns: dict[str, np.ndarray]
    own: slice
    at_start: bool
    at_end: bool
    held: int = 0  # frames here, lent ones included

    def smoothed(self, x: np.ndarray, sigma: float) -> tuple[np.ndarray, int]:
        """(Gaussian filter of ``x`` wherever the block holds all that it reaches, place of the first value); ends are reflected with repeat."""
        weights = np.array(gaussian_weights(sigma))
        r, n = len(weights) // 2, len(x)
        if self.at_start and self.at_end:
            m = np.arange(-r, n + r) % (2 * n)
            padded = x[np.where(m < n, m, 2 * n - 1 - m)]
        else:
            padded = np.concatenate([x[:r][::-1] if self.at_start else x[:0], x, x[n - r :][::-1] if self.at_end else x[:0]])
        at = 0 if self.at_start else r
        if x.ndim == 1:
            return np.convolve(padded, weights, "valid"), at
        return np.stack([np.convolve(padded[:, k], weights, "valid") for k in range(x.shape[1])], axis=1), at


def blocks_of_frames(frames: DataFrame, columns: list[str], before: int, after: int, block: int = BLOCK_FRAMES) -> DataFrame:
    """(recording_id, block_idx, first, n, held, and arrays of ``columns``): a row a block, with ``before`` and ``after`` frames lent to it.

    A column of arrays becomes one array, a frame's after another's.
    """
    rows = dealt(lent(frames.select("recording_id", "frame_idx", *columns), before, after, block), "recording_id", "block_idx")
    order = F.sort_array(F.collect_list(F.struct("frame_idx", *columns)))
    values = lambda c: F.transform(F.flatten(f"r.{c}") if isinstance(frames.schema[c].dataType, ArrayType) else f"r.{c}", lambda v: v.cast("double"))
    grouped = rows.groupBy("recording_id", "block_idx").agg(order.alias("r"), F.count_if("_own").alias("n")).where("n > 0")
    return grouped.select("recording_id", "block_idx", F.get("r.frame_idx", F.lit(0)).cast("long").alias("first"), F.col("n").cast("long").alias("n"), F.size("r").alias("held"), *[values(c).alias(c) for c in columns])


def map_frame_blocks(blocks: DataFrame, columns: list[str], after: int, block: int, step: Callable[[Block, dict], dict[str, np.ndarray]], out: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(recording_id, block_idx, and the array columns ``out``) of ``step(block, values of the columns keep)`` for every block.

    ``out`` names the arrays that ``step`` gives, each of doubles.
    """
    kind = blocks.schema["recording_id"].dataType.simpleString()
    names = out.split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = {c: array_values(batch.column(c)) for c in columns}
            kept = [dict(zip(keep, row, strict=True)) for row in zip(*(batch.column(c).to_pylist() for c in keep), strict=True)] if keep else [{}] * batch.num_rows
            found: dict[str, list] = {c: [] for c in names}
            places = (batch.column(c).to_pylist() for c in ("block_idx", "first", "n"))
            lengths = batch.column("held").to_pylist()
            for i, (index, first, n) in enumerate(zip(*places, strict=True)):
                own = {c: values[at[i] : at[i + 1]] for c, (values, at) in arrays.items()}
                lo = index * block - first
                held = lengths[i]
                result = step(Block(index, first, own, slice(lo, lo + n), index == 0, held - lo - n < after or n < block, held), kept[i])
                for c in names:
                    found[c].append(np.asarray(result[c], float))
            yield pa.RecordBatch.from_arrays([batch.column("recording_id"), batch.column("block_idx"), *(array_column(found[c]) for c in names)], ["recording_id", "block_idx", *names])

    schema = ", ".join([f"recording_id {kind}", "block_idx long", *(f"{c} array<double>" for c in names)])
    return blocks.select("recording_id", "block_idx", "first", "n", "held", *columns, *keep).mapInArrow(run, schema)
