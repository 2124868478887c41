"""Chunk plans, rate curves within chunks, chunked processing, cross-fades and overlap-add.

A recording may come as blocks (recording_id, block_idx, start_sample, samples)
of ``block`` samples each but the last, and goes out as blocks again; no row
holds more than a chunk, and no task a whole recording.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import by_key, dealt
from .joins import interpolate_at
from .signal import array_column, array_values, convolve, declick, room_response


def plan_chunks(recordings: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Chunks of (recording_id, n_samples), each reaching ``overlap`` samples into its neighbours.

    A recording no longer than a chunk, also an empty one, is one chunk.  While
    another chunk follows, the overlap after is what lies beyond this one's
    share, never less than 0.
    """
    n = F.col("n_samples")
    starts = F.when(n <= chunk, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(chunk).cast("long")))
    rows = recordings.select("recording_id", "n_samples", F.posexplode(starts).alias("index", "pos"))
    start, end = F.greatest(F.lit(0).cast("long"), F.col("pos") - overlap), F.least(F.col("pos") + chunk + overlap, n)
    follows = F.col("pos") + chunk < n
    return rows.select(
        "recording_id", "index", start.alias("start_sample"), end.alias("end_sample"), (F.col("pos") - start).alias("overlap_before"),
        F.when(follows, F.greatest(F.lit(0).cast("long"), end - (F.col("pos") + chunk))).otherwise(F.lit(0).cast("long")).alias("overlap_after"),
    )


def points_in_chunks(chunks: DataFrame, rates: DataFrame, sample_rate: float, chunk: int) -> DataFrame:
    """Rate points within each chunk, both ends included, times shifted to its start.

    A chunk is exploded to the cells of ``chunk`` samples that it reaches, and
    one more on either side against rounding, which makes the range join an
    equi-join on (recording_id, cell) for any overlap.
    """
    cell = lambda samples: F.floor(samples / chunk)
    near = chunks.withColumn("_cell", F.explode(F.sequence(cell(F.col("start_sample")) - 1, cell(F.col("end_sample")) + 1)))
    points = rates.select("recording_id", "t", "rate", cell(F.col("t") * sample_rate).alias("_cell"))
    start, end = F.col("start_sample") / sample_rate, F.col("end_sample") / sample_rate
    met = by_key(near).join(points, ["recording_id", "_cell"]).where((F.col("t") >= start) & (F.col("t") <= end))
    return met.select("recording_id", "index", (F.col("t") - start).alias("t"), "rate")


def rates_in_chunks(chunks: DataFrame, rates: DataFrame, sample_rate: float, chunk: int) -> DataFrame:
    """Rate curve of every chunk: its points, or where it has none the rate at its middle, at 0 and at its length."""
    met = points_in_chunks(chunks, rates, sample_rate, chunk)
    empty = chunks.join(by_key(met.select("recording_id", "index").distinct()), ["recording_id", "index"], "left_anti")
    start, end = F.col("start_sample") / sample_rate, F.col("end_sample") / sample_rate
    middles = empty.select("recording_id", F.col("index").alias("frame_idx"), ((start + end) / 2).alias("t"))
    found = interpolate_at(rates, middles, "rate").select("recording_id", F.col("frame_idx").alias("index"), "rate")
    ends = empty.select("recording_id", "index", F.explode(F.array(F.lit(0.0), end - start)).alias("t"))
    return met.unionByName(by_key(ends).join(by_key(found), ["recording_id", "index"]))


def overlap_add(frames: DataFrame, hop: int, window: Column | None = None) -> DataFrame:
    """(recording_id, sample_idx, value) from (recording_id, frame_idx, samples).

    Frames lie ``hop`` samples apart and are weighed by ``window``, an array as
    long as a frame (ones by default), twice: before and after, so sums are
    divided by those of its squares, 1e-8 at least.  The sum combines before
    the shuffle.
    """
    w = window if window is not None else F.transform("samples", lambda v: F.lit(1.0))
    rows = frames.select("recording_id", "frame_idx", F.posexplode(F.zip_with("samples", w, lambda s, x: F.struct((s * x).alias("v"), (x * x).alias("w")))).alias("p", "s"))
    out = rows.groupBy("recording_id", (F.col("frame_idx") * hop + F.col("p")).alias("sample_idx"))
    return out.agg((F.sum("s.v") / F.greatest(F.sum("s.w"), F.lit(1e-8))).alias("value"))


def crossfade_concat(parts: DataFrame) -> DataFrame:
    """Join (recording_id, index, samples, fade_in, fade_out) parts to one signal.

    A part's first ``fade_in`` samples blend with the previous part's last
    ones, fading linearly; ``fade_out`` is how many of a part's samples the
    next one blends with.  (recording_id, sample_idx, value).
    """
    w = Window.partitionBy("recording_id").orderBy("index")
    size = F.size("samples")
    offset = F.coalesce(F.sum(size - F.col("fade_out")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parts.withColumn("_at", offset).select("recording_id", "_at", "fade_in", "fade_out", size.alias("n"), F.posexplode("samples").alias("p", "v"))
    rise = F.when(F.col("p") < F.col("fade_in"), F.when(F.col("fade_in") > 1, F.col("p") / (F.col("fade_in") - 1)).otherwise(0.0)).otherwise(1.0)
    q = F.col("p") - (F.col("n") - F.col("fade_out"))
    fall = F.when(q >= 0, F.when(F.col("fade_out") > 1, 1 - q / (F.col("fade_out") - 1)).otherwise(1.0)).otherwise(1.0)
    return placed.groupBy("recording_id", (F.col("_at") + F.col("p")).alias("sample_idx")).agg(F.sum(F.col("v") * rise * fall).alias("value"))


def fade_plan(parts: DataFrame) -> DataFrame:
    """(recording_id, index, n, blend, offset, drop, next_blend) from (recording_id, index, n, fade_in, fade_out).

    A part loses its last ``fade_out`` samples (``drop``) and blends its first
    ``fade_in`` ones (``blend``) with the last of what the part before has
    left, or fewer where either is shorter; ``offset`` is where it begins in
    the output.  One row of small numbers per part is all that a recording's
    group holds.
    """
    metas = F.sort_array(F.collect_list(F.struct("index", F.col("n").cast("long").alias("n"), F.col("fade_in").cast("long").alias("a"), F.col("fade_out").cast("long").alias("z"))))
    kind = "struct<rows:array<struct<index:int,n:bigint,blend:bigint,offset:bigint,drop:bigint>>,left:bigint,end:bigint>"
    start = F.struct(F.array().alias("rows"), F.lit(0).alias("left"), F.lit(0).alias("end")).cast(kind)

    def step(state: Column, part: Column) -> Column:
        first = F.size(state["rows"]) == 0
        blend = F.when(first, F.lit(0)).otherwise(F.least(part["a"], state["left"], part["n"]))
        left = F.greatest(F.lit(0), part["n"] - part["z"] - blend)
        row = F.struct(part["index"].cast("int").alias("index"), part["n"].alias("n"), blend.alias("blend"), (state["end"] - blend).alias("offset"), part["z"].alias("drop"))
        return F.struct(F.concat(state["rows"], F.array(row)).alias("rows"), left.alias("left"), (state["end"] + left).alias("end")).cast(kind)

    plan = parts.groupBy("recording_id").agg(F.aggregate(metas, start, step).alias("s")).select("recording_id", F.explode("s.rows").alias("r")).select("recording_id", "r.*")
    after = F.lead("blend").over(Window.partitionBy("recording_id").orderBy("index"))
    return plan.withColumn("next_blend", F.coalesce(after, F.lit(0)))


def merge_parts(parts: DataFrame) -> DataFrame:
    """Join (recording_id, index, samples, fade_in, fade_out) parts, trimmed and cross-faded, to blocks of one signal.

    A block is a part's own share: it begins with what it blends with the part
    before and ends where the next one's blend begins.  Parts without a share
    are left out; a null array counts as empty.
    """
    own = parts.select("recording_id", F.col("index").cast("int").alias("index"), F.coalesce("samples", F.array().cast("array<double>")).alias("samples"), "fade_in", "fade_out")
    plan = fade_plan(own.select("recording_id", "index", F.size("samples").alias("n"), "fade_in", "fade_out"))
    placed = own.select("recording_id", "index", "samples").join(plan, ["recording_id", "index"])
    # what is left of a part begins after its blend; its last next_blend samples go to the next part
    body = F.slice("samples", (F.col("blend") + 1).cast("int"), F.greatest(F.lit(0), F.col("n") - F.col("drop") - F.col("blend")).cast("int"))
    cut = placed.withColumn("body", body)
    keep = (F.size("body") - F.col("next_blend")).cast("int")
    tails = cut.where("next_blend > 0").select("recording_id", (F.col("index") + 1).alias("index"), F.slice("body", keep + 1, F.col("next_blend").cast("int")).alias("tail"))
    met = cut.join(tails, ["recording_id", "index"], "left")
    share = lambda i: F.when(F.col("blend") > 1, i / (F.col("blend") - 1)).otherwise(F.lit(0.0))
    head = F.transform(F.slice("samples", F.lit(1), F.col("blend").cast("int")), lambda v, i: v * share(i) + F.get("tail", i) * (1 - share(i)))
    out = met.select("recording_id", "index", F.col("offset").alias("start_sample"), F.concat(F.when(F.col("blend") > 0, head).otherwise(F.array().cast("array<double>")), F.slice("body", F.lit(1), F.greatest(keep, F.lit(0)))).alias("samples"))
    return out.where(F.size("samples") > 0)


def chunk_samples(chunks: DataFrame, blocks: DataFrame, block: int) -> DataFrame:
    """``chunks`` with their samples, an equi-join of the blocks that each reaches."""
    last = F.greatest(F.col("end_sample") - 1, F.col("start_sample"))
    reached = F.sequence(F.floor(F.col("start_sample") / block).cast("int"), F.floor(last / block).cast("int"))
    wanted = chunks.withColumn("block_idx", F.explode(reached))
    met = wanted.join(blocks.select("recording_id", F.col("block_idx").cast("int").alias("block_idx"), F.col("samples").alias("_x")), ["recording_id", "block_idx"], "left")
    at = F.col("block_idx").cast("long") * block
    lo = F.greatest(F.lit(0), F.col("start_sample") - at).cast("int")
    piece = F.slice(F.coalesce("_x", F.array().cast("array<double>")), lo + 1, F.greatest(F.lit(0), F.col("end_sample") - at - lo).cast("int"))
    pieces = met.select(*chunks.columns, F.struct("block_idx", piece.alias("x")).alias("_p")).groupBy(*chunks.columns).agg(F.sort_array(F.collect_list("_p")).alias("_p"))
    return pieces.withColumn("samples", F.flatten(F.transform("_p", lambda p: F.transform(p["x"], lambda v: v.cast("double"))))).drop("_p")


def play_at_rates(x: np.ndarray, times: np.ndarray, rates: np.ndarray, sample_rate: float) -> np.ndarray:
    """The samples read at ``rates`` (0.5 at least) given at ``times``, between samples linearly."""
    if len(x) < 2 or not len(times):
        return x
    at = np.arange(len(x)) / sample_rate
    played = np.cumsum(np.diff(at, prepend=0.0) / np.maximum(np.interp(at, times, rates), 0.5))
    n = max(1, int(played[-1] * sample_rate))
    return np.interp(np.interp(np.linspace(0, played[-1], n), played, np.arange(len(x))), np.arange(len(x)), x)


def process_chunked(
    blocks: DataFrame, speed: float, sample_rate: int, block: int, step: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray],
    chunk_seconds: float = 300.0, overlap_seconds: float = 1.0, rates: DataFrame | None = None,
) -> DataFrame:
    """Work on long recordings chunk by chunk and put the parts together again.

    ``step`` takes a chunk's samples and the times and rates of its curve, from
    ``rates`` (recording_id, t, rate) or ``speed`` throughout, and gives what
    is to be played.  The overlaps in the output are the chunks' over ``speed``.
    An empty recording gives no block.
    """
    if speed <= 0:
        raise ValueError("the speed has to be above 0")
    chunk, overlap = int(chunk_seconds * sample_rate), int(overlap_seconds * sample_rate)
    sizes = blocks.groupBy("recording_id").agg(F.max(F.col("start_sample") + F.size("samples")).cast("long").alias("n_samples"))
    plan = plan_chunks(sizes, chunk, overlap)
    rows = chunk_samples(plan, blocks, block)
    if rates is None:
        length = (F.col("end_sample") - F.col("start_sample")) / sample_rate
        rows = rows.withColumn("times", F.array(F.lit(0.0), length)).withColumn("rates", F.array(F.lit(float(speed)), F.lit(float(speed))))
    else:
        points = rates_in_chunks(plan, rates, sample_rate, chunk).groupBy("recording_id", "index").agg(F.sort_array(F.collect_list(F.struct("t", "rate"))).alias("c"))
        rows = rows.join(points, ["recording_id", "index"], "left").withColumn("times", F.col("c.t")).withColumn("rates", F.col("c.rate"))
    kind = blocks.schema["recording_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ["recording_id", "index", "fade_in", "fade_out"]
        for batch in batches:
            (x, at), (t, t_at), (r, _) = (array_values(batch.column(c)) for c in ("samples", "times", "rates"))
            found, begun, held = [], 0, 0
            for i in range(batch.num_rows):
                own, curve = slice(at[i], at[i + 1]), slice(t_at[i], t_at[i + 1])
                found.append(np.asarray(step(x[own], t[curve], r[curve]), float))
                held += len(found[-1])
                if held >= SAMPLES_AT_A_TIME or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(begun, len(found)) for c in ids), array_column(found)], [*ids, "samples"])
                    found, begun, held = [], i + 1, 0

    fades = [F.floor(F.col(f"overlap_{side}") / speed).cast("long").alias(name) for side, name in (("before", "fade_in"), ("after", "fade_out"))]
    done = rows.select("recording_id", "index", *fades, "samples", "times", "rates").mapInArrow(run, f"recording_id {kind}, index int, fade_in long, fade_out long, samples array<double>")
    return merge_parts(done)


def codec_frames(samples: DataFrame, size: int = 1920) -> DataFrame:
    """(recording_id, frame_idx, sample_idx, value): frames of ``size`` samples, the last one filled up with zeros.

    ``samples`` has recording_id, frame_idx (the sample's place from 0) and
    value, with a row for every place; a null is a zero.
    """
    at = F.col("frame_idx")
    known = samples.select("recording_id", F.floor(at / size).cast("int").alias("frame_idx"), (at % size).cast("int").alias("sample_idx"), "value")
    # only the last frame lacks samples, so only its places are made anew
    last = known.groupBy("recording_id").agg(F.max(F.struct("frame_idx", "sample_idx")).alias("m"))
    spare = last.where(F.col("m.sample_idx") < size - 1).select("recording_id", F.col("m.frame_idx").alias("frame_idx"), F.explode(F.sequence(F.col("m.sample_idx") + 1, F.lit(size - 1))).alias("sample_idx"), F.lit(0.0).alias("value"))
    return known.withColumn("value", F.coalesce("value", F.lit(0.0))).unionByName(spare)


def in_blocks(samples: DataFrame, block: int) -> DataFrame:
    """Blocks of (recording_id, sample_idx, value) rows whose sample_idx runs from 0 without gaps."""
    at = F.floor(F.col("sample_idx") / block).cast("int")
    rows = F.sort_array(F.collect_list(F.struct("sample_idx", "value")))
    grouped = samples.groupBy("recording_id", at.alias("block_idx")).agg(rows.alias("r"))
    return grouped.select("recording_id", "block_idx", (F.col("block_idx").cast("long") * block).alias("start_sample"), F.col("r.value").alias("samples"))


def even_blocks(pieces: DataFrame, block: int) -> DataFrame:
    """Blocks of ``block`` samples each but the last, from pieces (recording_id, start_sample, samples) of any length that cover a recording once."""
    first, last = F.floor(F.col("start_sample") / block), F.floor((F.col("start_sample") + F.size("samples") - 1) / block)
    cut = pieces.where(F.size("samples") > 0).select("recording_id", F.col("start_sample").cast("long").alias("at"), "samples", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("block_idx"))
    lo = F.greatest(F.lit(0), F.col("block_idx").cast("long") * block - F.col("at"))
    hi = F.least(F.size("samples").cast("long"), (F.col("block_idx").cast("long") + 1) * block - F.col("at"))
    piece = F.struct((F.col("at") + lo).alias("at"), F.slice("samples", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("x"))
    rows = cut.select("recording_id", "block_idx", piece.alias("p")).groupBy("recording_id", "block_idx").agg(F.sort_array(F.collect_list("p")).alias("r"))
    return rows.select("recording_id", "block_idx", (F.col("block_idx").cast("long") * block).alias("start_sample"), F.flatten("r.x").alias("samples"))


def samples_of(blocks: DataFrame) -> DataFrame:
    """(recording_id, sample_idx, value) rows of blocks."""
    return blocks.select("recording_id", "start_sample", F.posexplode("samples").alias("p", "value")).select("recording_id", (F.col("start_sample") + F.col("p")).alias("sample_idx"), "value")


def with_halo(blocks: DataFrame, before: int, after: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """``blocks`` with ``left`` and ``right``, the neighbouring blocks' last and first samples, null at the ends.

    A block lends its edges to its neighbours, so the shuffle is by block and
    a long recording is spread like many short ones.  ``before`` and ``after``
    are at most a block; ``keep`` are further columns of the blocks.
    """
    none = F.lit(None).cast("array<double>")
    tail = F.slice("samples", F.greatest(F.lit(1), F.size("samples") - before + 1), F.lit(before)) if before else none
    head = F.slice("samples", F.lit(1), F.lit(after)) if after else none
    names = ("start_sample", "samples", "left", "right", *keep)
    i = F.col("block_idx")

    def piece(at: Column, **values: Column) -> Column:
        empty = {c: F.lit(None).cast(blocks.schema[c].dataType) for c in ("start_sample", *keep)} | {c: none for c in ("samples", "left", "right")}
        return F.struct(at.alias("block_idx"), *[(values.get(c, empty[c])).alias(c) for c in names])

    doubles = blocks.withColumn("samples", F.transform("samples", lambda v: v.cast("double")))
    own = piece(i, **{c: F.col(c) for c in ("start_sample", "samples", *keep)})
    # the first block has none before it; what is not lent is not made a row of
    pieces = F.array(own, *[piece(i + 1, left=tail)] * (before > 0), *[F.when(i > 0, piece(i - 1, right=head))] * (after > 0))
    lent = doubles.select("recording_id", F.explode(F.filter(pieces, lambda p: p.isNotNull())).alias("p")).select("recording_id", "p.*")
    one = [F.first(c, ignorenulls=True).alias(c) for c in names]
    return dealt(lent, "recording_id", "block_idx").groupBy("recording_id", "block_idx").agg(*one).where("samples is not null")


#: Samples that a task works through before it sends a record batch on.
SAMPLES_AT_A_TIME = 1 << 20


def over_blocks(blocks: DataFrame, before: int, after: int, step: Callable[..., tuple], out: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(recording_id, block_idx, start_sample, ``out``): a row of ``step`` for every block.

    ``step`` takes the block's samples with its halo, the sizes of the left and
    the right halo, the first own sample's place and the values of ``keep``, and
    gives a value for each column of ``out``: numbers for ``long`` and
    ``double``, arrays for ``array<double>``.
    """
    kind = blocks.schema["recording_id"].dataType.simpleString()
    names, kinds = zip(*(c.split() for c in out.split(", ")), strict=True)
    makers = [array_column if k == "array<double>" else (lambda v, t=pa.int64() if k == "long" else pa.float64(): pa.array(v, t)) for k in kinds]
    ids = ["recording_id", "block_idx", "start_sample"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [array_values(batch.column(c)) for c in ("left", "samples", "right")]
            starts, kept = batch.column("start_sample").to_pylist(), [batch.column(c).to_pylist() for c in keep]
            found, begun, held = [], 0, 0
            for i in range(batch.num_rows):
                left, own, right = (x[at[i] : at[i + 1]] for x, at in parts)
                found.append(step(np.concatenate([left, own, right]), len(left), len(right), starts[i], *(v[i] for v in kept)))
                held += len(own)
                if held >= SAMPLES_AT_A_TIME or i + 1 == batch.num_rows:
                    columns = [make(list(v)) for make, v in zip(makers, zip(*found, strict=True), strict=True)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(begun, len(found)) for c in ids), *columns], [*ids, *names])
                    found, begun, held = [], i + 1, 0

    rows = with_halo(blocks, before, after, keep) if before or after else blocks.select("*", F.array().cast("array<double>").alias("left"), F.array().cast("array<double>").alias("right"))
    own = rows.select("recording_id", F.col("block_idx").cast("int").alias("block_idx"), F.col("start_sample").cast("long").alias("start_sample"), "left", F.transform("samples", lambda v: v.cast("double")).alias("samples"), "right", *keep)
    return own.mapInArrow(run, f"recording_id {kind}, block_idx int, start_sample long, {out}")


def map_blocks(blocks: DataFrame, before: int, after: int, step: Callable[[np.ndarray, int, int], np.ndarray]) -> DataFrame:
    """Blocks of ``step(samples with halo, size of the left halo, size of the right one)``, which gives the block's own samples."""
    return over_blocks(blocks, before, after, lambda x, a, z, _: (np.asarray(step(x, a, z), float),), "samples array<double>")


def declick_blocks(blocks: DataFrame, block: int, sample_rate: int = 24_000, threshold: float = 5, attenuation: float = 0.5) -> DataFrame:
    """``signal.declick`` block by block; ``block`` is a multiple of the 2 ms frame and holds more than 20 frames.

    The halo is the ten frames that a median reaches over on either side and
    one more for the ramps of clicks next door, so each block is as in the
    whole.  A recording of less than five frames stays as it is.
    """
    size = max(1, int(sample_rate * 0.002))
    if block % size or block < 22 * size:
        raise ValueError("a block has to be more than 21 whole frames")
    halo = 11 * size
    return map_blocks(blocks, halo, halo, lambda x, a, z: declick(x, sample_rate, threshold=threshold, attenuation=attenuation)[a : len(x) - z])


def room_blocks(blocks: DataFrame, block: int, sample_rate: int = 24_000, rt60_ms: float = 80) -> DataFrame:
    """``signal.room`` block by block: a response's length of the past is the halo, the peaks are sums of the recording."""
    response = room_response(sample_rate, rt60_ms)
    if len(response) - 1 > block:
        raise ValueError("a block has to be as long as the room's response")

    def step(x: np.ndarray, a: int, z: int, start: int) -> tuple[np.ndarray, float, float]:
        wet = convolve(x, response)[a:]
        return wet, float(np.abs(x[a:]).max(initial=0)), float(np.abs(wet).max(initial=0))

    # twice in a plan, but after one shuffle that both share
    wet = over_blocks(blocks, len(response) - 1, 0, step, "samples array<double>, dry double, wet double")
    gains = wet.groupBy("recording_id").agg(((F.max("dry") + 1e-10) / (F.max("wet") + 1e-10)).alias("gain"))
    return wet.join(gains, "recording_id").select("recording_id", "block_idx", "start_sample", F.transform("samples", lambda v: v * F.col("gain")).alias("samples"))
