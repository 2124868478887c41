"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points on a ring of ``2**RING_BITS`` positions.  A
key's home is the first virtual node clockwise of its hash.  A shard that is
full sends the keys beyond its capacity on to the next virtual node clockwise,
until one has room, so no shard ever exceeds its capacity and only overflow
moves.

The work on rows is declarative: hash, count per arc of the ring, rank within
an arc, look up.  What reaches the driver is one count per arc, that is
``n_shards * vnodes`` numbers whatever the number of rows; from these the
overflow is routed as whole intervals of ranks.
"""

from __future__ import annotations

import hashlib
from collections import deque
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

#: Positions of the ring, and the cells of the broadcast lookup table.
RING_BITS, CELL_BITS = 32, 12


def ring_arcs(n_shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(point, shard) of each virtual node in clockwise order.

    A point depends on its shard and number alone, so a further shard adds
    points and changes none.  Where two fall on one point, the lower shard
    number keeps it.
    """
    at: dict[int, int] = {}
    for shard in range(n_shards):
        for v in range(vnodes):
            digest = hashlib.md5(f"shard-{shard}-vnode-{v}".encode()).digest()
            at.setdefault(int.from_bytes(digest[:8], "big") >> (64 - RING_BITS), shard)
    return sorted(at.items())


def route_overflow(
    counts: list[int], owners: list[int], capacity: list[int]
) -> list[tuple[int, int, int, int, int]]:
    """Place each arc's keys, given as a count, under the shards' capacities.

    Returns (arc, first rank, end rank, shard, first slot) intervals.  In every
    round each arc's shard takes what it has room for; the remaining ranks of
    all arcs then move one virtual node clockwise.
    """
    room = list(capacity)
    used = [0] * len(capacity)
    n = len(counts)
    waiting = deque((a, a, 0, c) for a, c in enumerate(counts) if c)
    out = []
    while waiting:
        for _ in range(len(waiting)):
            arc, at, lo, hi = waiting.popleft()
            shard = owners[at]
            take = min(room[shard], hi - lo)
            if take:
                out.append((arc, lo, lo + take, shard, used[shard]))
                used[shard] += take
                room[shard] -= take
            if lo + take < hi:
                waiting.append((arc, (at + 1) % n, lo + take, hi))
        if waiting and not any(room):
            raise ValueError("the capacities are below the number of keys")
    return out


def even_capacity(total: int, n_shards: int, load_factor: float = 1.0) -> list[int]:
    """Row capacity of each shard.

    ``load_factor`` 1 gives the tightest bound, counts at most one apart;
    larger factors leave room and move fewer keys.
    """
    if load_factor <= 1.0:
        return [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    return [int(-(-total * load_factor // n_shards))] * n_shards


def bounded_ring_shards(
    df: DataFrame,
    key: Column,
    n_shards: int = 40,
    vnodes: int = 64,
    load_factor: float = 1.0,
) -> DataFrame:
    """Add ``shard`` and ``slot`` (gapless from 0 within a shard) to each row.

    ``key`` is hashed onto the ring.  Rows that are equal in ``key`` share an
    arc but are ranked apart, so a key that holds a third of all rows spreads
    over as many shards as its load needs; within an arc, ranks are counted per
    input partition first, so such a key is no single sort group either.
    Null keys hash like any value.  An empty input gives an empty result.
    The columns of ``df`` are kept; ``df`` must not have columns named
    ``shard`` or ``slot``, and other clashes cannot arise as helper columns
    are prefixed with ``_ring``.
    """
    spark = df.sparkSession
    arcs = ring_arcs(n_shards, vnodes)
    owners = [shard for _, shard in arcs]
    # a cell's arcs: those before it, and the points within it
    within: list[list[int]] = [[] for _ in range(1 << CELL_BITS)]
    for point, _ in arcs:
        within[point >> (RING_BITS - CELL_BITS)].append(point)
    before = [0, *accumulate(map(len, within))]
    ring = spark.createDataFrame(list(zip(range(len(within)), before, within, strict=False)), "_ring_cell int, _ring_before int, _ring_within array<long>")

    hashed = df.withColumn("_ring_hash", F.xxhash64(key)).withColumn("_ring_point", F.shiftrightunsigned("_ring_hash", 64 - RING_BITS))
    hashed = hashed.withColumn("_ring_cell", F.shiftright("_ring_point", RING_BITS - CELL_BITS).cast("int"))
    passed = F.size(F.filter("_ring_within", lambda p: p < F.col("_ring_point")))
    arc = ((F.col("_ring_before") + passed) % len(arcs)).alias("_ring_arc")
    placed = materialise(
        hashed.join(F.broadcast(ring), "_ring_cell").select(*[hashed[c] for c in df.columns], "_ring_hash", arc, F.spark_partition_id().alias("_ring_part")),
        "ring",
    )
    cells = placed.groupBy("_ring_arc", "_ring_part").agg(F.count(F.lit(1)).alias("_ring_n"))
    counts = [0] * len(arcs)
    for row in cells.groupBy("_ring_arc").agg(F.sum("_ring_n").alias("n")).collect():  # one row per arc
        counts[row["_ring_arc"]] = row["n"]
    capacity = even_capacity(sum(counts), n_shards, load_factor)
    plan = spark.createDataFrame(
        route_overflow(counts, owners, capacity),
        "_ring_arc int, _ring_lo long, _ring_hi long, shard int, _ring_slot long",
    )

    before = Window.partitionBy("_ring_arc").orderBy("_ring_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("_ring_start", F.coalesce(F.sum("_ring_n").over(before), F.lit(0))).drop("_ring_n")
    own = Window.partitionBy("_ring_arc", "_ring_part").orderBy("_ring_hash", *[c for c in df.columns])
    ranked = (
        placed.withColumn("_ring_row", F.row_number().over(own) - 1)
        .join(starts, ["_ring_arc", "_ring_part"])
        .withColumn("_ring_rank", F.col("_ring_start") + F.col("_ring_row"))
    )
    seated = ranked.join(
        F.broadcast(plan),
        (ranked["_ring_arc"] == plan["_ring_arc"])
        & (ranked["_ring_rank"] >= plan["_ring_lo"])
        & (ranked["_ring_rank"] < plan["_ring_hi"]),
    )
    slot = plan["_ring_slot"] + ranked["_ring_rank"] - plan["_ring_lo"]
    return seated.select(*[ranked[c] for c in df.columns], plan["shard"], slot.alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """Shards 0 to ``n_shards - 1`` for all documents, row counts at most one apart.

    The ring key is ``doc_id``; rows without one go by the CRC-32 of their
    text.  A null text has size 16 and the CRC-32 of no bytes.  Repeated rows
    are separate rows with slots of their own.  Columns besides ``doc_id`` and
    ``text`` are ignored.
    """
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
    )
    key = F.coalesce(F.col("doc_id"), F.col("text_crc32"))
    return bounded_ring_shards(rows, key, n_shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
