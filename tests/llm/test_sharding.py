from __future__ import annotations

import bisect
import zlib
from collections import Counter

from pyspark.sql import functions as F
from rubato.llm import sharding


def test_shards_are_even_and_slots_gapless(spark, small_dir):
    rows = sharding.op1_sharding(spark, small_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)


def test_awkward_rows_and_hot_keys(spark, awkward, no_rows):
    rows = sharding.shard_documents(awkward, 7).collect()
    assert len(rows) == awkward.count()
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert sharding.shard_documents(no_rows).count() == 0
    hot = spark.range(9000).selectExpr("if(id % 3 = 0, 1, id) as doc_id", "'t' as text")
    sizes = Counter(r.shard for r in sharding.shard_documents(hot, 8).collect())
    assert sorted(sizes.values()) == [1125] * 8


def test_overflow_goes_clockwise_and_little_else_moves():
    arcs = sharding.ring_arcs(4, 16)
    owners = [s for _, s in arcs]
    counts = [10] * len(arcs)
    plan = sharding.route_overflow(counts, owners, sharding.even_capacity(sum(counts), 4))
    held = Counter()
    covered = {a: 0 for a in range(len(arcs))}
    for arc, lo, hi, shard, slot in plan:
        assert slot == held[shard]
        held[shard] += hi - lo
        covered[arc] += hi - lo
    assert all(covered[a] == 10 for a in covered)
    assert set(held.values()) == {sum(counts) // 4}
    home = sum(hi - lo for arc, lo, hi, shard, _ in plan if shard == owners[arc])
    assert home > sum(counts) * 0.7  # only overflow leaves its home
    loose = sharding.route_overflow(counts, owners, sharding.even_capacity(sum(counts), 4, 2.0))
    assert all(shard == owners[arc] for arc, _, _, shard, _ in loose)


def test_a_further_shard_keeps_the_ring_points():
    before, after = dict(sharding.ring_arcs(5, 32)), dict(sharding.ring_arcs(6, 32))
    assert all(after[p] == s for p, s in before.items())


def test_every_virtual_node_has_its_arc():
    assert len(sharding.ring_arcs(40, 64)) == 40 * 64


def test_keys_walk_the_ring_one_by_one(spark):
    """Homes and overflow against a walk key by key: each round, every waiting key tries the next virtual node."""
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("h"))
    arcs = sharding.ring_arcs(5, 16)
    points, owners = [p for p, _ in arcs], [s for _, s in arcs]
    found = sharding.bounded_ring_shards(rows, F.col("doc_id"), 5, 16).collect()
    home = {r.doc_id: bisect.bisect_left(points, r.h % (1 << 64) >> 32) % len(arcs) for r in found}
    room = sharding.even_capacity(3000, 5)
    waiting, loads = [(home[r.doc_id], home[r.doc_id]) for r in found], Counter()
    while waiting:
        left = []
        for arc, at in sorted(waiting):
            if room[owners[at]]:
                room[owners[at]] -= 1
                loads[arc, owners[at]] += 1
            else:
                left.append((arc, (at + 1) % len(arcs)))
        waiting = left
    assert Counter((home[r.doc_id], r.shard) for r in found) == loads
