from __future__ import annotations

import random

import numpy as np
import xxhash
from rubato.llm import simhash as s


def brute_fingerprint(text: str | None) -> int:
    words = (text or "").encode().translate(s.LOWER).split()
    if not words:
        return 0
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    lowest = {}
    for d, f in rows:
        if d is not None:
            lowest[root(f)] = min(lowest.get(root(f), d), d)
    return sorted(((d, f, lowest.get(root(f))) for d, f in rows), key=repr)


def signed(f: int) -> int:
    return f - (1 << 64) if f >> 63 else f


def planted(seed: int) -> list[tuple[int | None, int]]:
    """Fingerprints with chains and clouds of near ones."""
    rng = random.Random(seed)
    rows, next_id = [], 0
    for _ in range(120):
        f = rng.getrandbits(64)
        for _ in range(rng.choice((1, 1, 3, 20))):
            rows.append((next_id, f))
            next_id += 1
            for b in rng.sample(range(64), rng.choice((1, 2, 3, 3, 4))):
                f ^= 1 << b
    center = rng.getrandbits(64)
    for _ in range(300):
        f = center
        for b in rng.sample(range(64), rng.randint(0, 3)):
            f ^= 1 << b
        rows.append((next_id, f))
        next_id += 1
    return rows + [(None, rows[0][1]), (None, 7), rows[1], rows[1]]


def test_components_equal_brute_force(spark):
    for seed in (1, 2):
        rows = planted(seed)
        prints = spark.createDataFrame([(d, signed(f)) for d, f in rows], "doc_id long, fp long")
        found = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in s.near_duplicate_components(prints).collect()), key=repr)
        assert found == brute_components(rows)


def test_any_three_bits_share_a_key():
    rng = random.Random(9)
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(1, 3)):
            b ^= 1 << bit
        keys, owners = s.fuzzy_keys(np.array([signed(a), signed(b)], np.int64))
        assert set(keys[owners == 0].tolist()) & set(keys[owners == 1].tolist())


def test_golay_indices_meet_within_two_bits():
    base = s.golay_indices(np.array([0]))[0]
    errors = [0] + [1 << i for i in range(23)] + [1 << i | 1 << j for i in range(23) for j in range(i)]
    for word in (0, 0x2A5F31, 0x7FFFFF):
        own = set(s.golay_indices(np.array([word]))[0].tolist()) - {-1}
        for e in errors:
            assert own & (set(s.golay_indices(np.array([word ^ e]))[0].tolist()) - {-1})
    assert base.shape == (6,)


def test_query_equals_brute_force(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").collect()
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs]
    found = s.op10_simhash(spark, small_dir).collect()
    assert sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in found), key=repr) == brute_components(rows)
    assert all(len(r.fingerprint) == 16 for r in found)


def test_awkward_rows(spark, awkward, no_rows):
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in awkward.select("doc_id", "text").collect()]
    found = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in s.simhash_components(awkward).collect()), key=repr)
    assert found == brute_components(rows)
    kept = s.one_of_each_group(awkward)
    assert kept.columns == awkward.columns
    groups = {c if c is not None else ("none", f) for _, f, c in brute_components(rows)}
    assert kept.count() == len(groups)
    assert s.simhash_components(no_rows).count() == 0 and s.one_of_each_group(no_rows).count() == 0


def test_long_runs_are_told_apart_without_loss():
    rng = np.random.default_rng(5)
    fixed = np.uint64(0xABCDE12345 << 24)
    fps = np.unique(fixed | rng.integers(0, 1 << 18, 700, np.uint64))
    u, v = s.links_in_long_run(fps.view(np.int64))
    rows = [(i, int(f)) for i, f in enumerate(fps)]
    want = {frozenset((a, b)) for i, (_, a) in enumerate(rows) for _, b in rows[:i] if (a ^ b).bit_count() <= 3}
    found = {frozenset((int(a), int(b))) for a, b in zip(u.view(np.uint64), v.view(np.uint64), strict=True)}
    assert found <= want
    parent = {int(f): int(f) for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in map(tuple, found):
        parent[root(a)] = root(b)
    assert all(root(a) == root(b) for a, b in map(tuple, want)) and len(want) > 100


def test_a_hot_fingerprint_and_a_hub(spark, monkeypatch):
    monkeypatch.setattr("rubato.llm.common.HOT_SHARE", 10)
    rng = random.Random(3)
    hub = rng.getrandbits(64)
    rows = [(i, hub) for i in range(200)] + [(200 + i, hub ^ 1 << i) for i in range(64)] + [(300 + i, rng.getrandbits(64)) for i in range(200)]
    prints = spark.createDataFrame([(d, signed(f)) for d, f in rows], "doc_id long, fp long").repartition(5)
    found = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in s.near_duplicate_components(prints).collect()), key=repr)
    assert found == brute_components(rows)
