from __future__ import annotations

from fractions import Fraction

import corpus_pipeline
import numpy as np
from rubato.llm import near_copies as n
from rubato.llm import signature_tree as tree
from rubato.llm.ngram_join import shingle_set
from rubato.llm.simhash import LOWER


def brute_set(text: str | None) -> frozenset:
    words = (text or "").encode().translate(LOWER).split()
    width = min(5, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if words else frozenset()


def brute_groups(texts: dict) -> dict:
    """Smallest key of each one's group, by comparing all pairs."""
    first = {}
    for k in sorted(texts):
        first.setdefault(brute_set(texts[k]), k)
    sets = list(first)
    parent = {s: s for s in sets}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for i, a in enumerate(sets):
        for b in sets[i + 1 :]:
            if a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((root(a), root(b)), key=first.get)
                parent[y] = x
    return {k: first[root(brute_set(t))] for k, t in texts.items()}


def test_near_copies_of_the_table_go(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    groups = brute_groups({r.doc_id: r.text for r in docs.collect()})
    assert groups[145] == 6 and groups[177] == 1  # 11 and 7 bits apart in op10's fingerprints
    kept = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, small_dir).collect()}
    assert kept == set(groups.values())


def test_planted_copies_and_a_chain(spark, small_dir):
    rng = np.random.default_rng(3)
    rows, words = {}, lambda k: [f"w{x}" for x in rng.integers(0, 5000, k)]
    for _ in range(40):
        base = words(200)
        for edits in (0, 1, 2, 4, 6, 8):
            text = list(base)
            for at in rng.integers(0, 200, edits):
                text[at] = "changed"
            rows[len(rows)] = " ".join(text)
    chain = words(300)
    for step in range(40):  # neighbours are near, the ends have nothing in common
        rows[len(rows)] = " ".join(chain)
        chain = chain[20:] + words(20)
    docs = spark.createDataFrame([(k, t) for k, t in rows.items()], "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, small_dir).collect()}
    assert kept == set(brute_groups(rows).values())


def test_sets_and_similarity():
    texts = ["", "a", "a b", "A  B", "a b c d e f g", "b c d e f g h"]
    sets = [shingle_set(t, n.WORDS) for t in texts]
    assert [len(s) for s in sets] == [len(brute_set(t)) for t in texts] and np.array_equal(sets[2], sets[3])
    x, y = np.arange(9, dtype=np.uint64), np.arange(10, dtype=np.uint64)
    near = lambda a, b, percent: tree.similar(a, b, Fraction(percent, 100))
    assert near(x, y, 90) and not near(x, y, 91) and near(y[:8], y, 80) and not near(y[:8], y[2:], 80)


def test_a_group_too_large_for_one_task(spark, small_dir, monkeypatch):
    monkeypatch.setattr(tree, "BLOCK_SETS", 30)
    monkeypatch.setattr(tree, "PIVOTS", 2)
    rng = np.random.default_rng(8)
    words = lambda k: [f"w{x}" for x in rng.integers(0, 5000, k)]
    base, rows = words(150), {}
    for i in range(120):  # near the base, not always near each other
        text = list(base)
        for at in rng.integers(0, 150, 3):
            text[at] = f"x{i}"
        rows[i] = " ".join(text)
    chain = words(300)
    for i in range(60):  # one group of which each is near its neighbours alone
        rows[200 + i] = " ".join(chain)
        chain = chain[20:] + words(20)
    docs = spark.createDataFrame([(k, t) for k, t in rows.items()], "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, small_dir).collect()}
    assert kept == set(brute_groups(rows).values())


def test_a_large_group_of_filled_in_templates(spark, small_dir, monkeypatch):
    """Most texts share bands and are below 0.8."""
    monkeypatch.setattr(tree, "BLOCK_SETS", 40)
    monkeypatch.setattr(tree, "PIVOTS", 2)
    monkeypatch.setattr("rubato.llm.common.HOT_SHARE", 50)
    rng = np.random.default_rng(12)
    words = lambda k: [f"w{x}" for x in rng.integers(0, 5000, k)]
    base, rows = words(140), {}
    for i in range(260):  # from near copies of the base to texts near none but a partner
        text = base[: 140 - int(rng.integers(0, 12))]
        for at in rng.integers(0, len(text), int(rng.integers(0, 9))):
            text[at] = f"x{i}" if i % 3 else f"y{at}"
        rows[2 * i] = " ".join(text)
        if i % 10 == 0:
            rows[2 * i + 1] = " ".join([*text, "and", "more"])
    docs = spark.createDataFrame([(k, t) for k, t in rows.items()], "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, small_dir).collect()}
    assert kept == set(brute_groups(rows).values())


def test_number_of_jobs(spark, small_dir):
    """A job costs more than its data where there are few links."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    spark.sparkContext.setJobGroup("near-dedup", "near-dedup")
    try:
        corpus_pipeline.near_dedup_stage(spark, docs, small_dir).count()
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("near-dedup")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(jobs) < 80


def test_hot_rows_and_ties(spark, small_dir, monkeypatch):
    monkeypatch.setattr("rubato.llm.common.HOT_SHARE", 20)
    rng = np.random.default_rng(9)
    other = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 80)) for _ in range(60)]
    rows = [(7, "one text that is there again and again", f"s{i % 3}") for i in range(40)]
    rows += [(None, other[0], "s")] * 30 + [(i + 10, t, "s") for i, t in enumerate(other)] + [(i + 100, other[0], "s") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    kept = sorted((r.doc_id, r.text, r.source) for r in corpus_pipeline.near_dedup_stage(spark, docs, small_dir).collect())
    assert kept == sorted([(7, rows[0][1], "s0")] + [(i + 10, t, "s") for i, t in enumerate(other)])


def test_candidates_come_from_fingerprints(spark, small_dir, monkeypatch):
    """Without bands, copies within 3 bits are still found, by Golay-code keys, and checked on the sets."""
    monkeypatch.setattr(n, "band_keys", lambda shingles, least: np.zeros(0, np.int64))
    rng = np.random.default_rng(5)
    words = lambda k: [f"w{x}" for x in rng.integers(0, 5000, k)]
    rows = {}
    for i in range(30):
        base = words(1500)
        rows[2 * i], rows[2 * i + 1] = " ".join(base), " ".join([*base[:700], "changed", *base[701:]])
    docs = spark.createDataFrame([(k, t) for k, t in rows.items()], "doc_id long, text string").repartition(3)
    sims = {k: n.set_fingerprint(shingle_set(t, n.WORDS)) for k, t in rows.items()}
    near = [i for i in range(30) if ((sims[2 * i] ^ sims[2 * i + 1]) & (1 << 64) - 1).bit_count() <= 3]
    kept = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, small_dir).collect()}
    assert len(near) > 20 and kept == set(rows) - {2 * i + 1 for i in near}
