from __future__ import annotations

import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F
from rubato.llm import winnowing as w

M64 = (1 << 64) - 1


def brute_entries(text: str) -> list[int]:
    words = re.findall(w.WORD_PATTERN, text)
    h = [0] * (w.GRAM_WORDS - 1) + [xxhash.xxh64_intdigest(x.encode(), 42) for x in words]
    rotate = lambda x, b: ((x << b) | (x >> (64 - b))) & M64 if b else x
    grams = []
    for i in range(len(words)):
        rolled = 0
        for j in range(w.GRAM_WORDS):
            rolled ^= rotate(h[i + j], w.GRAM_WORDS - 1 - j)
        grams.append(((rolled >> w.POSITION_BITS + 1) << w.POSITION_BITS) | (w.POSITION_MASK - i))
    if len(grams) >= w.WINDOW:
        windows = [grams[i : i + w.WINDOW] for i in range(len(grams) - w.WINDOW + 1)]
    else:
        windows = [grams[i:] for i in range(len(grams))]
    return list(dict.fromkeys(map(min, windows)))


def brute_rows(rows):
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    ordered = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), -signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42))))
    out = []
    for i, (doc_id, text) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        sets = [{e >> w.POSITION_BITS for e in brute_entries(t)} for t in (text, edited, after)]
        near = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), brute_entries(text), brute_entries(edited), *near))
    return out


def key(r):
    return tuple(map(repr, r))


def check(found, rows):
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.entries, r.edited_entries, r.near_edited, r.near_next) for r in found.collect()]
    assert sorted(got, key=key) == sorted(brute_rows(rows), key=key)


def test_documents_equal_brute_force(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text")
    check(w.fingerprint_documents(docs), [tuple(r) for r in docs.collect()])
    assert w.op7_winnowing(spark, small_dir).count() == docs.count()


def test_awkward_rows(spark, awkward, no_rows):
    check(w.fingerprint_documents(awkward), [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()])
    assert w.fingerprint_documents(no_rows).count() == 0


def test_a_shared_run_leaves_a_common_hash(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    pairs = []
    for _ in range(60):
        shared = [word() for _ in range(w.WINDOW + w.GRAM_WORDS - 1)]
        text = lambda s=shared: " ".join([word() for _ in range(rng.randint(0, 40))] + s + [word() for _ in range(rng.randint(0, 40))])
        pairs.append((text(), text()))
    both = spark.createDataFrame(pairs, "a string, b string").select(
        F.arrays_overlap(w.entry_hashes(w.entries(F.col("a"))), w.entry_hashes(w.entries(F.col("b")))).alias("met")
    )
    assert all(r.met for r in both.collect())


def test_rightmost_of_equal_hashes_is_kept(spark):
    text = " ".join(["same"] * 30)
    row = spark.createDataFrame([(text,)], "t string").select(w.entry_positions(w.entries(F.col("t"))).alias("p")).first()
    assert row.p == sorted(row.p) and 29 in row.p


def test_hot_ids_and_repeated_rows(spark, monkeypatch):
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(n))
    rows = [(7, text(20)) for _ in range(150)] + [(7, "one and the same text of a hot id")] * 60 + [(None, text(12)) for _ in range(60)] + [(None, None)] * 40 + [(i, text(15)) for i in range(100, 190)]
    rng.shuffle(rows)
    check(w.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)), rows)
    check(w.fingerprint_documents(spark.createDataFrame([(1, "all rows are equal to each other")] * 30, "doc_id long, text string")), [(1, "all rows are equal to each other")] * 30)
    monkeypatch.setattr(w, "RANGE_BYTES", 200)  # many ranges
    check(w.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)), rows)


def test_ranges_split_a_hot_key():
    bounds = w.range_bounds([1, 5, 5, 5, 9])
    assert bounds == sorted(bounds) and [k for k, _ in bounds] == [1, 5, 5, 5, 9] and len({h for k, h in bounds if k == 5}) == 3
