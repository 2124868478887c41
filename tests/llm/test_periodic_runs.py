"""Periodic runs against a search through all periods."""

from __future__ import annotations

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from rubato.llm import periodic_runs as pr

from .conftest import prose


def brute_runs(words: list, least_words: int = 6, least_periods: int = 4) -> list[tuple[int, int, int]]:
    """Every period's maximal stretches of equal distance, those of a smaller period left out."""
    n, found = len(words), []
    for p in range(1, n // least_periods + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j + p - i
            smaller = any(all(words[x] == words[x + q] for x in range(i, i + length - q)) for q in range(1, p))
            if length >= max(least_words, least_periods * p) and not smaller:
                found.append((i, length, p))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id: int | None, text: str | None) -> tuple:
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text or "") if w]
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-__import__("fractions").Fraction(r[1], r[2]), r[0], r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *shown, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(kept)))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), max_size=4), st.integers(2, 4))
def test_runs_of_small_alphabets(texts, periods):
    sizes = [len(t) for t in texts]
    words = np.array([10 * d + w for d, t in enumerate(texts) for w in t], np.int64)
    found = list(zip(*(x.tolist() for x in pr.find_runs(words, 2, periods)), strict=True))
    want = [(s + sum(sizes[:d]), m, q) for d, t in enumerate(texts) for s, m, q in brute_runs(t, 2, periods)]
    assert found == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=200, unique=True))
def test_next_smaller(values):
    found = pr.next_smaller(np.array(values))
    assert found.tolist() == [next((j for j in range(i + 1, len(values)) if values[j] < values[i]), len(values)) for i in range(len(values))]


def test_suffixes_and_extensions():
    rng = np.random.default_rng(3)
    for size, top in ((1, 2), (50, 1), (300, 2), (300, 40)):
        words = rng.integers(0, top, size)
        order, inverse, levels = pr.suffix_order(words)
        assert order.tolist() == sorted(range(size), key=lambda i: words[i:].tolist())
        assert (order[inverse] == np.arange(size)).all()
        extensions = pr.Extensions(words)
        a, b = rng.integers(0, size, (2, 200))
        a, b = a[a != b], b[a != b]
        same = lambda x, y: next((k for k in range(size) if max(x, y) + k >= size or words[x + k] != words[y + k]), 0)
        assert extensions.of(a, b).tolist() == [same(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def test_ties_and_nested_runs():
    words = "a b a b a b a b x c c c c c c x a b a b a b a b".split()
    assert pr.runs_of_documents([[w.encode() for w in words]]) == [[(0, 8, 2), (9, 6, 1), (16, 8, 2)]]
    row = pr.describe([w.encode() for w in words], [(0, 8, 2), (9, 6, 1), (16, 8, 2)])
    assert row[1:5] == (9, 6, 1, 6000)
    nested = ["a", "a", "a", "a", "a", "a", "b"] * 5
    assert pr.runs_of_documents([[w.encode() for w in nested]])[0] == brute_runs(nested)


def rows(df) -> list:
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_awkward_rows_equal_brute_force(awkward, spark):
    short = awkward.where("length(text) < 20000 or text is null")
    want = sorted((brute_row(r["doc_id"], r["text"]) for r in short.collect()), key=str)
    assert rows(pr.periodic_runs(short, plant=True)) == want


def test_planted_runs_of_many_documents(spark):
    rng = random.Random(1)
    docs = [(i, prose(rng, rng.randint(0, 120))) for i in range(400)]
    want = sorted((brute_row(*d) for d in docs), key=str)
    found = rows(pr.periodic_runs(spark.createDataFrame(docs, "doc_id long, text string"), plant=True))
    assert found == want and sum(r[1] > 0 for r in found) > 10


def test_empty_table(no_rows):
    assert pr.periodic_runs(no_rows).collect() == []


@pytest.mark.parametrize("period", [1, 7, 1000])
def test_long_texts_are_near_linear(period):
    words = [f"w{i % period}".encode() for i in range(200_000)]
    began = time.time()
    assert pr.runs_of_documents([words]) == [[(0, 200_000, period)]]
    assert time.time() - began < 20
