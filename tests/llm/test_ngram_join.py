"""The n-gram join and its signature trees against comparing all pairs."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from rubato.llm import ngram_join as nj
from rubato.llm import signature_tree as tree
from rubato.llm.common import materialise, table
from rubato.llm.components import stars
from rubato.llm.simhash import LOWER


def brute_set(text: str | None, width: int = 3) -> frozenset:
    words = (text or "").encode().translate(LOWER).split()
    width = min(width, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if words else frozenset()


def brute_rows(rows: list[tuple], num: int = 90, den: int = 100, width: int = 3) -> list[tuple]:
    """(doc_id, n, smallest id reached) of every (doc_id, text)."""
    sets = [brute_set(t, width) for _, t in rows]
    distinct = [s for s in dict.fromkeys(sets) if s]
    parent = {s: s for s in distinct}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if den * min(len(a), len(b)) >= num * max(len(a), len(b)) and den * len(a & b) >= num * len(a | b):
                parent[root(b)] = root(a)
    lowest: dict = {}
    for (i, _), s in zip(rows, sets, strict=True):
        if s and i is not None:
            lowest[root(s)] = min(lowest.get(root(s), i), i)
    return sorted(((i, len(s), lowest.get(root(s)) if s else i) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def found_rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def near_sets(rng: np.random.Generator, n: int, size: int, edits: int) -> list[np.ndarray]:
    base = rng.integers(0, 1 << 64, size, np.uint64)
    out = []
    for _ in range(n):
        own = base.copy()
        k = int(rng.integers(0, edits + 1))
        own[rng.integers(0, size, k)] = rng.integers(0, 1 << 64, k, np.uint64)
        out.append(np.unique(own[: size - int(rng.integers(0, edits + 1))]))
    return out


@pytest.mark.parametrize("least", [Fraction(9, 10), Fraction(8, 10), Fraction(1, 2)])
@pytest.mark.parametrize("size", [1, 2, 5, 9, 10, 19, 20, 40, 150, 700])
def test_linked_sets_share_a_key(least, size):
    rng, near = np.random.default_rng(size), 0
    for _ in range(30):
        sets = near_sets(rng, 6, size, max(1, size // 7))
        keys = [set(nj.part_keys(s, least).tolist()) for s in sets]
        for i in range(len(sets)):
            for j in range(i):
                if tree.similar(sets[i], sets[j], least) and not np.array_equal(sets[i], sets[j]):
                    near += 1
                    assert keys[i] & keys[j]
    assert near or size < 10


def test_unrelated_sets_share_hardly_a_key():
    rng = np.random.default_rng(1)
    keys = [k for _ in range(300) for k in set(nj.part_keys(np.unique(rng.integers(0, 1 << 64, 200, np.uint64)), nj.SIMILARITY).tolist())]
    assert len(keys) - len(set(keys)) < 10


def test_stars_connect_what_links_connect():
    rng = np.random.default_rng(6)
    for _ in range(50):
        n = int(rng.integers(1, 60))
        u, v = rng.integers(0, n, (2, int(rng.integers(0, 60))))
        a, b = stars(u + 100, v + 100)
        assert components(n, list(zip(u.tolist(), v.tolist(), strict=True))) == components(n, list(zip((a - 100).tolist(), (b - 100).tolist(), strict=True)))
        assert (a < b).all() and len(set(b.tolist())) == len(b)


def test_neighbouring_classes_hold_all_sizes_in_reach():
    for least in (Fraction(9, 10), Fraction(8, 10), Fraction(1, 2)):
        for small in range(1, 3000):
            largest = small * least.denominator // least.numerator
            assert tree.size_class(largest, least) - tree.size_class(small, least) <= 1


def components(n: int, links: list) -> list[int]:
    label = list(range(n))
    for a, b in links:
        label = [label[a] if x == label[b] else x for x in label]
    firsts: dict = {}
    return [firsts.setdefault(x, i) for i, x in enumerate(label)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(1, 90), st.integers(1, 120), st.integers(0, 12), st.booleans(), st.booleans())
def test_trees_find_what_all_pairs_connect(seed, n, size, edits, classed, sided):
    rng, least = np.random.default_rng(seed), Fraction(8, 10)
    sets = [s for k in (n // 2, n - n // 2) for s in near_sets(rng, k, size, min(edits, size - 1))]
    classes = rng.integers(0, 4, n) if classed else np.arange(n)
    sides = rng.integers(0, 2, n) if sided else np.zeros(n, np.int64)
    known = [(int(np.flatnonzero(classes == c)[0]), int(i)) for c in np.unique(classes) for i in np.flatnonzero(classes == c)]
    across = len(np.unique(sides)) > 1
    pairs = [(i, j) for i in range(n) for j in range(i) if (not across or sides[i] != sides[j]) and tree.similar(sets[i], sets[j], least)]
    links = tree.links_among(sets, classes, sides, least)
    assert set(map(frozenset, links)) <= set(map(frozenset, pairs)) and len(links) < n
    assert components(n, known + links) == components(n, known + pairs)


def test_traversal_prunes_unrelated_sets():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 64, 100, np.uint64)) for _ in range(1000)]
    built = tree.Tree(sets, np.arange(1000), np.zeros(1000, np.int64))
    i, _ = built.candidates(nj.SIMILARITY, False)
    assert len(i) < 5000  # of 499,500 pairs


def test_query_equals_brute_force(spark, small_dir):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, small_dir, "documents").collect()]
    assert found_rows(nj.op12_ngram_join(spark, small_dir)) == brute_rows(rows)


def test_awkward_rows(awkward, no_rows):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert found_rows(nj.ngram_components(awkward)) == brute_rows(rows)
    assert nj.ngram_components(no_rows).collect() == []


def edited(rng, words, base: list[str], edits: int, mark: str) -> str:
    text = list(base)
    for at in rng.integers(0, len(text), edits):
        text[at] = f"{mark}{rng.integers(0, 3)}"
    return " ".join(text)


def test_groups_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(tree, "BLOCK_SETS", 25)
    monkeypatch.setattr(tree, "PIVOTS", 2)
    rng = np.random.default_rng(8)
    words = lambda k: [f"w{x}" for x in rng.integers(0, 5000, k)]
    rows, base = [], words(200)
    for i in range(150):  # near the base, some not near each other; many just below what links
        rows.append((len(rows), edited(rng, words, base, i % 6, f"x{i}-")))
    chain = words(400)
    for _ in range(80):  # each is near its neighbours alone
        rows.append((len(rows), " ".join(chain)))
        chain = chain[12:] + words(12)
    rows += [(1000 + i, rows[i][1]) for i in range(0, 60, 3)] + [rows[5]] * 10
    seen = []
    blocks = tree.links_of_blocks
    monkeypatch.setattr(tree, "links_of_blocks", lambda placed, sets, least: seen.append(placed.count()) or blocks(placed, sets, least))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found_rows(nj.ngram_components(docs)) == brute_rows(rows)
    assert seen and seen[0] > 100


def test_no_task_holds_more_than_two_blocks(spark, monkeypatch):
    monkeypatch.setattr(tree, "BLOCK_SETS", 20)
    monkeypatch.setattr(tree, "PIVOTS", 2)
    most, search = [], tree.search_tasks
    monkeypatch.setattr(tree, "search_tasks", lambda rows, least: most.append(max((r["count"] for r in rows.groupBy("task").count().collect()), default=0)) or search(rows, least))
    rng = np.random.default_rng(4)
    arrays = near_sets(rng, 300, 120, 9)
    members = [(7, i, len(s), tree.size_class(len(s), nj.SIMILARITY)) for i, s in enumerate(arrays)]
    members = materialise(spark.createDataFrame(members, "group long, fp long, size long, k int"), "members")
    sets = materialise(spark.createDataFrame([(7, i, s.view(np.int64).tolist()) for i, s in enumerate(arrays)], "group long, fp long, tokens array<long>"), "sets")
    links = [(r["u"], r["v"]) for r in tree.links_in_groups(members, sets, nj.SIMILARITY).collect()]
    pairs = [(i, j) for i in range(300) for j in range(i) if tree.similar(arrays[i], arrays[j], nj.SIMILARITY)]
    assert components(300, links) == components(300, pairs)
    assert max(most) <= 120 and len(most) == 3
