"""Periodic runs of words by the runs theorem.

A run is a maximal stretch with a smallest period q that holds two periods or
more.  Every run has a Lyndon root that is the longest Lyndon word at its
place, under one of the two orders of the words; so the longest Lyndon words
under both orders, two a place, give all runs.  The longest Lyndon word at i
ends where the next smaller value of the inverse suffix array stands (next
greater for the opposite order), and a root (i, j) is extended to its run by
the longest common extensions of i and j to either side: minima of LCP arrays,
of the words forwards and backwards, over ranges, from sparse tables.

All steps are numpy over many documents at once.  Equal words of different
documents count as different, so no run and no common extension leaves its
document, and a corpus of copies costs no more than any other.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words of documents that are worked on at once; a longer document is worked on alone.
WORDS_AT_ONCE = 1 << 17
RESULT = (
    "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
)


def suffix_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(suffix array, its inverse, ranks of the stretches of 1, 2, 4, ... words at every place).

    Prefix doubling; only suffixes that still share a rank are sorted again.
    A suffix that ends comes before all that go on.
    """
    n = len(words)
    ranks = np.unique(words, return_inverse=True)[1].astype(np.int32)
    # a rank is the place of the group's first suffix in the order, so that groups can be split one by one
    order = np.argsort(ranks, kind="stable")
    first = np.r_[True, ranks[order[1:]] != ranks[order[:-1]]]
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels, width = [rank], 1
    tied = ~(first & np.r_[first[1:], True])
    while tied.any():
        at = np.flatnonzero(tied)  # places in the order whose suffix is not told apart yet
        own = order[at]
        later = np.where(own + width < n, rank[np.minimum(own + width, n - 1)] + 1, 0).astype(np.int64)
        key = rank[own].astype(np.int64) * (n + 2) + later
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        order[at] = own
        opens = np.r_[True, key[1:] != key[:-1]]
        rank = rank.copy()
        rank[own] = at[np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))]
        levels.append(rank)
        tied[at] = ~(opens & np.r_[opens[1:], True])
        width *= 2
    return order, levels[-1], levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """LCP of each suffix of the order with the one before it, 0 for the first."""
    n = len(order)
    lcp = np.zeros(n, np.int32)
    open_ = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    a, b = order[open_ - 1].astype(np.int64), order[open_].astype(np.int64)
    found = np.zeros(len(open_), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        # a stretch that would pass the end has a rank of its own, as a suffix that ends comes first
        inside = (a < n) & (b < n)
        same = inside & (levels[level][np.minimum(a, n - 1)] == levels[level][np.minimum(b, n - 1)])
        step = same * (1 << level)
        found += step
        a, b = a + step, b + step
    lcp[open_] = found
    return lcp


def sparse_minima(values: np.ndarray) -> list[np.ndarray]:
    """Level k holds the minima of the 2**k values from each place on."""
    levels, width = [values], 1
    while 2 * width <= len(values):
        last = levels[-1]
        levels.append(np.minimum(last[:-width], last[width:]))
        width *= 2
    return levels


def range_minima(levels: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minima of values[lo..hi], both included."""
    out = np.empty(len(lo), levels[0].dtype)
    level = np.frexp((hi - lo + 1).astype(float))[1] - 1
    for k in np.unique(level):
        at = level == k
        out[at] = np.minimum(levels[k][lo[at]], levels[k][hi[at] - (1 << k) + 1])
    return out


class Extensions:
    """Longest common extensions of pairs of places of a sequence, to the right."""

    def __init__(self, words: np.ndarray):
        order, self.inverse, levels = suffix_order(words)
        lcp = common_prefixes(order, levels)
        del levels
        self.minima = sparse_minima(lcp)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words agree from ``a`` and ``b`` on; a is not b."""
        x, y = self.inverse[a], self.inverse[b]
        return range_minima(self.minima, np.minimum(x, y).astype(np.int64) + 1, np.maximum(x, y).astype(np.int64))


def next_smaller(values: np.ndarray) -> np.ndarray:
    """Place of the next smaller value of each, the length where there is none; values are distinct.

    Most are found within a few steps; for the rest, minima of doubling
    stretches are jumped over while they are no smaller.
    """
    n = len(values)
    found = np.full(n, n, np.int64)
    at = np.arange(n)
    for d in range(1, 9):
        at = at[at + d < n]
        hit = values[at + d] < values[at]
        found[at[hit]] = at[hit] + d
        at = at[~hit]
    if len(at):
        levels = sparse_minima(values)
        place = at + 9
        for k in range(len(levels) - 1, -1, -1):
            inside = place + (1 << k) <= n
            jump = inside & (levels[k][np.where(inside, place, 0)] > values[at])
            place = place + jump * (1 << k)
        found[at] = np.minimum(place, n)
    return found


def find_runs(words: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, periods) of all runs of ``least_words`` words and ``least_periods`` (2 or more) periods, by start and period."""
    none = np.zeros(0, np.int64)
    n = len(words)
    if n < 2:
        return none, none, none
    forwards = Extensions(words)
    inverse = forwards.inverse
    i, j = np.concatenate([np.stack([np.arange(n), next_smaller(v)]) for v in (inverse, -inverse)], axis=1)
    ok = j < n
    ok[ok] = words[i[ok]] == words[j[ok]]  # a root that repeats within its run begins again with its first word
    i, j = i[ok], j[ok]
    if not len(i):
        return none, none, none
    p = j - i
    right = forwards.of(i, j).astype(np.int64)
    # of a run of k periods, the first root after its start has k - 2 periods more to its right
    long_enough = right >= (least_periods - 2) * p
    i, j, p, right = (x[long_enough] for x in (i, j, p, right))
    if not len(i):
        return none, none, none
    del forwards
    backwards = Extensions(words[::-1])
    left = np.zeros(len(i), np.int64)
    inner = np.flatnonzero(i > 0)
    left[inner] = backwards.of(n - i[inner], n - j[inner])
    start, length = i - left, left + p + right
    runs = np.unique(np.stack([start, p, length], 1)[(length >= least_words) & (length >= least_periods * p)], axis=0)
    return runs[:, 0], runs[:, 2], runs[:, 1]


def planted(words: list, doc_id: int | None) -> list:
    """The words, of one document in ten with a stretch repeated up to the end; a null doc_id leaves them as they are."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def describe(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """The columns of ``RESULT`` from a document's words and its (start, length, period)."""
    best = None
    for start, length, period in runs:
        if best is None or length * best[2] > best[1] * period or (length * best[2] == best[1] * period and (start, period) < (best[0], best[2])):
            best = (start, length, period)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    if runs:
        edges = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            edges[start + period] += 1
            edges[start + length] -= 1
        words = [w for w, dropped in zip(words, np.cumsum(edges[:-1]).tolist(), strict=True) if not dropped]
    digests = hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *shown, *digests)


def runs_of_documents(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = pd.factorize(np.array([w for t in texts for w in t], object))[0].astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    starts, lengths, periods = find_runs(owner * (len(codes) + 1) + codes)
    firsts = np.cumsum(sizes) - sizes
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for s, n, p in zip(starts.tolist(), lengths.tolist(), periods.tolist(), strict=True):
        d = int(owner[s])
        found[d].append((s - int(firsts[d]), n, p))
    return found


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """doc_id and the columns of ``RESULT`` for every row of ``docs`` (doc_id, text); other columns are ignored.

    Words are runs of anything but ASCII white space; a null text has none, no
    runs and the digests of nothing.  ``start``, ``length``, ``period`` and
    ``exponent_milli`` are those of the run of the greatest length/period, the
    first of ties, and null without a run; ``runs_sha256`` is over all runs,
    ``collapsed_sha256`` over the text without what repeats its run's first
    period.  ``plant`` repeats a stretch in one document in ten, by doc_id.
    Rows are independent, so repeated rows give repeated results and nothing
    is shuffled; a document is worked on whole, in memory of about 200 bytes a
    word, and short ones together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *(c.split()[0] for c in RESULT.split(", "))]
        kinds = [pa.int64()] * 6 + [pa.string()] * 2

        def rows(ids: list, texts: list) -> pa.RecordBatch:
            found = [describe(t, r) for t, r in zip(texts, runs_of_documents(texts), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([ids, *zip(*found, strict=True)], kinds, strict=True)], names)

        for batch in batches:
            ids, texts, held = [], [], 0
            for key, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                key = key.as_py()
                words = (text.as_py() or "").encode().split()
                words = planted(words, key) if plant else words
                if held and held + len(words) > WORDS_AT_ONCE:
                    yield rows(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(key)
                texts.append(words)
                held += len(words)
            if ids:
                yield rows(ids, texts)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, f"doc_id long, {RESULT}")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), plant=True)
