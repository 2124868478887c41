"""Near copies by exact Jaccard similarity of word shingles.

Candidates come from SimHash fingerprints of the sets, searched by Golay-code
keys as in ``simhash``: fingerprints at most 3 bits apart.  But a 64-bit
fingerprint spreads texts of Jaccard 0.8 over more bits than a search by radius
can reach, so MinHash bands add the candidates beyond: texts that agree in all
``ROWS`` minima of one of ``BANDS`` bands share a key.  Texts that either of
them brings together, over others or directly, make up a group, and within a
group all pairs are searched exactly with signature trees.  A pair of similarity s shares a key
with probability 1 - (1 - s**ROWS)**BANDS, 0.9998 at 0.8; links below the
wanted similarity don't occur.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngram_join
from .common import materialise
from .ngram_join import mixed
from .simhash import SHINGLE_BLOCK, bit_counts, fingerprint_links, majority

WORDS = 5
SIMILARITY = Fraction(8, 10)
BANDS, ROWS = 28, 6
#: Shingles minimised at once; bounds memory for very long texts.
BLOCK = 1 << 10
_ODD = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS + ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(shingles: np.ndarray, least: Fraction = SIMILARITY) -> np.ndarray:
    """One key a band, none for an empty set; the bands are for ``SIMILARITY``."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    minima = np.full(BANDS * ROWS, ~np.uint64(0))
    for lo in range(0, len(shingles), BLOCK):
        np.minimum(minima, (_ODD[ROWS:, None] * shingles[None, lo : lo + BLOCK]).min(axis=1), out=minima)
    sums = (mixed(minima).reshape(BANDS, ROWS) * _ODD[:ROWS]).sum(axis=1, dtype=np.uint64)
    return mixed(sums + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def set_fingerprint(shingles: np.ndarray) -> int:
    """SimHash of a set: the bits that over half of its shingles' hashes have."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(shingles), SHINGLE_BLOCK):
        counts += bit_counts(shingles[lo : lo + SHINGLE_BLOCK])
    return majority(counts, len(shingles))


def set_prints(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, n, k, keys, sim) of every row and the columns ``keep``; fp is the hash of the whole set, 0 of an empty one, sim its SimHash."""
    return ngram_join.set_prints(docs, keep, WORDS, SIMILARITY, band_keys, set_fingerprint)


def simhash_links(prints: DataFrame) -> DataFrame:
    """(u, v): hashes of sets whose SimHashes are equal or linked by Golay-code keys and at most 3 bits; from (fp, n, sim)."""
    sets = prints.where("n > 0").select("sim", "fp").distinct()
    leads = materialise(sets.groupBy("sim").agg(F.min("fp").alias("lead")), "simhash-leads")
    of = lambda c: leads.select(F.col("sim").alias(c), F.col("lead").alias(f"_{c}"))
    near = fingerprint_links(leads.select(F.col("sim").alias("fp")))
    linked = near.join(of("u"), "u").join(of("v"), "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
    equal = sets.join(leads, "sim").where("fp != lead").select(F.col("lead").alias("u"), F.col("fp").alias("v"))
    return linked.unionByName(equal)


def set_links(prints: DataFrame, docs: DataFrame) -> DataFrame:
    """(u, v): hashes of sets that are connected by pairs of ``SIMILARITY`` or more.

    ``prints`` is as of ``set_prints``, with _key; ``docs`` has _key and text of
    the same rows.
    """
    return ngram_join.jaccard_links(prints, docs, WORDS, SIMILARITY, simhash_links(prints))
