"""Jaccard self-join of the word n-grams of documents.

Sets that are linked are first brought together without losing any: a set has
keys such that two linked sets share one (``part_keys``), and sets that share
keys, over others or directly, make up a group.  Within a group all pairs are
searched with signature trees (``signature_tree``).  Equal sets count as one
throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, shuffle_partitions, table
from .components import connected_components
from .signature_tree import class_bounds, links_in_groups, size_class
from .simhash import LOWER, near_duplicate_components

WORDS = 3
SIMILARITY = Fraction(90, 100)
#: Keys that are combined at once before they are dealt out, and tokens sent on at once.
KEYS_AT_ONCE, TOKENS_AT_ONCE = 1 << 18, 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> np.uint64(33)) * np.uint64(factor)
    return x ^ x >> np.uint64(33)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles, A-Z lower-cased; a shorter text is one shingle."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total = mixed(total + hashes[i : i + n])
    return np.unique(total)


@lru_cache(4096)
def part_starts(level: int, least: Fraction) -> tuple[np.ndarray, int]:
    """(first token of every part but the first, how many keys a set may leave out) at a level of sizes."""
    largest = int(class_bounds(least)[level + 1]) - 1
    # linked sets of this level have so many tokens that only one of them has, at most
    apart = 2 * largest * (least.denominator - least.numerator) // (least.denominator + least.numerator)
    spare = apart // 16
    parts = apart + 1 + 2 * spare if apart else 0
    return np.array([(p << 64) // parts for p in range(1, parts)], np.uint64), spare


def part_keys(tokens: np.ndarray, least: Fraction) -> np.ndarray:
    """Keys of a set of sorted tokens: two different sets of similarity ``least`` or more share one.

    The range of the tokens, which are hashes, is cut into parts, and a part's
    key is the hash of the tokens in it.  Sets that differ in ``apart`` tokens
    agree in all parts but so many, so of ``apart + 1`` parts in one, and of
    ``2 * spare`` more in one that neither set leaves out if each leaves out
    ``spare`` of its keys: those of the fewest tokens, which tell least.  The
    number of parts goes by classes of sizes; a set has the keys of its own
    class and of the next, whose members may be linked to it too.
    """
    if not len(tokens):
        return np.zeros(0, np.int64)
    own, sums, found = size_class(len(tokens), least), np.r_[np.uint64(0), np.cumsum(mixed(tokens))], []
    for level in (own, own + 1):
        starts, spare = part_starts(level, least)
        if not len(starts):
            continue
        bounds = np.r_[0, np.searchsorted(tokens, starts), len(tokens)]
        salt = mixed(np.arange(len(starts) + 1, dtype=np.uint64) + (np.uint64(level + 1) << np.uint64(40)))
        keys = mixed(sums[bounds[1:]] - sums[bounds[:-1]] + salt)
        found.append(keys[np.argsort(np.diff(bounds), kind="stable")[spare:]])
    return np.concatenate(found or [np.zeros(0, np.uint64)]).view(np.int64)


def set_prints(docs: DataFrame, keep: tuple[str, ...], width: int, least: Fraction, keys_of: Callable[[np.ndarray, Fraction], np.ndarray], sim_of: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """(doc_id, fp, n, k, keys) of every row and the columns ``keep``; fp is the hash of the whole set of n shingles, 0 of an empty one, k its class of sizes.

    With ``sim_of`` there is a column sim, what it makes of the set.
    """
    named = ["doc_id", "fp", "n", "k", "keys", *(["sim"] if sim_of else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes, keys, sims = [], [], [], []
            for text in batch.column("text"):
                found = shingle_set(text.as_py(), width)
                fps.append(xxhash.xxh64_intdigest(found.tobytes()) if len(found) else 0)
                sizes.append(len(found))
                keys.append(keys_of(found, least))
                if sim_of:
                    sims.append(sim_of(found))
            ids, kept = batch.column("doc_id").cast(pa.int64()), [batch.column(k) for k in keep]
            columns = [ids, pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array([size_class(n, least) for n in sizes], pa.int32()), pa.array(keys, pa.list_(pa.int64())), *([pa.array(sims, pa.int64())] if sim_of else []), *kept]
            yield pa.RecordBatch.from_arrays(columns, [*named, *keep])

    schema = "".join(f", `{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select("doc_id", "text", *keep).mapInArrow(run, f"doc_id long, fp long, n long, k int, keys array<long>{', sim long' if sim_of else ''}{schema}")


def combine_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp, other): of many keys at once one row each, and for every other fp of a key a row that links it."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def rows() -> pa.RecordBatch:
        keys, fps = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((fps, keys))
        keys, fps = keys[order], fps[order]
        first = np.r_[True, keys[1:] != keys[:-1]]
        leader = fps[np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))]
        links = np.unique(np.stack([leader, fps], 1)[leader != fps], axis=0)
        lead = [pa.array(keys[first]), pa.array(fps[first]), pa.nulls(int(first.sum()), pa.int64())]
        tell = [pa.array(mixed(links[:, 1].view(np.uint64)).view(np.int64)), pa.array(links[:, 0]), pa.array(links[:, 1])]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(lead, tell, strict=True)], ["key", "fp", "other"])

    n = 0
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False)
        lengths = batch.column("keys").value_lengths().to_numpy(zero_copy_only=False)
        held.append((batch.column("keys").flatten().to_numpy(zero_copy_only=False), np.repeat(fps, lengths)))
        n += len(held[-1][0])
        if n >= KEYS_AT_ONCE:
            yield rows()
            held, n = [], 0
    if n:
        yield rows()


def lead_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): each fp of a key linked to the key's first; rows come by key and fp, a key may go on in the next batch."""
    key, leader = None, 0
    for batch in batches:
        told = pc.is_valid(batch.column("other"))
        us, vs = ([batch.column(c).filter(told).to_numpy(zero_copy_only=False)] for c in ("fp", "other"))
        own = batch.filter(pc.invert(told))
        keys, fps = (own.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp"))
        if len(keys):
            first = np.r_[key is None or keys[0] != key, keys[1:] != keys[:-1]]
            at = np.maximum.accumulate(np.where(first, np.arange(len(keys)), -1))
            leaders = np.where(at < 0, leader, fps[np.maximum(at, 0)])
            us.append(leaders[leaders != fps])
            vs.append(fps[leaders != fps])
            key, leader = keys[-1], leaders[-1]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])


def candidate_groups(prints: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(node, component): the sets that share keys with others or are linked by ``more`` (u, v), and their group; from (fp, keys).

    A key that many rows have is combined before the shuffle, to a row for
    ``KEYS_AT_ONCE`` keys.
    """
    keys = prints.select("fp", "keys").mapInArrow(combine_keys, "key long, fp long, other long")
    dealt = keys.repartition(shuffle_partitions(prints.sparkSession), "key").sortWithinPartitions("key", "fp")
    links = dealt.mapInArrow(lead_links, "u long, v long")
    return connected_components(links if more is None else links.unionByName(more))


def sets_read_again(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """(group, fp, tokens) of ``members`` (group, fp, _key), from the text of one row of each in ``docs`` (_key, text).

    Members grow with the documents, so both are dealt out by key at any size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of repeated rows one a task goes on

        def rows(groups: list, fps: list, sets: list) -> pa.RecordBatch:
            ends = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
            tokens = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(fps, pa.int64()), tokens], ["group", "fp", "tokens"])

        for batch in batches:
            groups, fps, sets, n = [], [], [], 0
            for group, fp, text in zip(*(batch.column(c) for c in ("group", "fp", "text")), strict=True):
                if fp.as_py() in seen:
                    continue
                seen.add(fp.as_py())
                groups.append(group.as_py())
                fps.append(fp.as_py())
                sets.append(shingle_set(text.as_py(), width))
                n += len(sets[-1])
                if n >= TOKENS_AT_ONCE:
                    yield rows(groups, fps, sets)
                    groups, fps, sets, n = [], [], [], 0
            if n:
                yield rows(groups, fps, sets)

    texts = docs.select("_key", "text").join(members.select("_key", "group", "fp").hint("merge"), "_key").select("group", "fp", "text")
    return texts.mapInArrow(run, "group long, fp long, tokens array<long>")


def jaccard_links(prints: DataFrame, docs: DataFrame, width: int, least: Fraction, more: DataFrame | None = None) -> DataFrame:
    """(u, v): hashes of sets that are connected by pairs of similarity ``least`` or more, enough to connect all such.

    ``prints`` has fp, n, k, keys and _key, ``docs`` _key and text of the same
    rows; only one row of each set that shares keys with others is read again.
    ``more`` (u, v) are further candidates.
    """
    groups = candidate_groups(prints, more)
    one = prints.where("n > 0").groupBy("fp", "n", "k").agg(F.min("_key").alias("_key"))
    members = one.join(groups, one["fp"] == groups["node"]).select("_key", "fp", F.col("component").alias("group"), F.col("n").alias("size"), "k")
    members = materialise(members, "members")
    sets = materialise(sets_read_again(docs, members, width), "candidate-sets")
    discard(groups)
    return links_in_groups(members, sets, least)


def ngram_components(docs: DataFrame, width: int = WORDS, least: Fraction = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text); other columns are ignored.

    Two documents are linked when the sets of their shingles of ``width`` words
    have a Jaccard similarity of ``least`` or more; a text of fewer words is one
    shingle.  ``component_id`` is the smallest doc_id that links reach, itself
    included.  A document without words, null included, has an empty set and is
    linked with nothing, so its component is its own.  A null doc_id is in its
    component like any other and never its smallest id, unless there is no
    other.  Repeated rows all stay; an empty table gives an empty result.
    Shingles are compared by 64-bit hashes.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_key", F.xxhash64("doc_id", "text"))
    prints = materialise(set_prints(keyed, ("_key",), width, least, part_keys), "ngram-prints")
    links = jaccard_links(prints, keyed, width, least)
    found = near_duplicate_components(prints.select("doc_id", "fp", "n"), links)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))
