"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments A (23 bits), B (23) and C (18).  The
binary Golay code (23, 12, 7) is perfect: a 23-bit word decodes to one codeword
at most 3 bits away, and a word exactly 3 away has 5 more codewords at distance
4.  Indexed under those 1 or 6 codewords, any two words at most 2 bits apart
share an index (``tests`` check this for all cases up to translation).

Two fingerprints that differ in at most 3 bits, a, b and c of them in A, B and
C, then share at least one composite key:

====  ==========================  =======================================
key   made of                     meets when
====  ==========================  =======================================
1     C exact, indices of A       c = 0, a <= 2
2     B exact, C exact            b = c = 0
3     A exact, indices of B       a = 0, b <= 2
4     B exact, indices of A       b = 0, a <= 2
5     indices of A and B          a = b = c = 1; the parities of the three
                                  segments all flip, so which of them agree
                                  is part of the key
====  ==========================  =======================================

c = 0 leaves a <= 2 (key 1) or a = 3, b = 0 (key 2).  c >= 1 leaves a + b <= 2:
a = 0 (key 3), b = 0 (key 4) or a = b = 1, hence c = 1 (key 5).  So the search
is exact.  Keys are joined by sorting, candidates verified bit by bit, and a
key's rows yield at most a spanning forest, never all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, join_on_key, materialise, shuffle_partitions, table
from .components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 3
HASH_SEED = 42
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, fixed by the code
N, K = 23, 12
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Runs of equal keys up to this length are compared pair by pair in numpy, longer ones by search.
SHORT_RUN = 8
#: Longer runs are first told apart by the bits in which their members differ.
LONG_RUN = 512
#: Shingles hashed at once; bounds memory for very long texts.
SHINGLE_BLOCK = 1 << 16


def golay_syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words divided by the generator polynomial."""
    rest = words.astype(np.int64)
    for bit in range(N - 1, N - K - 1, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - (N - K))), rest)
    return rest


def coset_table() -> np.ndarray:
    """For each syndrome, the error patterns of weight 4 or less, -1 where fewer than 6."""
    found = np.full((1 << (N - K), 6), -1, np.int64)
    bits = 1 << np.arange(N, dtype=np.int64)
    level = np.zeros(1, np.int64)
    patterns = [level]
    for _ in range(4):
        level = np.unique((level[:, None] | bits[None, :])[(level[:, None] & bits[None, :]) == 0])
        patterns.append(level)
    filled = np.zeros(1 << (N - K), np.int64)
    for p in np.concatenate(patterns):
        s = int(golay_syndrome(np.array([p]))[0])
        found[s, filled[s]] = p
        filled[s] += 1
    return found


_COSETS: list[np.ndarray] = []


def golay_indices(words: np.ndarray) -> np.ndarray:
    """(n, 6) indices of the codewords within 4 bits of each word, -1 for none."""
    if not _COSETS:
        _COSETS.append(coset_table())
    patterns = _COSETS[0][golay_syndrome(words)]
    return np.where(patterns >= 0, (words[:, None] ^ patterns) >> (N - K), -1)


def parity(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).astype(np.int64) & 1


def fuzzy_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, position of the fingerprint each belongs to)."""
    f = fingerprints.view(np.uint64)
    a = (f >> np.uint64(41)).astype(np.int64)
    b = (f >> np.uint64(18) & np.uint64((1 << N) - 1)).astype(np.int64)
    c = (f & np.uint64((1 << 18) - 1)).astype(np.int64)
    ia, ib = golay_indices(a), golay_indices(b)
    flips = (parity(a) ^ parity(b)) << 1 | (parity(a) ^ parity(c))
    rows = np.arange(len(f))
    keys, owners = [], []

    def add(tag: int, value: np.ndarray, ok: np.ndarray) -> None:
        at = np.broadcast_to(rows.reshape((-1,) + (1,) * (value.ndim - 1)), value.shape)
        keys.append((value << 3 | tag)[ok])
        owners.append(at[ok])

    everywhere = np.ones(len(f), bool)
    add(1, c[:, None] << K | ia, ia >= 0)
    add(2, b << 18 | c, everywhere)
    add(3, a[:, None] << K | ib, ib >= 0)
    add(4, b[:, None] << K | ia, ia >= 0)
    both = (ia[:, :, None] << K | ib[:, None, :]) << 2 | flips[:, None, None]
    add(5, both, (ia[:, :, None] >= 0) & (ib[:, None, :] >= 0))
    return np.concatenate(keys), np.concatenate(owners)


def text_fingerprint(text: str | None) -> int:
    """SimHash of a text's word shingles as a signed 64-bit number."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    width = min(SHINGLE_WORDS, len(words))
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n = len(words) - width + 1
    counts = np.zeros(64, np.int64)
    for lo in range(0, n, SHINGLE_BLOCK):
        part = words[lo : min(n, lo + SHINGLE_BLOCK) + width - 1]
        shingles = zip(*(part[i:] for i in range(width)), strict=False)
        hashes = np.fromiter((digest(join(s), HASH_SEED) for s in shingles), np.uint64, len(part) - width + 1)
        counts += bit_counts(hashes)
    return majority(counts, n)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit ``hashes`` have each bit."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    """The bits that over half of ``n`` hashes have, as a signed 64-bit number."""
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) of every row and the columns ``keep``; null and empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [text_fingerprint(t.as_py()) for t in batch.column("text")]
            kept = [batch.column(k) for k in keep]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fps, pa.int64()), *kept], ["doc_id", "fp", *keep])

    schema = "".join(f", `{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select("doc_id", "text", *keep).mapInArrow(run, f"doc_id long, fp long{schema}")


def emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False)
        for lo in range(0, len(fps), 4096):
            part = fps[lo : lo + 4096]
            keys, owners = fuzzy_keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[owners])], ["key", "fp"])


def near(x: np.ndarray, y: np.ndarray | np.int64) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(x, y).view(np.uint64)) <= MAX_BITS


def spanning_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected among ``fps``.

    Breadth first: what a fingerprint reaches leaves the pool of those not yet
    reached, so a dense group costs its size and not its square, and at most
    ``len(fps) - 1`` links come out.
    """
    us, vs = [], []
    pool = fps
    while len(pool):
        queue, pool = [pool[0]], pool[1:]
        while queue and len(pool):
            at = queue.pop()
            hit = near(pool, at)
            reached = pool[hit]
            if len(reached):
                us.append(np.full(len(reached), at))
                vs.append(reached)
                queue.extend(reached)
                pool = pool[~hit]
    none = np.zeros(0, np.int64)
    return np.concatenate(us or [none]), np.concatenate(vs or [none])


def links_in_long_run(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected in a long run, without comparing all of it with all.

    The bits in which its members differ at all are dealt into ``MAX_BITS + 1``
    groups.  Two members that are near agree in one group wholly, so they meet
    in the run that shares this group's bits.
    """
    differ = np.bitwise_or.reduce(fps ^ fps[0]).view(np.uint64)
    bits = [b for b in range(64) if int(differ) >> b & 1]
    us, vs = [], []
    for group in range(MAX_BITS + 1):
        own = np.uint64(sum(1 << b for b in bits[group :: MAX_BITS + 1]))
        part = (fps.view(np.uint64) & own).view(np.int64)
        order = np.argsort(part, kind="stable")
        u, v = links_in_runs(part[order], fps[order], split=False)
        us.append(u)
        vs.append(v)
    return np.concatenate(us), np.concatenate(vs)


def links_in_runs(keys: np.ndarray, fps: np.ndarray, split: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Verified links between rows of equal key; ``keys`` is sorted, ``split`` tells long runs apart further."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    lengths = np.diff(np.r_[starts, len(keys)])
    us, vs = [], []
    short = np.repeat(lengths <= SHORT_RUN, lengths)
    k, f = keys[short], fps[short]
    for d in range(1, SHORT_RUN):
        at = np.flatnonzero(k[d:] == k[:-d]) if d < len(k) else np.zeros(0, np.int64)
        if not len(at):
            break
        at = at[near(f[at], f[at + d])]
        us.append(f[at])
        vs.append(f[at + d])
    for s, n in zip(starts[lengths > SHORT_RUN], lengths[lengths > SHORT_RUN], strict=True):
        u, v = (links_in_long_run if split and n > LONG_RUN else spanning_links)(fps[s : s + n])
        us.append(u)
        vs.append(v)
    none = np.zeros(0, np.int64)
    return np.concatenate(us or [none]), np.concatenate(vs or [none])


def emit_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from rows sorted by key; a run of a key may cross batches."""
    keys = fps = np.zeros(0, np.int64)

    def links(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        u, v = links_in_runs(k, f) if len(k) else (k, f)
        pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    parts: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for batch in batches:
        k, f = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp"))
        parts.append((k, f))
        held += len(k)
        if held < 1 << 18 or not len(k):
            continue
        keys, fps = (np.concatenate(x) for x in zip(*parts, strict=True))
        end = int(np.searchsorted(keys, keys[-1]))  # the last run may go on
        if end:
            yield links(keys[:end], fps[:end])
        parts, held = [(keys[end:], fps[end:])], len(keys) - end
    if held:
        keys, fps = (np.concatenate(x) for x in zip(*parts, strict=True))
        yield links(keys, fps)


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """(u, v): links between fingerprints (fp) at most ``MAX_BITS`` apart, enough to connect all such."""
    keyed = prints.select("fp").distinct().mapInArrow(emit_keys, "key long, fp long")
    n = shuffle_partitions(prints.sparkSession)
    return keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(emit_links, "u long, v long")


def near_duplicate_components(prints: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Add ``component_id`` to (doc_id, fp).

    Fingerprints at most 3 bits apart, or those of ``links`` (u, v) if given,
    are linked; ``component_id`` is the
    smallest doc_id that can be reached, itself included.  Equal fingerprints
    count once in the search, so groups of copies cost nothing there.  A null
    doc_id is in its component like any other and never its smallest id, unless
    there is no other; then ``component_id`` is null.  Repeated rows all stay.
    """
    classes = connected_components(fingerprint_links(prints) if links is None else links)
    found = prints.join(classes, prints["fp"] == classes["node"], "left")
    found = materialise(found.select(*prints.columns, F.coalesce("component", "fp").alias("_class")), "classes")
    ids = materialise(found.groupBy("_class").agg(F.min("doc_id").alias("component_id")), "component-ids")
    discard(classes)
    return found.join(ids, "_class").select(*prints.columns, "component_id")


def simhash_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of all documents, other columns ignored."""
    return near_duplicate_components(materialise(fingerprints(docs), "simhash"))


def one_of_each_group(docs: DataFrame, prints_of=None, links_of=None) -> DataFrame:
    """The rows of ``docs`` that are first of their component, columns as they are.

    ``prints_of`` and ``links_of`` take the place of the fingerprints and of the
    search by bits, as ``near_copies.set_prints`` and ``set_links`` do.
    First is the smallest doc_id, null last, and among rows that share it the
    smallest fingerprint and text hash; of rows equal in doc_id and text the one
    whose other columns come first as JSON, so that reruns agree.
    """
    packed = F.struct("*").alias("_doc")
    hashed = docs.select(packed, F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_text"))
    key = lambda i, t: F.xxhash64(i, t)
    prints = materialise((prints_of or fingerprints)(hashed, ("_text",)), "simhash")
    links = links_of(prints.withColumn("_key", key("doc_id", "_text")), hashed.withColumn("_key", key("doc_id", "_text"))) if links_of else None
    reached = near_duplicate_components(prints.select("doc_id", "fp", "_text"), links)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "_text")).alias("m")
    # within a component of null ids alone component_id is null; its rows have one fingerprint or are told apart by it
    firsts = reached.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp"))).agg(first)
    chosen = firsts.select(key("m.doc_id", "m._text").alias("_key"), F.col("m.doc_id").alias("_id"), F.col("m._text").alias("_hash")).distinct()
    counts = prints.groupBy(key("doc_id", "_text").alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    kept = materialise(chosen.join(counts, "_key"), "firsts")
    # one key for the join, the rest as a plain condition: so the rows' one shuffle serves the choice as well
    keyed = hashed.withColumn("_key", key("doc_id", "_text"))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    told = F.to_json(F.struct(*[F.col(f"_doc.`{c}`").alias(f"c{i}") for i, c in enumerate(others)])) if others else F.lit("")

    def one_of(met: DataFrame) -> DataFrame:
        own = met.where(F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_text").eqNullSafe(F.col("_hash")))
        return own.groupBy("_key", "doc_id", "_text").agg(F.min_by("_doc", told).alias("_doc"))

    return join_on_key(keyed, kept, "_key", one_of).select("_doc.*")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
