"""Signature trees: exact search for sets of high Jaccard similarity.

A leaf is a set with a bitmap of its tokens and its size; a node holds the
bitmaps of eight children OR-combined, and the range of their sizes.  A dual
traversal goes down from the root with pairs of nodes.  The tokens that two
sets share fall on bits that both bitmaps have; a set has ``slack`` more tokens
than bits, so no two sets below a pair of nodes share more than the bits that
the nodes have in common and the lesser slack.  A pair of nodes whose maximum
overlap is too small for its smallest sizes, or whose sizes are too far apart,
is pruned with all below it.  What is left at the leaves is compared exactly.

``links_in_groups`` deals groups of sets to tasks.  A group of more sets than a
task is to hold is cut into blocks, the top nodes of its tree: each block is
searched on its own, together with a few pivots of the group, and what that
links becomes a class.  Then pairs of blocks are searched, those of members of
one class left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, shuffle_partitions
from .components import connected_components

FANOUT = 8
#: Sets and tokens of a block; a set of more tokens is a block of its own.
BLOCK_SETS, BLOCK_TOKENS = 1024, 1 << 20
#: Bits of a bitmap for each token of the largest set: so many that nodes of eight unrelated sets each have few in common.
BITS_A_TOKEN = 128
#: Pivots of each size class of a group of several blocks.
PIVOTS = 16
#: Words of bitmaps compared at once.
WORDS_AT_ONCE = 1 << 21
TASK = ("task", "side", "fp", "class", "tokens")


def overlap_needed(total: np.ndarray, least: Fraction) -> np.ndarray:
    """The smallest overlap with a similarity of ``least`` for two sets of ``total`` tokens together."""
    return -(-total * least.numerator // (least.numerator + least.denominator))


@lru_cache(8)
def class_bounds(least: Fraction) -> np.ndarray:
    """The first size of every size class: sets of similarity ``least`` are in one class or in two that follow."""
    bounds = [0, 1]
    while bounds[-1] <= 1 << 40:
        bounds.append(max(bounds[-1] + 1, (bounds[-1] - 1) * least.denominator // least.numerator + 1))
    return np.array(bounds)


def size_class(size: int, least: Fraction) -> int:
    return int(np.searchsorted(class_bounds(least), size, "right")) - 1


class Tree:
    """Levels of nodes over sets, leaves first: bitmaps, size ranges, slack, class and side ranges."""

    def __init__(self, sets: list[np.ndarray], classes: np.ndarray, sides: np.ndarray):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        bits = 1 << max(8, min(22, int(BITS_A_TOKEN * self.sizes.max(initial=1) - 1).bit_length()))
        signatures = np.zeros((len(sets), bits // 64), np.uint64)
        plain = np.zeros(bits, np.uint8)
        for i, s in enumerate(sets):
            at = (s & np.uint64(bits - 1)).astype(np.int64)
            plain[at] = 1
            signatures[i] = np.packbits(plain).view(np.uint64)
            plain[at] = 0
        slack = self.sizes - np.bitwise_count(signatures).sum(axis=1, dtype=np.int64)
        self.levels = [(signatures, self.sizes, self.sizes, slack, classes, classes, sides, sides)]
        ways = (np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum, np.minimum, np.maximum)
        while len(self.levels[-1][0]) > 1:
            firsts = np.arange(0, len(self.levels[-1][0]), FANOUT)
            self.levels.append(tuple(way.reduceat(x, firsts, axis=0) for way, x in zip(ways, self.levels[-1], strict=True)))

    def may_hold(self, level: int, i: np.ndarray, j: np.ndarray, least: Fraction, sided: bool) -> np.ndarray:
        """Whether sets below nodes i and j of a level may be similar and of different classes (and sides)."""
        signatures, lo, hi, slack, class_lo, class_hi, side_lo, side_hi = self.levels[level]
        num, den = least.numerator, least.denominator
        found = (den * hi[i] >= num * lo[j]) & (den * hi[j] >= num * lo[i])
        found &= (class_lo[i] != class_hi[j]) | (class_hi[i] != class_lo[j])
        if sided:
            found &= (side_lo[i] != side_hi[j]) | (side_hi[i] != side_lo[j])
        at = np.flatnonzero(found)
        step = max(1, WORDS_AT_ONCE // signatures.shape[1])
        for part in (at[k : k + step] for k in range(0, len(at), step)):
            a, b = i[part], j[part]
            common = np.bitwise_count(signatures[a] & signatures[b]).sum(axis=1, dtype=np.int64)
            found[part] = common + np.minimum(slack[a], slack[b]) >= overlap_needed(lo[a] + lo[b], least)
        return found

    def candidates(self, least: Fraction, sided: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of leaves i < j that the dual traversal leaves, by i."""
        i = j = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, 0, -1):
            keep = self.may_hold(level, i, j, least, sided)
            i, j = i[keep], j[keep]
            below = len(self.levels[level - 1][0])
            c, d = np.divmod(np.arange(FANOUT * FANOUT), FANOUT)
            i, j = ((x[:, None] * FANOUT + y).ravel() for x, y in ((i, c), (j, d)))
            inside = (i < below) & (j < below) & ((i < j) if level == 1 else (i <= j))
            i, j = i[inside], j[inside]
        if len(self.levels) == 1:
            return i[:0], j[:0]
        order = np.lexsort((j, i))
        return i[order], j[order]

    def close(self, i: int, js: np.ndarray, least: Fraction) -> np.ndarray:
        """Which of the leaves ``js`` may be similar to leaf i by the bits that one has and the other has not."""
        signatures, num = self.levels[0][0], overlap_needed(self.sizes[i] + self.sizes[js], least)
        found = np.zeros(len(js), bool)
        step = max(1, WORDS_AT_ONCE // signatures.shape[1])
        for k in range(0, len(js), step):
            other = signatures[js[k : k + step]]
            common = np.bitwise_count(other & signatures[i]).sum(axis=1, dtype=np.int64)
            lacks = [np.bitwise_count(x).sum(axis=-1, dtype=np.int64) - common for x in (signatures[i], other)]
            most = np.minimum(self.sizes[i] - lacks[0], self.sizes[js[k : k + step]] - lacks[1])
            found[k : k + step] = most >= num[k : k + step]
        return found


def similar(x: np.ndarray, y: np.ndarray, least: Fraction) -> bool:
    """Whether two sorted sets have Jaccard similarity ``least`` or more."""
    if len(x) > len(y):
        x, y = y, x
    if least.denominator * len(x) < least.numerator * len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return least.denominator * both >= least.numerator * (len(x) + len(y) - both)


def links_among(sets: list[np.ndarray], classes: np.ndarray, sides: np.ndarray, least: Fraction) -> list[tuple[int, int]]:
    """Pairs that connect what similar pairs connect, members of one class being connected beforehand.

    Where both sides occur, only pairs across them are looked for.  A pair of
    members that are connected by then is not compared, so a dense group costs
    little more than its size.
    """
    if len(sets) < 2:
        return []
    order = np.lexsort(([int(s[0]) if len(s) else 0 for s in sets], [len(s) for s in sets], sides))
    sets = [sets[k] for k in order]
    labels = np.unique(classes[order], return_inverse=True)[1]
    sides = sides[order]
    tree = Tree(sets, labels, sides)
    i, j = tree.candidates(least, bool(sides.min() != sides.max()))
    starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else []
    links, labels = [], labels.copy()
    for lo, hi in zip(starts, [*starts[1:], len(i)], strict=True):
        own, js = int(i[lo]), j[lo:hi]
        js = js[labels[js] != labels[own]]
        if sides[0] != sides[-1]:
            js = js[sides[js] != sides[own]]
        for other in js[tree.close(own, js, least)].tolist() if len(js) else ():
            if labels[other] != labels[own] and similar(sets[own], sets[other], least):
                links.append((int(order[own]), int(order[other])))
                labels[labels == labels[other]] = labels[own]
    return links


def search_tasks(rows: DataFrame, least: Fraction) -> DataFrame:
    """(u, v): verified links of every task's sets, from (task, side, fp, class, tokens); a task has at most two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, fps, sets, classes, sides = None, [], [], [], []

        def links() -> pa.RecordBatch:
            pairs = links_among(sets, np.array(classes, np.int64), np.array(sides, np.int64), least)
            return pa.RecordBatch.from_arrays([pa.array([fps[p[k]] for p in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])

        for batch in batches:
            values = batch.column("tokens").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            bounds = np.r_[0, np.cumsum(batch.column("tokens").value_lengths().to_numpy(zero_copy_only=False))]
            small = (batch.column(c).to_pylist() for c in TASK[:-1])
            for k, (name, side, fp, known) in enumerate(zip(*small, strict=True)):
                if name != task:
                    yield links()
                    task, fps, sets, classes, sides = name, [], [], [], []
                if fps and fps[-1] == fp:
                    continue  # a repeated row
                fps.append(fp)
                sets.append(values[bounds[k] : bounds[k + 1]].copy())
                classes.append(known)
                sides.append(side)
        yield links()

    dealt = rows.select(*TASK).repartition(shuffle_partitions(rows.sparkSession), "task").sortWithinPartitions("task", "fp", "side")
    return dealt.mapInArrow(run, "u long, v long")


def parts_of(n: Column, tokens: Column) -> Column:
    """How many blocks so many sets and tokens take."""
    return F.ceil(F.greatest(n / BLOCK_SETS, tokens / BLOCK_TOKENS)).cast("int")


def name(*parts: Column | str) -> Column:
    return F.xxhash64(*parts)


def with_tokens(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of (task, side, fp, class) with the tokens of ``sets`` (group, fp, tokens); all planning is done before, without them."""
    return rows.join(sets.drop("group"), "fp").select(*TASK)


def group_tasks(sets: DataFrame) -> DataFrame:
    """A task for each group."""
    return sets.select(F.col("group").alias("task"), F.lit(0).alias("side"), "fp", F.col("fp").alias("class"), "tokens")


def links_in_groups(members: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """(u, v): links that connect all that pairs of similarity ``least`` connect within each group.

    ``members`` has group, fp, size and k, the set's ``size_class``; ``sets``
    has group, fp and tokens (sorted, distinct).  Both are materialised; fp
    tells sets apart.  No task holds more than two blocks and the pivots.
    """
    sizes = members.groupBy("group", "k").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("tokens"))
    own = Window.partitionBy("group")
    large = parts_of(F.sum("n").over(own), F.sum("tokens").over(own)) > 1
    sizes = materialise(sizes.withColumn("large", large).where("large").select("group", "k", parts_of(F.col("n"), F.col("tokens")).alias("parts")), "large-groups")
    if sizes.isEmpty():
        return search_tasks(group_tasks(sets), least)
    small = sets.join(sizes.select("group").distinct(), "group", "left_anti")
    placed = members.join(sizes, ["group", "k"]).select("group", "k", "fp", "size", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"))
    return search_tasks(group_tasks(small), least).unionByName(links_of_blocks(materialise(placed, "placed"), sets, least))


def links_of_blocks(large: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """Links of groups of several blocks, from (group, k, fp, size, part)."""
    bucket = F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(PIVOTS))
    pivots = large.groupBy("group", "k", bucket.alias("bucket")).agg(F.min("fp").alias("fp")).drop("bucket")
    blocks = large.select("group", F.col("k").alias("_k"), "part").distinct()
    lent = pivots.join(blocks, "group").where(F.col("_k").between(F.col("k"), F.col("k") + 1))
    inner = large.select(name("group", "k", "part").alias("task"), "fp").union(lent.select(name("group", "_k", "part"), "fp"))
    inner = inner.select("task", F.lit(0).alias("side"), "fp", F.col("fp").alias("class"))
    found = materialise(search_tasks(with_tokens(inner, sets), least), "block-links")
    classes = connected_components(found)
    known = large.join(classes.withColumnRenamed("node", "fp"), "fp", "left").select("group", "k", "fp", "size", F.coalesce("component", "fp").alias("class"))
    # large classes have blocks of their own, the others share some
    counts = known.groupBy("group", "k", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("tokens"))
    counts = materialise(counts.withColumn("alone", F.when(parts_of(F.col("n"), F.col("tokens")) > 1, F.col("class"))), "class-sizes")
    pool = name("group", "k", F.coalesce("alone", F.lit(0)), F.col("alone").isNull()).alias("pool")
    pools = materialise(counts.groupBy("group", "k", "alone", pool).agg(parts_of(F.sum("n"), F.sum("tokens")).alias("parts")), "pools")
    own = counts.select("group", "k", "class", pool).join(pools.select("pool", "parts"), "pool")
    pooled = known.join(own, ["group", "k", "class"]).select("fp", "class", "pool", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"))
    rows = pooled.join(block_pairs(pools), ["pool", "part"]).select("task", "side", "fp", "class")
    across = materialise(search_tasks(with_tokens(rows, sets), least), "links-across")
    discard(counts, pools, classes)
    return found.unionByName(across)


def block_pairs(pools: DataFrame) -> DataFrame:
    """(task, side, pool, part): the pairs of blocks that may hold links between classes, from (group, k, alone, pool, parts)."""
    a, b = pools.alias("a"), pools.alias("b")
    one_class = F.col("a.alone").isNotNull() & F.col("a.alone").eqNullSafe(F.col("b.alone"))
    later = (F.col("b.k") == F.col("a.k") + 1) | ((F.col("a.k") == F.col("b.k")) & (F.col("a.pool") <= F.col("b.pool")))
    met = a.join(b, F.col("a.group") == F.col("b.group")).where(~one_class & later)
    pairs = met.select(F.col("a.pool").alias("pa"), F.col("b.pool").alias("pb"), F.explode(F.sequence(F.lit(0), F.col("a.parts") - 1)).alias("x"), F.col("b.parts").alias("n"))
    pairs = pairs.select("pa", "pb", "x", F.explode(F.sequence(F.when(F.col("pa") == F.col("pb"), F.col("x")).otherwise(0), F.col("n") - 1)).alias("y"))
    side = lambda at, pool, part: (name("pa", "pb", "x", "y").alias("task"), F.lit(at).alias("side"), F.col(pool).alias("pool"), F.col(part).alias("part"))
    # a block paired with itself is one side
    return pairs.select(*side(0, "pa", "x")).union(pairs.where("pa <> pb or x <> y").select(*side(1, "pb", "y")))
