"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, materialise

#: Links of a task that are contracted together; bounds its memory.
LINKS_AT_ONCE = 1 << 20


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from the least node of each component of the links (u, v) to its others."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low < high
        if not open_.any():
            break
        np.minimum.at(root, high[open_], low[open_])
        while (root[root] != root).any():
            root = root[root]
    others = root != np.arange(len(nodes))
    return nodes[root[others]], nodes[others]


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): the links of a task, many at a time, as stars from the least nodes of what they connect."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def rows() -> pa.RecordBatch:
        pairs = stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pairs], ["u", "v"])

    for batch in batches:
        held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v")))
        n += batch.num_rows
        if n >= LINKS_AT_ONCE:
            yield rows()
            held, n = [], 0
    if n:
        yield rows()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (u, v), both long, not null.

    ``component`` is one node of the component, the same for all its members.
    Each round maps every node to whichever of itself and its neighbours comes
    first in that round, and replaces the links by those between the images;
    what has become a loop goes.  Nodes come by their value in odd rounds: where
    links lead from the least node of a group to the others, a group is done at
    once.  In even rounds they come by a hash of the round, so that long chains
    shrink by a constant factor as well.  Before links are dealt out again, the
    tasks that hold them contract them to stars, many links at a time, which
    leaves few rounds.  A round writes two tables, the images and the links
    that are left, and counts the latter as it writes them; the images of all
    rounds are chained at the end.  A hub's neighbours are
    combined before the shuffle, and every join has a table of one row a node
    on its other side, so a hub's partition can be split.
    An empty table of links gives an empty result.
    """

    def written(pairs: DataFrame) -> tuple[DataFrame, int]:
        counted = Observation()
        one_way = pairs.where("u <> v").mapInArrow(contracted, "u long, v long").distinct()
        found = materialise(one_way.observe(counted, F.count(F.lit(1)).alias("n")), "links")
        return found, counted.get["n"]

    links, n = written(links)
    rounds: list[DataFrame] = []
    while n or not rounds:
        step = len(rounds) + 1
        order = lambda c: c if step % 2 else F.xxhash64(c, F.lit(step))
        rank = lambda c: F.struct(order(F.col(c)).alias("h"), F.col(c).alias("n"))
        sides = links.select("u", "v").union(links.select("v", "u"))
        images = sides.groupBy("u").agg(F.least(F.min(rank("v")), F.min(rank("u"))).alias("m"))
        images = materialise(images.select(F.col("u").alias("node"), F.col("m.n").alias("image")), "images")
        rounds.append(images)
        of = lambda end: images.select(F.col("node").alias(end), F.col("image").alias(f"i{end}"))  # noqa: B023, E731
        moved = links.join(of("u"), "u").join(of("v"), "v").select(F.col("iu").alias("u"), F.col("iv").alias("v"))
        before, (links, n) = links, written(moved)
        discard(before)
    discard(links)
    if len(rounds) == 1:
        return _named(rounds[0])
    found = rounds[0]
    for later in rounds[1:]:
        known = later.select(F.col("node").alias("image"), F.col("image").alias("_to"))
        found = found.join(known, "image", "left").select("node", F.coalesce("_to", "image").alias("image"))
    whole = materialise(found, "components")
    discard(*rounds)
    return _named(whole)


def _named(images: DataFrame) -> DataFrame:
    found = images.select("node", F.col("image").alias("component"))
    found._materialised = images._materialised
    return found
