"""Connected components of links between documents.

Up to IN_ONE_TASK links (their number is counted first, 16 bytes each) one task joins them; more are
contracted by alternating large and small stars.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


IN_ONE_TASK = 2_000_000


def joined(u: np.ndarray, v: np.ndarray):
    """(node, component) of the links, by union of the lesser root."""
    nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = index[: len(u)], index[len(u) :]
    root = np.arange(len(nodes))
    while True:  # hook greater roots to lesser ones, then shorten
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while (root[root] != root).any():
            root = root[root]
    for lo in range(0, len(nodes), 200_000):
        part = slice(lo, lo + 200_000)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(nodes[root[part]])], names=["node", "component"])


def _joined(batches):
    parts = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches if b.num_rows]
    if parts:
        yield from joined(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node hands its least neighbour (or itself) to its larger neighbours, or to its smaller ones and itself.

    The least is aggregated on the map side before the join, so that a node with many links is
    no burden for one task.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    handed = near.join(least, "u")
    out = handed.where("v > u").select("v", "m") if large else handed.select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m"))
    return out.where("v != m").select(F.col("m").alias("u"), "v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """(node, component): the least node that can be reached, for every node with a link. links: (u, v), any direction."""
    links = links.where("u != v").select("u", "v")
    if links.count() <= in_one_task:
        return links.coalesce(1).mapInArrow(_joined, "node long, component long")
    edges = stored(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "stars")
    state = _state(edges)
    while state[0]:
        edges = stored(_star(_star(edges, True), False), "stars")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
