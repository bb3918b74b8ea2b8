"""Connected components by alternating large-star and small-star steps over locally contracted edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import drop, written


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes of some edges that aren't the smallest."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        # each end's root takes the smaller one of the two; then paths are halved until they are flat
        x, y = root[a], root[b]
        low = np.minimum(x, y)
        if (x == y).all():
            break
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while (root[root] != root).any():
            root = root[root]
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[far], nodes[root[far]]


def _contract(batches):
    """The edges of a task, or of as many batches as hold EDGES, as stars around their smallest nodes."""
    held, size = [], 0

    def out():
        u, v = forest(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for batch in batches:
        held.append([batch.column(k).to_numpy() for k in (0, 1)])
        size += batch.num_rows
        if size >= EDGES:
            yield out()
            held, size = [], 0
    if held:
        yield out()
    held = []
    K.give_back()


#: Edges that a task contracts together.
EDGES = 1_000_000


def contracted(edges: DataFrame) -> DataFrame:
    """Edges(u, v) with the same components: at most one for each node of a task. A common node costs its neighbours, not their square."""
    return edges.mapInArrow(_contract, "u long, v long").distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. edges(u, v) hold u > v. Only a minimum is kept of each neighbourhood: no list is gathered."""
    pairs = edges.select("u", "v")
    if large:
        pairs = pairs.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = pairs.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # the smallest of a neighbourhood keeps its own edge to u
        out = out.unionByName(least.where("m < u").select("u", F.col("m").alias("v")))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _flat(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none to a smaller one."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("low")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("low")))
    bad = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("low").alias("low")).where("up > 1 or (up > 0 and low > 0)")
    return bad.isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(u, v); component is the smallest node reachable.

    Each round is written to the shared folder, so lineage stays short and a lost executor costs
    one round at most. Null ends and loops are left out. The result reads the last
    table, which drop() removes.
    """
    plain = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
    now = written(contracted(plain), "edges")
    large = True
    while not _flat(now):
        after = written(_star(contracted(now) if large else now, large), "edges")
        drop(now)
        now, large = after, not large
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out._scratch_path = now._scratch_path
    return out
