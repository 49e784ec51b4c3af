"""Connected components: of edges in memory, and of edge tables by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwerk.plans.tables import checkpointed

#: Edges (16 bytes each) that one task may hold.
FEW = 500_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) of the graph of edges (u, v), without loops."""
    if not len(u):
        return u[:0], v[:0]
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    at = at.astype(np.int32)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes), dtype=np.int32)
    while len(a):
        # a and b are roots: the higher hangs itself on the least root that an edge joins it to, trees are
        # flattened, and edges go on between the roots that are left. A root is the least node of its tree.
        up = np.arange(len(nodes), dtype=np.int32)
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (short := up[up]).tobytes() != up.tobytes():
            up = short
        label, a, b = up[label], up[a], up[b]
        open_ = a != b
        a, b = a[open_], b[open_]
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and root of all edges that come."""
    parts = [(b["u"].to_numpy(), b["v"].to_numpy()) for b in batches]
    u, v = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (zip(*parts, strict=True) if parts else ((), ())))
    node, root = forest(u, v)
    tops = np.unique(root)
    yield pa.RecordBatch.from_pydict({"node": pa.array(np.concatenate([node, tops]), pa.int64()), "root": pa.array(np.concatenate([root, tops]), pa.int64())})


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """node and root (the least node of its component) for all nodes of edges (u, v), which are longs.

    Up to `few` edges, which are counted, are one task. More go through large-star and small-star rounds: each node hangs its larger, then its smaller neighbours on the least
    neighbour it knows. Rounds grow with the logarithm of a component's width; nodes with very many
    neighbours are summed to a least one before the shuffle.
    """
    loops = F.col("u") != F.col("v")
    edges = checkpointed(edges.filter(loops).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if edges.limit(few + 1).count() <= few:
        return edges.coalesce(1).mapInArrow(_whole, "node long, root long")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(loops).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(low, F.col("u") == F.col("w"))
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = checkpointed(small.filter(loops).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
