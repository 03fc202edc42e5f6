"""Connected components of links: tasks join what their own links join, then large-star and small-star rounds join tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compact, cut, with_groups


def _least(edges: DataFrame, u: str, v: str) -> DataFrame:
    """edges with m, the least v of each u; neighbours of a hub are dealt over several tasks."""
    return with_groups(edges, [u], F.xxhash64(v), {"m": F.min(v)}, {"m": F.min("m")})


def _large(edges: DataFrame) -> DataFrame:
    """Each node gives its larger neighbours its least neighbour (or itself)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _least(both, "u", "v").where("v > u").select(F.col("v").alias("a"), F.least("m", "u").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Each node gives its smaller neighbours and itself the least of them."""
    own = F.explode(F.array("a", "b")).alias("a")
    return _least(edges, "a", "b").select(own, F.col("m").alias("b"))


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one task as stars: each node with the least node that it reaches by them. A node without a lesser one is left out."""
    held = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches]
    if not held:
        return
    names, place = np.unique(np.concatenate([x for pair in held for x in pair]), return_inverse=True)
    ends = np.r_[0, np.cumsum([len(x) for pair in held for x in pair])]
    parts = [place[i:j] for i, j in zip(ends[:-1], ends[1:])]
    u, v = np.concatenate(parts[::2]), np.concatenate(parts[1::2])
    root = np.arange(len(names))
    while True:
        low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        open_ = low < high
        if not open_.any():
            break
        np.minimum.at(root, high[open_], low[open_])
        while not np.array_equal(up := root[root], root):
            root = up
    at = np.flatnonzero(root < np.arange(len(names)))
    yield pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(names[root[at]])], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, root): for each node of the links (a, b), the least node it can reach. Nodes are not null; roots are listed too."""
    own = lambda df: cut(df.mapInArrow(contracted, "a long, b long"))
    edges = own(links.where("a <> b").select("a", "b"))
    while n := edges.count():
        edges = compact(edges, n)  # the number of edges never grows, so the partitions that fit now still do after the round
        told = edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("root")), F.struct(F.col("b").alias("node"), F.col("b").alias("root")))))
        if told.groupBy("node").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").isEmpty():
            break  # every node knows one root, and roots only themselves
        edges = own(compact(_small(_large(edges)).where("a <> b").distinct(), n))
    edges = edges.distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
