"""Connected components of a large graph of links, by alternating star contraction over DataFrames.

A round reads the links and first contracts blocks of them where they lie: a block becomes a star for each of its own
components. One aggregate then gives every node its smallest neighbour and tells whether all links form stars already. If
not, each node's larger neighbours are linked to its smallest one, then its smaller ones to the smallest. The joins are on
written tables, so adaptive execution can split a node with very many links. As soon as few enough links are left for one block,
that block's stars are the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links a-b but the smallest of its component, and that smallest one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def _contracted(links: DataFrame, block: int = 1 << 20) -> DataFrame:
    """The same components from stars over blocks of links, each held in one task's memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            a, b = stars(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= block:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return links.mapInArrow(run, "a long, b long")


def _whole(links: DataFrame) -> DataFrame:
    """node and root from all links in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(x.num_rows for x in held):
            return
        node, root = stars(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in (0, 1)))
        tops = np.unique(root)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node, tops]), pa.int64()), pa.array(np.concatenate([root, tops]), pa.int64())], names=["node", "root"])

    return links.coalesce(1).mapInArrow(run, "node long, root long")


def components(links: DataFrame, block: int = 1 << 19) -> DataFrame:
    """node, root (the smallest node of its component) for every node of links(a, b). Links to itself are no links. Up to `block`
    links are settled in one task."""
    edges = links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    before: tuple[DataFrame, ...] = ()
    while True:
        edges = materialise(_contracted(edges), "stars")
        discard(*before)  # what the new stars were made of
        if edges.count() <= block:
            return materialise(_whole(edges), "components")
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        nodes = ends.groupBy("node").agg(F.min("other").alias("m"), F.count_if(F.col("up") > 0).alias("up"), F.max("down").alias("down"))
        # `bent`: a node with two smaller neighbours, or with a smaller and a larger one
        nodes = nodes.select("node", F.least("node", "m").alias("m"), ((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).alias("bent"))
        nodes = materialise(nodes, "nodes")
        if not nodes.filter("bent").limit(1).count():
            return nodes.select("node", F.col("m").alias("root"))
        large = edges.join(nodes.select(F.col("node").alias("b"), "m"), "b").select("a", F.col("m").alias("b"))
        large = materialise(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before = (edges, nodes, large)
        edges = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
