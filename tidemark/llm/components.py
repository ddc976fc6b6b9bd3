"""Connected components of an edge table by alternating large and small stars.

Each half step is a minimum per node, combined on the map side, and one join; the edge table is written
to the shared folder after it, so lineage stays short and both sides of every join are shuffles that
adaptive execution may split where a node has very many edges. It ends when every node points to its
component's smallest node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop, staged


def roots_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index reachable from each of n indices over the edges a[i] - b[i]."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == root).all():
            return root
        root = new


def _locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's edges as stars: as many edges as it has nodes, at most."""
    for batch in batches:
        hi, lo = (batch.column(i).to_numpy() for i in (0, 1))
        nodes, at = np.unique(np.concatenate([hi, lo]), return_inverse=True)
        root = roots_of(at[: len(hi)], at[len(hi) :], len(nodes))
        far = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], ["hi", "lo"])


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b), longs. A row (node, component) for each node of an edge; component is its smallest node.

    Self edges and repeated edges change nothing. Nodes without an edge are not returned.
    """
    pairs = edges.select(F.greatest("a", "b").cast("long").alias("hi"), F.least("a", "b").cast("long").alias("lo")).filter("hi > lo")
    now = staged(pairs.mapInArrow(_locally, "hi long, lo long").distinct(), "edges")
    while True:
        least = staged(now.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("least"), F.count("*").alias("n")), "stars")
        # done when each node has one smaller neighbour, and that one none
        many = least.filter("n > 1").limit(1).count()
        if not many and not now.join(least.select(F.col("node").alias("lo")), "lo", "left_semi").limit(1).count():
            drop(least)
            break
        large = now.join(least.withColumnRenamed("node", "lo"), "lo", "left").select("hi", F.coalesce("least", "lo").alias("lo")).distinct()
        large = staged(large, "edges")
        drop(least)
        drop(now)
        least = staged(large.groupBy("hi").agg(F.min("lo").alias("least")), "stars")
        small = large.join(least, "hi").select(F.explode(F.array(F.struct(F.col("hi"), F.col("least").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("least").alias("lo")))).alias("e")).select("e.hi", "e.lo").filter("hi > lo").distinct()
        now = staged(small, "edges")
        drop(least)
        drop(large)
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct())
