"""Connected components of an edge list, by star contraction in DataFrame joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import durable, release

#: Up to so many edges (some MB) are joined in one task; rounds of joins take longer than that however few they are.
FEW = 200_000


def _joined(batches):
    """(node, root) of all edges, by union-find."""
    batches = list(batches)
    if not batches:
        return
    ends = [np.concatenate([np.asarray(b.column(c)) for b in batches]) for c in (0, 1)]
    names, local = np.unique(np.concatenate(ends), return_inverse=True)
    up, n = list(range(len(names))), len(ends[0])

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in zip(local[:n].tolist(), local[n:].tolist(), strict=True):
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    root = np.array([find(x) for x in range(len(up))], np.int64)
    other = root != np.arange(len(root))
    yield pa.RecordBatch.from_arrays([pa.array(names[other]), pa.array(names[root[other]])], names=["node", "root"])


def connected_components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(a, b) pairs of longs -> (node, root): the least node that each node is joined with.

    Alternates large-star and small-star steps (Kiveris et al. 2014). Every step keeps the number
    of edges or lowers it, and needs a group's minimum only, so that no node's neighbours meet in
    one row. Ends when a round changes nothing; the rounds grow with the logarithm of the nodes.
    few: up to so many edges meet in one task instead, with the same result.
    """
    known, last = durable(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    if known.count() <= few:
        return durable(known.repartition(1).mapInArrow(_joined, "node long, root long"))
    while True:
        both = known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.where("a != m").select("a", F.col("m").alias("b"))).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        known = durable(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        mark = known.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 40))).alias("s")).first()
        if mark == last:
            return known.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = mark
        release(known.sparkSession, wait=0, turns=1)  # the driver keeps nothing of earlier rounds but the last
