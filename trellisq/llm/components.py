"""Connected components of a graph that no machine holds.

A task turns the links of its partition into stars around the smallest nodes, which loses no connection and keeps at most
one link for each node; partitions are then merged as far as LOCAL links fit one task, and the last merge to one task
ends it. Where more links are left, rounds of large-star and small-star come between: each replaces links by links to
smaller nodes, with partial sums at nodes that have very many links and a join that AQE can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

#: Links that one task holds at most when partitions are merged.
LOCAL = 400_000


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.where("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    side = down.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return side.unionByName(least.withColumnRenamed("m", "b")).distinct()


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node that the links a, b reach. Larger roots hook to smaller ones, and paths are halved."""
    root = np.arange(n)
    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up


def _merged(e: DataFrame, parts: int) -> DataFrame:
    """Stars of e's links, after its partitions are merged into ``parts`` without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        schema, n = held[0].schema, sum(b.num_rows for b in held)
        ends = pa.chunked_array([b.column("a") for b in held] + [b.column("b") for b in held]).combine_chunks().dictionary_encode()
        order = pc.sort_indices(ends.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        at = rank[ends.indices.to_numpy()]
        root = roots(at[:n], at[n:], len(order))
        nodes, moved = ends.dictionary.take(order), np.flatnonzero(root != np.arange(len(order)))
        yield pa.RecordBatch.from_arrays([nodes.take(pa.array(moved)), nodes.take(pa.array(root[moved]))], schema=schema)

    return e.coalesce(parts).mapInArrow(run, e.schema)


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node in a link between different nodes; component is the smallest node that it reaches.

    links: columns a and b of one orderable type. Links with a null end or from a node to itself are ignored, repeated
    ones count once; no links give no rows.
    """
    e = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a > b")
    e, seen = cut_lineage(e), None
    for _ in range(most_rounds):
        n = e.count()
        parts = max(1, -(-n // LOCAL))
        e = cut_lineage(_merged(e, parts))
        if parts == 1:
            break
        e = cut_lineage(_small_star(_large_star(e)))
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components didn't settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
