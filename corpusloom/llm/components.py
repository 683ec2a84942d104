"""Connected components of an edge table by alternating large-star and small-star steps.

Each step joins edges with the least neighbour of a node; the table shrinks to stars around each
component's least node in a number of rounds that grows with the logarithm of the longest path, and rounds
go on until nothing changes. Rounds are written to the shared folder, each in place of the one before. Self-loops, repeated and reversed edges
are allowed; an empty table has no nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, stash


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (node, least node) that connect what the edges a-b connect."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, label):
            break
        label = new[label]
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _thin(edges: DataFrame) -> DataFrame:
    """Edges with each partition's part reduced to a forest."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = b = np.empty(0, np.int64)
        for batch in batches:
            a = np.concatenate([a, batch.column(0).to_numpy()])
            b = np.concatenate([b, batch.column(1).to_numpy()])
            if len(a) >= 1 << 20:
                thin = forest(a, b)
                if len(thin[0]) > len(a) // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in thin], names=["u", "v"])
                    thin = (a[:0], b[:0])
                a, b = thin
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(a, b)], names=["u", "v"])

    return map_arrow(edges, reduce, "u bigint, v bigint")


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``: the least node it is connected with."""
    ends = edges.where("u IS NOT NULL AND v IS NOT NULL")
    now = stash(_thin(ends.where("u <> v").select("u", "v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if seen == (mark["n"], mark["x"]) or not mark["n"]:
            break
        seen = (mark["n"], mark["x"])
        # large star: every larger neighbour of u is linked with the least of u and its neighbours
        read, both = now, now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        now = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours are linked with the least of them
        now = stash(now, "edges")
        discard(read)
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        moved = now.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        read, now = now, stash(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(read)
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
