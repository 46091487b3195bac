"""Connected components of a link table, by large-star and small-star rounds on DataFrames.

Before the first round and after each one, every task contracts the links it holds to stars, which needs no shuffle and
leaves few rounds: they end when all links together are stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, stored

#: Links that a task contracts at a time.
LINKS = 1 << 18


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least node in the node's neighbourhood."""
    near = both_ways(edges)
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")


def small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them; edges go from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    onward = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return onward.union(least.select("a", F.col("m").alias("b"))).where("a > b")


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as links from every node to the least one."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        for end in (x, y):
            np.minimum.at(new, root[end], low)
            np.minimum.at(new, end, low)
        while True:  # each node to the root of its root
            next_ = new[new]
            if (next_ == new).all():
                break
            new = next_
        if (new == root).all():
            break
        root = new
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def contracted(edges: DataFrame) -> DataFrame:
    """Links with the same components, the links of each task as stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            a, b = np.r_[a, batch.column("a").to_numpy()], np.r_[b, batch.column("b").to_numpy()]
            if len(a) >= LINKS:
                yield list(stars(a, b))
                a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(a):
            yield list(stars(a, b))

    return in_arrow(edges.select("a", "b"), run, "a long, b long", [pa.int64(), pa.int64()])


def all_stars(edges: DataFrame) -> bool:
    """Whether every node is linked to one root, which is linked to nothing smaller."""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("root")).union(edges.select("b", F.lit(0), F.lit(1)))
    ends = ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return ends.where("up > 1 OR up + root > 1").isEmpty()


def star_links(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b: long) that is not the least of its component; root is the least.

    Each round is written to the shared folder; it takes about the logarithm of the longest chain of tasks' stars. No links give
    no rows.
    """
    edges = stored(contracted(links.where("a <> b")), "links")
    while not all_stars(edges):
        edges = stored(contracted(small_star(large_star(edges))), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def components(links: DataFrame) -> DataFrame:
    """As `star_links`, with a row for the least node of each component too."""
    found = star_links(links)
    return found.union(found.select(F.col("root").alias("node"), "root").distinct())
