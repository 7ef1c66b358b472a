"""Connected components of links between numbered nodes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import landed

EDGE = "a long, b long"


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the links of one task: each node with the smallest of its group."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    nodes = [x for x in parent if root(x) != x]
    yield pd.DataFrame({"a": nodes, "b": [root(x) for x in nodes]}, dtype="int64")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest neighbour of that node."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    moved = both.join(least, F.col("a") == F.col("u")).filter(F.col("b") > F.col("a"))
    return moved.select(F.col("b").alias("a"), F.least("m", "u").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    moved = down.join(least, F.col("a") == F.col("u")).filter(F.col("b") != F.col("m"))
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.toDF("a", "b")).distinct()


def connected(links: DataFrame) -> DataFrame:
    """``a`` and the smallest node ``b`` reachable from it, for every linked node but those smallest ones.

    Links (``a``, ``b``) first shrink to a forest per task, then large and small stars alternate until
    nothing moves; every round is a grouping and a join, and a table in the shared folder. Self
    links and repeated links count for nothing. No links, no rows.
    """
    edges = landed(links.filter("a <> b").select("a", "b").mapInPandas(_forest, EDGE), "links")
    mark = None
    while True:
        edges = landed(_small_star(landed(_large_star(edges), "large-star")), "small-star")
        row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            return edges
        mark = tuple(row)
