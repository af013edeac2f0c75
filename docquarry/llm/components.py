"""Connected components of a distributed edge list by alternating large-star and small-star rounds.

Each task first replaces the edges that it holds by stars. Every round then replaces edges by edges to smaller nodes and keeps
the components; the last one leaves an edge from every node to the smallest of its component, which one aggregation by node
tells. Minima are pre-aggregated before they move, and hub nodes only occur as a join side that adaptive execution can split.
The driver sees a count per round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


class Forest:
    """Union-find over integers; the smaller root stays."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        above = self.above
        while (up := above.get(x, x)) != x:
            above[x] = x = above.get(up, up)
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether the two were apart."""
        x, y = self.root(x), self.root(y)
        if x != y:
            self.above[max(x, y)] = min(x, y)
        return x != y

    def stars(self) -> pd.DataFrame:
        """An edge (a, b) from each node but the roots to its root."""
        nodes = list(self.above)
        return pd.DataFrame({"a": np.array(nodes, np.int64), "b": np.array([self.root(x) for x in nodes], np.int64)})


def local_stars(edges: DataFrame, held: int = 1_000_000) -> DataFrame:
    """The same components with fewer edges: each task's, ``held`` at a time, become stars."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = Forest()
        for pdf in batches:
            for x, y in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
                forest.join(x, y)
            if len(forest.above) >= held:
                yield forest.stars()
                forest = Forest()
        yield forest.stars()

    return edges.mapInPandas(run, "a long, b long")


def _lowest(edges: DataFrame) -> DataFrame:
    """(a, m): the smallest b of each a. Grouped by the complement of a, so that a join by a deals these rows out by an exchange
    of its own; were the aggregate in the join's stage, adaptive execution could not split a hub on the other side."""
    return edges.groupBy(F.bitwise_not("a").alias("k")).agg(F.min("b").alias("m")).select(F.bitwise_not("k").alias("a"), "m")


def _toward_minimum(edges: DataFrame) -> DataFrame:
    """Large star, then small star. ``edges``: a above b."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _lowest(both).select("a", F.least("a", "m").alias("m"))
    # neighbours above a node go to its smallest neighbour or itself
    up = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    low = _lowest(up)
    # a node and its lower neighbours go to the smallest of them
    moved = up.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct()


def _unsettled(edges: DataFrame) -> int:
    """Nodes that point to two others, or that others point to although they point themselves."""
    nodes = edges.select(F.col("a").alias("x"), F.col("b").alias("to"), F.lit(0).alias("aim")).union(edges.select("b", F.lit(None).cast("long"), F.lit(1)))
    by_node = nodes.groupBy("x").agg(F.min("to").alias("low"), F.max("to").alias("high"), F.max("aim").alias("aim"))
    return by_node.where("low < high or (aim = 1 and low is not null)").count()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: long columns a and b, in any order and with repeats. Returns (node, component) for each node that has an
    edge to another one, smallest nodes included."""
    now = cut_lineage(local_stars(edges.where("a <> b").select("a", "b")).distinct())
    while _unsettled(now):
        now = cut_lineage(_toward_minimum(now))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
