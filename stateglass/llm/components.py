"""Connected components of a graph given as a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from stateglass.llm.common import written


def local_roots(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per position, the smallest id that the links (a, b) lead to."""
    low = ids.copy()
    while True:
        before = low.copy()
        np.minimum.at(low, a, before[b])
        np.minimum.at(low, b, low[a])
        if (low == before).all():
            return low


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node that its links lead to.

    ``links`` has two long columns ``a`` and ``b``; only their nodes come back.
    Each round gives a node the smallest root of its neighbours and then the root
    of that root, so long chains shorten by half. Minima are combined before they
    are shuffled, and the joins are plain ones that adaptive execution can split
    at a node with very many links. Every round is written to the shared folder.
    """
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = written(links.where("a != b").distinct(), "links")
    # A node's smaller neighbours are tied to the smallest of them instead of to it,
    # so a dense group keeps about one link per member for the rounds.
    low = links.groupBy("b").agg(F.min("a").alias("low"))
    tied = links.join(low, "b").where("a != low").select(F.col("low").alias("a"), F.col("a").alias("b"))
    links = low.select(F.col("low").alias("a"), "b").union(tied).distinct()
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both, "links")
    roots = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    roots = written(roots.select("node", F.least("node", "low").alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b")
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        lower = roots.join(near, "node").select(
            "node", F.least("root", "low").alias("root"), F.col("root").alias("before")
        )
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
        lower = lower.join(jump, "root").select("node", F.least("root", "next").alias("root"), "before")
        lower = written(lower, "roots")
        if lower.where("root != before").isEmpty():
            return lower.select("node", "root")
        roots = lower.select("node", "root")
