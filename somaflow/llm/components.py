"""Connected components of links that may be many: DataFrames between tasks, numpy inside one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somaflow.llm.shared import written


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest node that each of n nodes reaches over the links (u, v)."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            break
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]
    return root


def _state(links: DataFrame) -> tuple:
    """What tells two link sets apart: count, and two sums over hashes that can't overflow."""
    h = F.xxhash64("a", "b")
    return tuple(links.agg(F.count("*"), F.sum(F.pmod(h, F.lit(1_000_003))), F.sum(F.pmod(h, F.lit(998_244_353)))).first())


def components(links: DataFrame) -> DataFrame:
    """(a, b): every node of ``links`` (a, b; longs) that isn't its component's smallest, with the smallest.

    Alternates large-star and small-star steps until nothing changes: every
    node links its larger neighbours, then its smaller ones, to the smallest
    that it knows.  Minima are aggregated before the shuffle, so that a hub's
    neighbours never meet in one task's memory; each round is written to the
    shared folder.
    """
    links = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _state(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # now a > b throughout: b is a smaller neighbour of a
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(least, F.col("a") == F.col("k")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = written(small.unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct(), "links")
        after = _state(links)
        if after == before:
            break
        before = after
    return links
