"""Graphs of components as tables of edges: connected groups, their order, and colours that no neighbours share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Save = Callable[[DataFrame, str], DataFrame]


def connected(edges: DataFrame, save: Save, name: str = "groups") -> DataFrame:
    """(k, root): connected groups of the links (i, j; longs) by smallest member, nodes with links only.

    Alternates two steps until nothing changes: a node links its larger
    neighbours, then its smaller ones, to the smallest that it knows.  Paths
    shrink to a fraction each round, so that rounds grow with the logarithm of
    the longest; every round is written.
    """
    links = edges.where("i <> j").select(F.greatest("i", "j").alias("a"), F.least("i", "j").alias("b")).distinct()
    links, before, turn = save(links, f"{name}-0"), None, 0
    while True:
        state = tuple(links.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1_000_003))), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(998_244_353)))).first())
        if state == before or not state[0]:
            break
        before, turn = state, turn + 1
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("k")).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(least, F.col("a") == F.col("k")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = save(small.unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct(), f"{name}-{turn}")
    return links.select(F.col("a").alias("k"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("k"), F.col("b").alias("root")).distinct())


def in_order(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """(root, place, total): groups (k, root) from 1 on, by the sum of r over the pairs (i, j, r) inside each, largest first, ties to the smaller root.

    What one task orders has a row for each group.
    """
    inside = pairs.join(groups.select(F.col("k").alias("i"), F.col("root").alias("one")), "i").join(groups.select(F.col("k").alias("j"), F.col("root").alias("two")), "j").where("one = two")
    total = inside.groupBy(F.col("one").alias("root")).agg(F.sum("r").alias("total"))
    return total.select("root", F.row_number().over(Window.orderBy(F.desc("total"), "root")).alias("place"), "total")


def coloured(nodes: DataFrame, edges: DataFrame, save: Save, name: str = "colours") -> DataFrame:
    """(k, colour): each of the ``nodes`` (k) gets the smallest colour from 0 on that no neighbour of smaller k has.

    A node takes its colour as soon as all its smaller neighbours have theirs;
    nodes of a round do so at once.  The result is that of going through the
    nodes in order; where k is a hash, so that the order is random, rounds grow
    with the logarithm of the nodes.
    """
    up = edges.where("i <> j").select(F.greatest("i", "j").alias("k"), F.least("i", "j").alias("b")).distinct()
    up = save(up, f"{name}-edges")
    done = save(nodes.select("k").distinct().join(up.select("k"), "k", "left_anti").select("k", F.lit(0).alias("colour")), f"{name}-0")
    left, turn = nodes.select("k").distinct().join(done.select("k"), "k", "left_anti"), 0
    left = save(left, f"{name}-left-0")
    while not left.isEmpty():
        turn += 1
        met = up.join(left, "k", "left_semi").join(done.select(F.col("k").alias("b"), "colour"), "b", "left")
        state = met.groupBy("k").agg(F.count_if(F.col("colour").isNull()).alias("open"), F.collect_set("colour").alias("taken"))
        # the smallest number that isn't taken is at most how many are
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("taken")), "taken"))
        new = save(state.where("open = 0").select("k", free.alias("colour")), f"{name}-{turn}")
        done = done.unionByName(new)
        left = save(left.join(new.select("k"), "k", "left_anti"), f"{name}-left-{turn}")
    return done
