"""Roots of a forest given as links from child to parent; connected components of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable


def roots(links: DataFrame) -> DataFrame:
    """``child, root`` for every child of ``links`` (``child, parent``; one parent each, no cycles).

    Pointer doubling: each round an open pointer jumps to where its target points, so a chain of length n takes
    log2(n) rounds. Rows with nulls are left out; a cycle raises an error.
    """
    state = links.dropna().select("child", F.col("parent").alias("p"), F.lit(False).alias("settled"))
    state = durable(state)
    for _ in range(state.count().bit_length() + 1):  # enough for one chain of all links
        target = state.select(F.col("child").alias("p"), F.col("p").alias("q"), F.col("settled").alias("q_settled"))
        moved = (
            state.where("NOT settled").join(target, "p", "left")
            .select("child", F.coalesce("q", "p").alias("p"), F.coalesce("q_settled", F.lit(True)).alias("settled"))
        )
        state = durable(state.where("settled").unionByName(moved))
        if state.where("NOT settled").isEmpty():
            return state.select("child", F.col("p").alias("root"))
    if state.isEmpty():
        return state.select("child", F.col("p").alias("root"))
    raise ValueError("the links form a cycle")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``u, v``, longs): the least node that it is connected with.

    Large and small stars by turns until no edge changes: every node's larger, then its smaller neighbours are linked
    to the least one. Only minima and links are shuffled, so neither a large component nor a hot node is one task's.
    Nodes linked to themselves alone are components of their own; rows with nulls are left out.
    """
    edges = edges.select("u", "v").dropna().distinct()
    edges = durable(edges)
    alone = edges.where("u = v").select("u")
    links = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = durable(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = durable(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    own = links.select(F.col("v").alias("u")).union(alone).distinct().join(links.select("u"), "u", "left_anti")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(own.select("u", "u"))
