"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A key with more than one row in so many is frequent; there are fewer than this many of them, so they can be broadcast.
FREQUENT = 5000


def join_one(many: DataFrame, one: DataFrame, key: str, total: int) -> DataFrame:
    """Join ``many``, of ``total`` rows at most, with ``one``: a row for each key, with the rows of ``many`` that have it
    as ``n``. Frequent keys are joined where their rows are, so that no task gets all rows of one; the others meet by key."""
    most = max(200, total // FREQUENT)
    hubs = F.broadcast(one.where(F.col("n") > most).drop("n"))  # at most FREQUENT rows
    rest = many.join(hubs.select(key), key, "left_anti").join(one.where(F.col("n") <= most).drop("n"), key)
    return rest.unionByName(many.join(hubs, key))


def connected_components(links: DataFrame, label: str = "links", most_steps: int = 60) -> DataFrame:
    """node, root for every node of ``links`` (a, b long); root is the smallest node reachable.

    Each step replaces the links of a node by links to the least node it knows; the minimum is an aggregate with
    partial sums and comes back by a join that splits frequent nodes, so a node with very many links fills no task.
    Steps are written to the shared folder. Nulls and self-links take no part; an empty table gives an empty result.
    """
    edges = common.written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    seen = mark(edges)
    if not seen[0]:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(most_steps):
        both = edges.union(edges.select("b", "a"))  # large star: each larger neighbour to the least one
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = join_one(both, least, "a", 2 * seen[0]).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = common.written(large, label)
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))  # small star: each smaller neighbour and itself to the least one
        small = join_one(large, least, "a", 2 * seen[0]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = common.written(small.union(least.select("a", F.col("m").alias("b"))).distinct(), label)
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
