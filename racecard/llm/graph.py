"""Connected components of a link table, without ever gathering a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from racecard.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a, b``); root is the least node.

    Alternating large and small stars: every node's larger neighbours, then its smaller
    ones, are linked to its least neighbour, until nothing changes. Each half step is one
    aggregation and one join by node; a node with many neighbours is summed before it is
    shuffled, and its join is one row against many. Links of a node with itself are
    ignored; an empty table gives an empty result.
    """
    edges = cut_lineage(links.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = _state(edges)
    while seen[0]:
        large = cut_lineage(_star(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))))
        # Stars whose centre is their least node: nothing moved, and every node has one link down.
        if _state(large) == seen and large.groupBy("u").count().where("count > 1").isEmpty():
            break
        edges = cut_lineage(_small(large))
        seen = _state(edges)
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def first_labels(links: DataFrame) -> DataFrame:
    """``node, root`` after one large and one small star: equal roots are surely connected.

    A few joins instead of a loop, for callers that only want to skip most linked pairs.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    large = cut_lineage(_star(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))))
    return cut_lineage(_small(large).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")))


def _star(both: DataFrame) -> DataFrame:
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = both.where("v > u").join(least, "u").where("v <> m")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(down: DataFrame) -> DataFrame:
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h")).first()
    return row["n"], row["h"]
