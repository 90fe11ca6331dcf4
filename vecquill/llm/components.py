"""Connected components of a table of links by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecquill.llm.shared import durable, mark, release


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links(u, v); a component's name is its least node. Loops and repeated links do no harm.

    The least neighbours are a table of their own in each step, so the join that hands them on has two plain inputs: AQE
    broadcasts the smaller one or splits the rows of a node that a large part of all links meets.
    """
    spark, done = links.sparkSession, mark()
    edges = durable(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(most_rounds):
        now = edges.agg(F.count("*").alias("n"), F.countDistinct("u").alias("m")).first()
        # settled: every node has one edge, to a node that has none to a smaller one
        if now.n == now.m and edges.select("v").distinct().join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        # large star: a node's larger neighbours join the least node around it, which is itself if none is smaller
        least = durable(edges.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("least")))
        large = durable(edges.join(least, F.col("v") == F.col("x"), "left").select("u", F.coalesce("least", "v").alias("v")).distinct())
        # small star: a node and its smaller neighbours join the least of them
        least = durable(large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("least")))
        small = large.join(least, F.col("u") == F.col("x")).select(F.col("v").alias("a"), "least").unionByName(least.select(F.col("x").alias("a"), "least"))
        edges = durable(small.where("a <> least").select(F.col("a").alias("u"), F.col("least").alias("v")).distinct())
        release(spark, done, mark() - 1)
        done = mark() - 1
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
