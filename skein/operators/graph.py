"""Connected components and what is told about them."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.session import shared_folder


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def released(spark: SparkSession) -> None:
    """Have Spark delete the shuffles of tables that were written since and aren't held: it does when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """v, c: each vertex of ``edges`` (a, b) with the smallest one that it reaches.

    Labels take the smallest label of their neighbours, then the label of their label, until nothing
    changes; each round is two joins and an aggregate, and is checkpointed.
    """
    both = checkpointed(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).filter("u <> v").distinct())
    label = checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("c")).withColumnRenamed("u", "v"))
    for _ in range(rounds):
        near = both.join(label, "v").groupBy("u").agg(F.min("c").alias("m"))
        low = label.join(near, label.v == near.u).select("v", "c", F.least("c", "m").alias("d"))
        jump = low.select(F.col("v").alias("w"), F.col("d").alias("e"))
        nxt = checkpointed(low.join(jump, low.d == jump.w).select("v", F.least("d", "e").alias("c"), (F.least("d", "e") != F.col("c")).alias("moved")))
        label = nxt.select("v", "c")
        if nxt.filter("moved").isEmpty():
            return label
    raise RuntimeError(f"components didn't settle in {rounds} rounds")


def clusters(label: DataFrame, least: int = 2) -> DataFrame:
    """c, size of the components with ``least`` vertices or more."""
    return label.groupBy("c").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least)


def attributed(edges: DataFrame, label: DataFrame) -> DataFrame:
    """``edges`` with the component that holds both ends."""
    one = label.select(F.col("v").alias("a"), F.col("c").alias("ca"))
    two = label.select(F.col("v").alias("b"), F.col("c").alias("cb"))
    return edges.join(one, "a").join(two, "b").filter("ca = cb").withColumnRenamed("ca", "c").drop("cb")


def modal(df: DataFrame, by: list[str], value: str, *ties: object) -> DataFrame:
    """The most frequent value that isn't null of each group; ties by the given orders, then the value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), *ties, F.asc(value))
    return counts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def descendants(edges: DataFrame, depth: int = 16) -> DataFrame:
    """(ancestor, node) of a hierarchy of (parent, child), each node its own ancestor too."""
    nodes = edges.select(F.explode(F.array("parent", "child")).alias("node")).distinct()
    out = level = nodes.select(F.col("node").alias("ancestor"), "node")
    for _ in range(depth):
        level = level.join(edges, level.node == edges.parent).select("ancestor", F.col("child").alias("node"))
        if level.isEmpty():
            return out.distinct()
        out = out.unionByName(level)
    raise RuntimeError(f"the hierarchy is deeper than {depth}")
