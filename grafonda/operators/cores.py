"""Core numbers by iterated h-indices, and the smallest degree of a component."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grafonda.operators.components import cc
from grafonda.operators.graph import Graph
from grafonda.plans.deltas import Falling
from grafonda.plans.scratch import cut, drop


def kcore(graph: Graph) -> DataFrame:
    """(id, core): the largest k such that the vertex lies in a subgraph of smallest degree k.

    A vertex's value starts as its degree and becomes the h-index of its neighbours'
    values until nothing changes.  A round looks only at vertices with a neighbour that
    fell below them in the round before, and writes only those that fall.  Neighbours
    are counted by value first, so a hub has as many rows as distinct values, not as
    many as neighbours.
    """
    arcs = cut(graph.edges.where("src <> dst").select("src", "dst").distinct())
    own = arcs.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("core"))
    values = Falling(graph.vertices.join(own, "id", "left").select("id", F.coalesce("core", F.lit(0).cast("bigint")).alias("value")))
    down = Window.partitionBy("id").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fell: DataFrame | None = None
    while True:
        now = values.table()
        touched = arcs
        if fell is not None:
            hit = arcs.join(fell.select(F.col("id").alias("src"), F.col("value").alias("to"), "was"), "src").select(F.col("dst").alias("id"), "to", "was")
            hit = hit.join(now, "id").where("to < value and was >= value").select("id").distinct()
            touched = arcs.join(hit.select(F.col("id").alias("src")), "src", "left_semi")
        seen = touched.join(now.toDF("dst", "theirs"), "dst").join(now.toDF("src", "mine"), "src")
        by_value = seen.groupBy(F.col("src").alias("id"), F.least("mine", "theirs").alias("value"), "mine").agg(F.count(F.lit(1)).alias("n"))
        h = by_value.withColumn("above", F.sum("n").over(down)).groupBy("id", "mine").agg(F.max(F.least("value", "above")).alias("h"))
        after = cut(h.where("h < mine").select("id", F.col("h").alias("value"), F.col("mine").alias("was")))
        rows = after.count()
        if not rows:
            drop(arcs)
            drop(after)
            return values.finish().withColumnRenamed("value", "core")
        values.add(after, rows)
        fell = after


def kcore_min_degree(graph: Graph) -> DataFrame:
    """(id, core): the smallest degree in the vertex's component, which flooding minima of degrees arrives at."""
    simple = graph.preprocess()
    placed = simple.out_degrees().join(cc(simple), "id")
    low = placed.groupBy("component").agg(F.min("out_degree").alias("core"))
    return placed.join(low, "component").select("id", "core")
