"""Checks of results: each gives the vertices, or triangles, for which a kernel's result is wrong, none if it is right.

All checks are two-sided: a result that is too small, too large, or lacks vertices is
found.  They use another way than the kernel: equations that only the right values
fulfil, or a second algorithm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafonda.operators import components as C
from grafonda.operators.graph import Graph
from grafonda.operators.triangles import oriented
from grafonda.plans.scratch import cut, drop


def _with(graph: Graph, found: DataFrame, column: str) -> DataFrame:
    """(id, x, there) of every vertex: its value and whether the result has it."""
    values = found.select("id", F.col(column).alias("x"), F.lit(True).alias("there"))
    return graph.vertices.join(values, "id", "left").withColumn("there", F.coalesce("there", F.lit(False)))


def _both(graph: Graph, found: DataFrame, column: str) -> DataFrame:
    """Arcs without self-loops, with the column's value at both ends as x and y."""
    values = found.select("id", column)
    return graph.edges.where("src <> dst").join(values.toDF("src", "x"), "src", "left").join(values.toDF("dst", "y"), "dst", "left")


def _check_least(graph: Graph, found: DataFrame, column: str, sources: DataFrame, step: Column) -> DataFrame:
    """(id): a source has value 0, any other vertex the least x + step over its in-arcs; steps are positive, so only distances fulfil that."""
    values = found.select(F.col("id").alias("src"), F.col(column).alias("x"))
    best = graph.edges.join(values, "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("x") + step).alias("best"))
    zero = sources.select(F.col(sources.columns[0]).cast("bigint").alias("id"), F.lit(0).alias("zero")).distinct()
    all_values = _with(graph, found, column).join(best, "id", "left").join(zero, "id", "left")
    return all_values.where(~F.col("there") | ~F.col("x").eqNullSafe(F.coalesce("zero", "best"))).select("id")


def check_bfs(graph: Graph, levels: DataFrame, sources: DataFrame) -> DataFrame:
    return _check_least(graph, levels, "level", sources, F.lit(1))


def check_sssp(graph: Graph, distances: DataFrame, sources: DataFrame) -> DataFrame:
    """Weights must be positive."""
    return _check_least(graph, distances, "dist", sources, F.col("weight"))


def check_cc(graph: Graph, components: DataFrame) -> DataFrame:
    """(id) with another component than star contraction gives; for results of flooding or hooking."""
    right = C.cc(graph).withColumnRenamed("component", "right")
    return _with(graph, components, "component").join(right, "id").where(~F.col("x").eqNullSafe(F.col("right"))).select("id")


def check_mis(graph: Graph, found: DataFrame) -> DataFrame:
    """(id): missing or undecided vertices, neighbours that are both in, and vertices out without a neighbour in; self-loops do not count."""
    arcs = _both(graph, found, "in_mis")
    clash = arcs.where("x and y").select(F.col("src").alias("id"))
    covered = arcs.where("y").select(F.col("src").alias("id"))
    bare = found.where("not in_mis").select("id").join(covered, "id", "left_anti")
    return clash.union(bare).union(_with(graph, found, "in_mis").where("x is null").select("id")).distinct()


def check_colouring(graph: Graph, colours: DataFrame) -> DataFrame:
    """(id) whose colour is not the least that no smaller neighbour has."""
    lower = _both(graph, colours, "color").where("src < dst").groupBy(F.col("dst").alias("id")).agg(F.collect_set("x").alias("used"))
    least = F.coalesce(F.array_min(F.array_except(F.sequence(F.lit(0), F.size("used")), F.col("used"))), F.lit(0))
    return _with(graph, colours, "color").join(lower, "id", "left").where(~F.col("x").eqNullSafe(least)).select("id")


def check_kcore(graph: Graph, cores: DataFrame) -> DataFrame:
    """(id) without its value, with fewer than core neighbours of that core or more, or in a claimed shell that cannot be peeled.

    Upper side: a vertex can go once it has at most core neighbours among those of a
    higher core and those of its own core that have not gone; what can never go has too
    small a core.
    """
    arcs = cut(_both(graph, cores, "core").select("src", "dst", "x", "y").distinct())
    strong = arcs.where("y >= x").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    low = _with(graph, cores, "core").join(strong, "id", "left").where("x is null or x > coalesce(n, 0)").select("id")
    left = cut(graph.vertices.join(cores.select("id", "core"), "id"))
    while True:
        near = arcs.where("y > x").select("src").union(arcs.where("y = x").join(left.select(F.col("id").alias("dst")), "dst", "left_semi").select("src"))
        stay = near.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))
        fresh = cut(left.join(stay, "id").where("n > core").select("id", "core"))
        before, after = left.count(), fresh.count()
        drop(left)
        left = fresh
        if after in (0, before):
            return low.union(left.select("id")).distinct()


def check_triangles(graph: Graph, triangles: DataFrame) -> DataFrame:
    """(a, b, c): listed triangles that lack an edge, are out of order or stand twice, and triangles that are not listed.

    Triangles are found again by two hops and a closing arc over ids in order.
    """
    e = oriented(graph).select(F.least("u", "v").alias("p"), F.greatest("u", "v").alias("q"))
    real = e.toDF("a", "b").join(e.toDF("b", "c"), "b").join(e.toDF("a", "c"), ["a", "c"]).select("a", "b", "c", F.lit(1).alias("real"), F.lit(0).alias("told"))
    both = real.union(triangles.select("a", "b", "c", F.lit(0), F.lit(1)))
    return both.groupBy("a", "b", "c").agg(F.sum("real").alias("real"), F.sum("told").alias("told")).where("real <> told").select("a", "b", "c")


def check_pagerank(graph: Graph, ranks: DataFrame, epsilon: float, damping: float = 0.85) -> DataFrame:
    """(id) whose rank one more round would move by more than epsilon, or that has none."""
    degree = graph.edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    sent = graph.edges.join(degree, "src").join(ranks.select(F.col("id").alias("src"), "rank"), "src")
    got = sent.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("n")).alias("got"))
    wanted = (1 - damping) + damping * F.coalesce("got", F.lit(0.0))
    return _with(graph, ranks, "rank").join(got, "id", "left").where(~F.col("there") | (F.abs(F.col("x") - wanted) > epsilon)).select("id")
