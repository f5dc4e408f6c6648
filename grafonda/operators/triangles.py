"""Triangle counting: one join strategy and four neighbour-list intersections, all of which count each triangle once.

Arcs are oriented from the end of lower degree to that of higher degree (ties by
id), which bounds the out-degree of every vertex by the square root of twice the
number of edges, hubs included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafonda.operators.graph import Graph


def oriented(graph: Graph) -> DataFrame:
    """(u, v): each undirected edge once, from lower to higher degree."""
    simple = graph.edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    ends = simple.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    both = simple.join(ends.toDF("a", "da"), "a").join(ends.toDF("b", "db"), "b")
    forward = F.struct("da", "a") < F.struct("db", "b")
    return both.select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("v"))


def enumerate_triangles(graph: Graph) -> DataFrame:
    """(a, b, c) with a < b < c: wedges of oriented arcs, each once, whose ends are joined by a third edge."""
    e = oriented(graph)
    wedges = e.toDF("u", "v").join(e.toDF("u", "w"), "u").where("v < w")
    closed = wedges.join(e.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("w")), ["v", "w"])
    t = F.sort_array(F.array("u", "v", "w"))
    return closed.select(t[0].alias("a"), t[1].alias("b"), t[2].alias("c"))


def striped(graph: Graph) -> DataFrame:
    """One row (triangles): wedges joined with the arcs that close them."""
    return enumerate_triangles(graph).agg(F.count(F.lit(1)).alias("triangles"))


def _lists(arcs: DataFrame, key: str, member: str) -> DataFrame:
    return arcs.groupBy(F.col(key).alias("id")).agg(F.collect_list(member).alias("near"))


def _common(both: DataFrame) -> DataFrame:
    """One row (triangles): the summed sizes of the intersections of x and y."""
    return both.agg(F.coalesce(F.sum(F.size(F.array_intersect("x", "y"))), F.lit(0)).cast("bigint").alias("triangles"))


def successors(graph: Graph) -> DataFrame:
    """Common successors of both ends: the list of the first end travels along the arc."""
    e = oriented(graph)
    near = _lists(e, "u", "v")
    return _common(e.join(near.toDF("u", "x"), "u").join(near.toDF("v", "y"), "v"))


def middle(graph: Graph) -> DataFrame:
    """Blocks of successors go back to the predecessors, which compare them with their own successors."""
    e = oriented(graph)
    near = _lists(e, "u", "v")
    return _common(near.toDF("v", "y").join(e, "v").join(near.toDF("u", "x"), "u"))


def predecessors_of(graph: Graph) -> DataFrame:
    """Common predecessors of both ends, with arcs turned to run from higher to lower degree: that bounds the predecessors."""
    e = oriented(graph).toDF("v", "u")
    near = _lists(e, "v", "u")
    return _common(e.join(near.toDF("u", "x"), "u").join(near.toDF("v", "y"), "v"))


def two_levels(graph: Graph) -> DataFrame:
    """Two hops, then a semi-join with the arcs."""
    e = oriented(graph)
    hops = e.toDF("u", "v").join(e.toDF("v", "w"), "v").select("u", "w")
    return hops.join(e.toDF("u", "w"), ["u", "w"], "left_semi").agg(F.count(F.lit(1)).alias("triangles"))


def local_counts(graph: Graph) -> DataFrame:
    """(id, triangles): triangles through each vertex, 0 included."""
    corners = enumerate_triangles(graph).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))
    return graph.vertices.join(corners, "id", "left").select("id", F.coalesce("triangles", F.lit(0).cast("bigint")).alias("triangles"))
