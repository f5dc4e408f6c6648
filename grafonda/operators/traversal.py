"""Breadth-first search, reachability and shortest paths on the fixpoint loop.

Unreached vertices have a null value.  Weights must not be negative.  All orderings
give the same distances.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafonda.functions.orderings import Ordering, delta, dijkstra, klevel, level
from grafonda.operators.graph import Graph
from grafonda.plans.fixpoint import WorkStats, fixpoint


def _start(sources: DataFrame, kind: str) -> DataFrame:
    return sources.select(F.col(sources.columns[0]).cast("bigint").alias("id"), F.lit(0).cast(kind).alias("cand")).distinct()


def bfs(graph: Graph, sources: DataFrame, ordering: Ordering | None = None, max_level: int | None = None, stats: WorkStats | None = None) -> DataFrame:
    """(id, level): fewest arcs from any source; with max_level, vertices further away stay unreached."""
    hops = graph.edges.select("src", "dst")
    found = fixpoint(graph.vertices, hops, _start(sources, "int"), lambda v, _: v + 1, ordering=ordering, max_level=max_level, stats=stats)
    return found.select("id", F.col("value").alias("level"))


def bfs_level(graph: Graph, sources: DataFrame) -> DataFrame:
    return bfs(graph, sources, level())


def bfs_klevel(graph: Graph, sources: DataFrame, k: int = 2) -> DataFrame:
    return bfs(graph, sources, klevel(k))


def predecessors(graph: Graph, levels: DataFrame) -> DataFrame:
    """(id, level, parent): the smallest neighbour one level nearer; null at sources and unreached vertices."""
    near = levels.select(F.col("id").alias("src"), F.col("level").alias("before"))
    steps = graph.edges.join(near, "src").join(levels.withColumnRenamed("id", "dst"), "dst").where("level = before + 1")
    return levels.join(steps.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent")), "id", "left").select("id", "level", "parent")


def reach(graph: Graph, sources: DataFrame) -> DataFrame:
    """(id) of every vertex that some source reaches, sources included."""
    found = fixpoint(graph.vertices, graph.edges.select("src", "dst"), _start(sources, "int"), lambda v, _: v)
    return found.where("value is not null").select("id")


def connected(graph: Graph, source: int, target: int) -> bool:
    """Whether the target can be reached from the source."""
    one = graph.vertices.where(F.col("id") == source)
    return bool(reach(graph, one).where(F.col("id") == target).take(1))


def sssp(graph: Graph, sources: DataFrame, ordering: Ordering | None = None, stats: WorkStats | None = None) -> DataFrame:
    """(id, dist): least summed weight from any source."""
    found = fixpoint(graph.vertices, graph.edges, _start(sources, "bigint"), lambda v, w: v + w, ordering=ordering, stats=stats)
    return found.select("id", F.col("value").alias("dist"))


def auto_delta(graph: Graph) -> int:
    """max(1, largest weight div largest out-degree)."""
    most = graph.edges.agg(F.max("weight")).first()[0] or 0
    degree = graph.out_degrees().agg(F.max("out_degree")).first()[0] or 1
    return max(1, most // max(degree, 1))


def sssp_delta(graph: Graph, sources: DataFrame, width: int = 0) -> DataFrame:
    """Buckets of `width` distances; 0 or less chooses it from weights and degrees.

    A bucket is drained along arcs of up to that weight; what it settled then sends
    along the heavier ones, once.
    """
    width = width if width > 0 else auto_delta(graph)
    found = fixpoint(graph.vertices, graph.edges, _start(sources, "bigint"), lambda v, w: v + w, ordering=delta(width), light=F.col("weight") <= width)
    return found.select("id", F.col("value").alias("dist"))


def sssp_buckets(graph: Graph, sources: DataFrame, width: int) -> DataFrame:
    """Buckets of `width` distances without that split: every round relaxes all arcs of the lowest bucket's items."""
    return sssp(graph, sources, delta(width))


def sssp_dijkstra(graph: Graph, sources: DataFrame) -> DataFrame:
    """Settles one distance at a time: a job for each distinct distance, for small graphs only."""
    return sssp(graph, sources, dijkstra())


def sssp_kla(graph: Graph, sources: DataFrame, k: int = 2) -> DataFrame:
    """Relaxes freely inside windows of k levels."""
    return sssp(graph, sources, klevel(k))


def sssp_eager(graph: Graph, sources: DataFrame, lookahead: int, growth: int = 10, growth_after: int = 10) -> DataFrame:
    """Settles in each round every pending item up to the least distance plus the lookahead.

    The lookahead is multiplied by `growth` after every `growth_after` rounds.
    """
    found = fixpoint(graph.vertices, graph.edges, _start(sources, "bigint"), lambda v, w: v + w, ordering=dijkstra(), slack=lambda done: lookahead * growth ** (done // growth_after))
    return found.select("id", F.col("value").alias("dist"))


def random_sources(graph: Graph, count: int = 1, seed: int = 1) -> DataFrame:
    """(id): that many vertices with an arc out, drawn by a seeded hash; all of them if there are fewer."""
    able = graph.edges.select(F.col("src").alias("id")).distinct()
    return able.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(count)


def two_way(graph: Graph, source: DataFrame) -> DataFrame:
    """(id) of the strongly connected component of one vertex: what it reaches and what reaches it."""
    return reach(graph, source).join(reach(graph.reverse(), source), "id", "left_semi")
