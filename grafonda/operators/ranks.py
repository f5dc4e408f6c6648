"""PageRank and sparse matrix-vector products."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafonda.operators.graph import Graph
from grafonda.plans.scratch import cut, drop


def _step(graph: Graph, shares: DataFrame, ranks: DataFrame, damping: float) -> DataFrame:
    sent = shares.join(ranks.withColumnRenamed("id", "src"), "src")
    got = sent.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
    out = graph.vertices.join(got, "id", "left")
    return out.select("id", (F.lit(1 - damping) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))


def _shares(graph: Graph) -> DataFrame:
    """(src, dst, share): repeated arcs count each; share is one over the source's out-degree."""
    degree = graph.edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    return cut(graph.edges.select("src", "dst").join(degree, "src").select("src", "dst", (1 / F.col("n")).alias("share")))


def pagerank(graph: Graph, iterations: int = 20, damping: float = 0.85, cut_every: int = 5) -> DataFrame:
    """(id, rank) after a number of synchronous rounds from 1/n; r = (1 - d) + d * sum of r(u)/outdegree(u), dangling mass is dropped."""
    shares, n = _shares(graph), max(graph.vertices.count(), 1)
    ranks = graph.vertices.select("id", F.lit(1.0 / n).alias("rank"))
    held = None
    for i in range(1, iterations + 1):
        ranks = _step(graph, shares, ranks, damping)
        if i % cut_every == 0:
            ranks = cut(ranks)
            drop(held)
            held = ranks
    return ranks


def pagerank_until(graph: Graph, epsilon: float = 1e-6, damping: float = 0.85, max_iterations: int = 1000) -> DataFrame:
    """(id, rank) once no rank moves by more than epsilon."""
    shares, n = _shares(graph), max(graph.vertices.count(), 1)
    ranks = cut(graph.vertices.select("id", F.lit(1.0 / n).alias("rank")))
    for _ in range(max_iterations):
        fresh = cut(_step(graph, shares, ranks, damping))
        moved = fresh.join(ranks.withColumnRenamed("rank", "was"), "id").where(F.abs(F.col("rank") - F.col("was")) > epsilon).take(1)
        drop(ranks)
        ranks = fresh
        if not moved:
            break
    return ranks


def spmv(entries: DataFrame, vector: DataFrame) -> DataFrame:
    """(id, value): y(src) = sum of weight * x(dst) over entries(src, dst, weight) and vector(id, value); rows without entries are absent."""
    x = vector.select(F.col("id").alias("dst"), F.col("value").alias("x"))
    return entries.join(x, "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("weight") * F.col("x")).alias("value"))


def combine(arcs: DataFrame, values: DataFrame, *reducers: Callable[[Column], Column]) -> DataFrame:
    """(id, one column per reducer, by its name): what arrives at each vertex when all send values(id, value) along their arcs.

    Reducers are aggregate functions such as F.min and F.sum; equal targets are
    combined on the map side.  Vertices that nothing arrives at are absent.
    """
    sent = arcs.select("src", "dst").join(values.toDF("src", "value"), "src")
    return sent.groupBy(F.col("dst").alias("id")).agg(*[f(F.col("value")).alias(f.__name__) for f in reducers])
