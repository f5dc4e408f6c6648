"""Connected components by alternating star contractions.

Each round replaces the edge table by edges to local minima: the large-star step
hangs every larger neighbour of a vertex on the smallest vertex it sees, the
small-star step does the same for the smaller neighbours.  Paths shrink
geometrically, so the number of rounds grows with the logarithm of the longest
chain.  Every step is a map-side combined minimum and a join that can be split; a hub
only costs rows, never a task of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafonda.functions.orderings import Ordering
from grafonda.operators.graph import Graph, dense_index
from grafonda.plans.fixpoint import fixpoint
from grafonda.plans.skew import meet
from grafonda.plans.scratch import cut, drop


def _lowest(arcs: DataFrame) -> DataFrame:
    """(u, m): the smallest of u and its neighbours."""
    return arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    arcs = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    hung = meet(arcs, "u", _lowest(arcs)).where("v > u")
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges have u > v, so the grouping side is the larger end."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = meet(edges, "u", low).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return hung.union(low.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every vertex hangs on one smaller vertex at most, and none that others hang on hangs itself."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    seen = ends.groupBy("id").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return seen.where("ups > 1 or (ups = 1 and least = 0)").agg(F.count(F.lit(1))).first()[0] == 0


def star_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(id, component) for every vertex of an edge table; component is the smallest id reachable.

    Direction, repeats, self-loops and null ends do not matter: null ends are
    dropped, and a vertex that has only self-loops is its own component.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    work = cut(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    loops, pairs = work.where("u = v").select("u"), work.where("u <> v")
    current = pairs
    for _ in range(max_rounds):
        if _are_stars(current):
            break
        after = cut(_small_star(_large_star(current)))
        drop(current)  # the first is a view of `work` and stays
        current = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    low = current.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("component"))
    alone = loops.select(F.col("u").alias("id"), F.col("u").alias("component"))
    found = cut(low.union(roots).union(alone).groupBy("id").agg(F.min("component").alias("component")))
    drop(work)
    drop(current)
    return found


def _all_vertices(graph: Graph, found: DataFrame) -> DataFrame:
    return graph.vertices.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def cc(graph: Graph) -> DataFrame:
    """(id, component) of every vertex: the smallest id of its weakly connected component."""
    return _all_vertices(graph, star_components(graph.edges))


def cc_flood(graph: Graph, ordering: Ordering | None = None) -> DataFrame:
    """The same by flooding the smallest label along the arcs of a symmetric graph."""
    start = graph.vertices.select("id", F.col("id").alias("cand"))
    found = fixpoint(graph.vertices, graph.edges.select("src", "dst"), start, lambda v, _: v, ordering=ordering)
    return found.select("id", F.col("value").alias("component"))


def cc_hook(graph: Graph, max_rounds: int = 60) -> DataFrame:
    """The same by hooking trees to smaller neighbours and doubling pointers until nothing moves."""
    parent = cut(graph.vertices.select("id", F.col("id").alias("p")))
    arcs = graph.symmetrize().edges.select("src", "dst")
    for _ in range(max_rounds):
        near = arcs.join(parent.select(F.col("id").alias("dst"), F.col("p").alias("q")), "dst")
        low = near.groupBy(F.col("src").alias("id")).agg(F.min("q").alias("q"))
        hooks = parent.join(low, "id").where("q < p").groupBy(F.col("p").alias("id")).agg(F.min("q").alias("h"))
        own = parent.join(hooks, "id", "left").join(low, "id", "left")
        hooked = cut(own.select("id", F.least("p", F.coalesce("h", "p"), F.coalesce("q", "p")).alias("p")))
        doubled = hooked.alias("x").join(hooked.alias("y"), F.col("x.p") == F.col("y.id")).select(F.col("x.id").alias("id"), F.col("y.p").alias("p"))
        fresh = cut(doubled)
        moved = fresh.join(parent.withColumnRenamed("p", "was"), "id").where("p <> was").take(1)
        drop(parent)
        drop(hooked)
        parent = fresh
        if not moved:
            return parent.select("id", F.col("p").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def cc_flood_then_hook(graph: Graph) -> DataFrame:
    """Floods from the vertex of the highest degree, then hooks what that left."""
    top = graph.out_degrees().orderBy(F.desc("out_degree"), "id").limit(1).select("id")
    start = top.select("id", F.lit(0).cast("bigint").alias("cand"))
    found = fixpoint(graph.vertices, graph.edges.select("src", "dst"), start, lambda v, _: v)
    giant = cut(found.where("value is not null").select("id"))
    rest = cc_hook(graph.restrict(giant, complement=True))
    name = giant.agg(F.min("id").alias("component"))
    return giant.crossJoin(name).union(rest)  # name is one row


def number_components(found: DataFrame) -> DataFrame:
    """(id, number): components numbered from 0 in the order of their smallest ids."""
    roots = dense_index(found.select("component").distinct(), F.col("component"))
    return found.join(roots, "component").select("id", F.col("lid").alias("number"))


def component_sizes(found: DataFrame, top: int | None = 5) -> DataFrame:
    """(component, size, percent) of the largest components, or of all; ties by the smaller id."""
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    total = found.agg(F.count(F.lit(1)).alias("n"))
    out = sizes.crossJoin(total).select("component", "size", F.round(100 * F.col("size") / F.col("n"), 6).alias("percent"))  # total is one row
    return out if top is None else out.orderBy(F.desc("size"), "component").limit(top)
