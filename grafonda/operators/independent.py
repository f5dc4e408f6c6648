"""Maximal independent sets and greedy colouring, in rounds over what is undecided.

Graphs must be symmetric and are read without self-loops and repeated arcs.  An
isolated vertex is in the set and has colour 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafonda.functions.bits import uniform
from grafonda.operators.graph import Graph
from grafonda.plans.scratch import cut, drop

#: Tables of decided vertices that are read side by side before they become one.
MERGE = 16


def _arcs(graph: Graph) -> DataFrame:
    return cut(graph.edges.where("src <> dst").select("src", "dst").distinct())


def _numbered_rounds(most: int | None) -> Iterator[int]:
    return count() if most is None else iter(range(most))


def mis_fix(graph: Graph, max_rounds: int | None = None) -> DataFrame:
    """(id, in_mis): the set in which a vertex is in exactly if no smaller neighbour is.

    A round takes in the open vertices without a smaller open neighbour and shuts out
    their neighbours.  Only what is still open, and the arcs between open vertices, is
    written again, so the tables shrink with the rounds.
    """
    live = _arcs(graph).where("src < dst")
    held = live = cut(live)
    left = cut(graph.vertices.select("id"))
    chosen: DataFrame | None = None
    for _ in _numbered_rounds(max_rounds):
        ready = cut(left.join(live.select(F.col("dst").alias("id")).distinct(), "id", "left_anti"))
        out = live.join(ready.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        still = cut(left.join(ready.union(out), "id", "left_anti"))
        arcs = live.join(still.select(F.col("id").alias("src")), "src", "left_semi").join(still.select(F.col("id").alias("dst")), "dst", "left_semi")
        chosen = ready if chosen is None else chosen.union(ready)
        drop(left)
        left = still
        if not left.take(1):
            drop(held)
            return graph.vertices.join(chosen.withColumn("in_mis", F.lit(True)), "id", "left").select("id", F.coalesce("in_mis", F.lit(False)).alias("in_mis"))
        live = cut(arcs.select("src", "dst"))
        drop(held)
        held = live
    raise RuntimeError("the independent set did not settle")


def _luby(graph: Graph, select: Column, priority: Column, seed: int, max_rounds: int | None) -> DataFrame:
    """Rounds of: candidates by `select`, a candidate stays if its priority beats that of its candidate neighbours."""
    arcs = _arcs(graph)
    state = cut(graph.vertices.select("id", F.lit(None).cast("boolean").alias("in_mis")))
    for number in _numbered_rounds(max_rounds):
        active = state.where("in_mis is null").select("id")
        live = arcs.join(active.withColumnRenamed("id", "src"), "src", "left_semi").join(active.withColumnRenamed("id", "dst"), "dst", "left_semi")
        degrees = active.join(live.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree")), "id", "left")
        drawn = degrees.select("id", F.coalesce("degree", F.lit(0)).alias("degree")).withColumn("coin", uniform(seed + number, "id"))
        chosen = cut(drawn.where(select).select("id", priority.alias("rank")))
        rivals = live.join(chosen.toDF("src", "mine"), "src").join(chosen.toDF("dst", "theirs"), "dst")
        lost = rivals.where("mine >= theirs").select(F.col("src").alias("id")).distinct()
        joined = cut(chosen.join(lost, "id", "left_anti").select("id", F.lit(True).alias("won")))
        near = arcs.join(joined.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id"), F.lit(True).alias("near")).distinct()
        verdict = F.when(F.col("in_mis").isNotNull(), F.col("in_mis")).when(F.col("won"), True).when(F.col("near"), False)
        fresh = cut(state.join(joined, "id", "left").join(near, "id", "left").select("id", verdict.alias("in_mis")))
        for old in (state, chosen, joined):
            drop(old)
        state = fresh
        if not state.where("in_mis is null").take(1):
            return state
    raise RuntimeError("the independent set did not settle")


def mis_luby_a(graph: Graph, seed: int = 1, max_rounds: int | None = None) -> DataFrame:
    """(id, in_mis): every round each vertex draws a key and the local minima join; on equal keys the lower id loses."""
    return _luby(graph, F.lit(True), F.struct("coin", -F.col("id")), seed, max_rounds)


def mis_luby_ids(graph: Graph, max_rounds: int | None = None) -> DataFrame:
    """(id, in_mis): rounds with the id as the key; the set is that of `mis_fix`."""
    return _luby(graph, F.lit(True), F.struct(F.col("id")), 0, max_rounds)


def mis_luby_b(graph: Graph, seed: int = 1, max_rounds: int | None = None) -> DataFrame:
    """(id, in_mis): candidates with probability 1/(2 degree); of two candidates the one of no higher degree drops out."""
    share = F.when(F.col("degree") == 0, 1.0).otherwise(1 / (2 * F.greatest("degree", F.lit(1))))
    return _luby(graph, F.col("coin") < share, F.struct(-F.col("degree")), seed, max_rounds)


def colouring(graph: Graph, max_rounds: int | None = None) -> DataFrame:
    """(id, color): the smallest colour that no smaller neighbour has, decided once all of those are decided.

    Arcs to open vertices carry the colour of their smaller end once it is known; what
    a round writes again are these arcs, which shrink with the open vertices.
    """
    arcs = _arcs(graph).where("src < dst")
    fresh = cut(graph.vertices.join(arcs.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").select("id", F.lit(0).alias("color")))
    held = arcs = cut(arcs.select("src", "dst", F.lit(None).cast("int").alias("color")))
    done = [fresh]
    for _ in _numbered_rounds(max_rounds):
        known = arcs.join(fresh.select(F.col("id").alias("src"), F.col("color").alias("new")), "src", "left").select("src", "dst", F.coalesce("color", "new").alias("color"))
        arcs = cut(known.join(fresh.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst", "color"))
        drop(held)
        held = arcs
        votes = arcs.groupBy(F.col("dst").alias("id")).agg(F.collect_set("color").alias("used"), F.count_if(F.col("color").isNull()).alias("waits")).where("waits = 0")
        fresh = cut(votes.select("id", F.array_min(F.array_except(F.sequence(F.lit(0), F.size("used")), F.col("used"))).cast("int").alias("color")))
        if not fresh.take(1):  # the least open vertex never waits: none is open
            drop(held)
            return reduce(DataFrame.union, done)
        done.append(fresh)
        if len(done) >= MERGE:
            merged = cut(reduce(DataFrame.union, done[:-1]))
            for table in done[:-1]:
                drop(table)
            done = [merged, fresh]
    raise RuntimeError("the colouring did not settle")
