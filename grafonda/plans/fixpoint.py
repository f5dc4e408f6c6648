"""The loop behind the monotone kernels.

The values of all vertices stand in a table that a round never rewrites (`Falling`);
what is pending is a table of items, at most one per vertex.  Each round takes the
items of the lowest bucket, sends their values along their arcs and keeps the least
item per target, combined on the map side.  Targets are looked up in the values, and
the rows that are better than what stands there are written: they are the round's
change of the values and the new items.  So what a round writes follows the frontier,
not the graph, and the plan never grows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafonda.functions.orderings import ByVertex, Ordering, chaotic
from grafonda.plans import blocks
from grafonda.plans.deltas import Falling
from grafonda.plans.scratch import cut, drop


@dataclass
class WorkStats:
    """Work items by outcome: first values, later improvements, items that changed nothing, arcs followed."""

    rounds: int = 0
    useful: int = 0
    invalidated: int = 0
    rejected: int = 0
    edges: int = 0
    by_round: list[tuple[int, int, int]] = field(default_factory=list)

    def teps(self, seconds: float) -> float:
        """Traversed edges per second."""
        return self.edges / seconds if seconds else 0.0


def _fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark would send the table to every task, by its measured size."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= limit


def fixpoint(
    vertices: DataFrame,
    edges: DataFrame,
    start: DataFrame,
    message: Callable[[Column, Column], Column],
    *,
    ordering: Ordering | None = None,
    slack: Callable[[int], int] | None = None,
    light: Column | None = None,
    max_level: int | None = None,
    max_rounds: int | None = None,
    stats: WorkStats | None = None,
) -> DataFrame:
    """(id, value, level) of every vertex: the least value over all paths from `start`(id, cand).

    vertices(id); edges(src, dst[, weight]); message(value, weight) is what a vertex
    sends along an arc and must not decrease when the value does not.  Level counts
    the arcs of the path that brought the value; with `max_level`, paths end there.
    slack(round), rounds from 0, lets buckets up to that much above the lowest run too.
    With `light`, a condition on weight, items send along light arcs only while their
    bucket is being drained; what the bucket settled then sends along the other arcs
    once.  Without `max_rounds` the loop ends when nothing is pending.  Orderings of
    vertices are drained in parts (`blocks`), unless slack, light or stats ask for one
    bucket at a time.
    """
    if isinstance(ordering, ByVertex) and slack is None and light is None and stats is None and blocks.takes(start.schema["cand"].dataType):
        return blocks.drained(vertices, edges, start, message, ordering=ordering, max_level=max_level, max_rounds=max_rounds)
    bucket_of = (ordering or chaotic())()
    bucket = F.lit(0).cast("bigint") if bucket_of is None else bucket_of
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1)
    arcs = cut(edges.select("src", "dst", weight.alias("weight")))
    kind = start.schema["cand"].dataType
    item = F.struct(F.col("cand").cast(kind).alias("cand"), F.col("level").cast("int").alias("level"))
    first = start.where("cand is not null").groupBy("id").agg(F.min("cand").alias("cand")).withColumn("level", F.lit(0))
    values = Falling(vertices.join(first, "id", "left").select("id", F.when(F.col("cand").isNotNull(), item).alias("value")))
    waits = F.lit(True) if max_level is None else F.col("level") < max_level
    small = _fits_broadcast(values.base)
    settled: list[DataFrame] = []  # what ran in the bucket at hand
    current = None

    def relax(live: DataFrame, along: DataFrame, rest: DataFrame | None) -> tuple[DataFrame, int]:
        """What is pending after a round, written: the rows that became better (changed, and fresh if they had no value) and the rest that did not; and the number of items that arrived."""
        sent = live.select(F.col("id").alias("src"), "cand", (F.col("level") + 1).cast("int").alias("level")).join(along, "src")
        sent = sent.select(F.col("dst").alias("id"), message(F.col("cand"), F.col("weight")).cast(kind).alias("cand"), "level").where("cand is not null")
        best = sent.groupBy("id").agg(F.min(item).alias("value"), F.count(F.lit(1)).alias("n"))
        if small:  # all values are looked at in the same job
            now = values.table()
        else:  # a written table has a known size: if it is small, it is sent to the values, and they are not moved
            best = cut(best)
            now = values.of(best)
        met = best.join(now.withColumnRenamed("value", "now"), "id")
        arrived = 0 if stats is None else met.agg(F.sum("n")).first()[0] or 0
        better = met.where("now is null or value.cand < now.cand").select("id", "value", F.col("now").isNull().alias("fresh"))
        if rest is not None:
            both = better.withColumnRenamed("value", "new").join(rest.select("id", "value"), "id", "full_outer")
            better = both.select("id", F.coalesce("new", "value").alias("value"), F.col("new").isNotNull().alias("changed"), F.coalesce("fresh", F.lit(False)).alias("fresh"))
        else:
            better = better.withColumn("changed", F.lit(True))
        step = cut(better.select("id", "value.cand", "value.level", "changed", "fresh", "value"))
        if not small:
            drop(best)
        return step, arrived

    begun = values.base.where("value is not null")
    pending, arrived = cut(begun.select("id", "value.cand", "value.level", F.lit(True).alias("changed"), F.lit(True).alias("fresh"), "value")), 0
    number = 0
    while max_rounds is None or number <= max_rounds:
        counts = [F.count(F.lit(1)), F.count_if("changed"), F.count_if("fresh")]
        lowest, highest, rows, moved, fresh = pending.agg(F.min(F.when(waits, bucket)), F.max(F.when(waits, bucket)), *counts).first()
        if number:
            values.add(pending, rows)
        if stats is not None:
            tried = arrived if number else moved  # the values that began count as items that were of use
            stats.useful, stats.invalidated = stats.useful + fresh, stats.invalidated + moved - fresh
            stats.rejected, stats.edges = stats.rejected + tried - moved, stats.edges + arrived
            stats.rounds += 1
            stats.by_round.append((fresh, moved - fresh, tried - moved))
        if settled and lowest != current:  # the bucket is drained: its last values go along the heavy arcs
            ran = cut(reduce(DataFrame.union, settled).select("id").distinct())
            following = relax(values.of(ran).select("id", "value.cand", "value.level"), arcs.where(~light), pending)
            for table in (*settled, ran):
                drop(table)
            settled = []
        elif lowest is None:
            break
        else:
            upto = lowest + (slack(number) if slack else 0)
            live = pending.where(waits & (bucket <= upto))
            if light is not None:
                live = cut(live.select("id", "cand", "level"))
                settled.append(live)
                current = lowest
            rest = pending.where(waits & (bucket > upto)) if highest > upto else None
            following = relax(live, arcs if light is None else arcs.where(light), rest)
        if not number:
            drop(pending)  # all others belong to the values
        pending, arrived = following
        number += 1
    else:
        raise RuntimeError(f"no fixpoint in {max_rounds} rounds")
    drop(arcs)
    return values.finish().select("id", "value.cand", "value.level").toDF("id", "value", "level")
