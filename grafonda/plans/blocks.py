"""The loop for orderings of vertices: a vertex is always in the same bucket, so buckets are drained where they lie.

Drained one after another over the whole graph, buckets of vertices take a round for
nearly each bucket and step of a path.  Here runs of neighbouring buckets are parts of
bounded size.  A round drains each part that has pending items by itself, in one task,
lowest bucket first, along the arcs inside the part; what ran then sends along the arcs
that leave its part, once.  So rounds follow the parts that a path crosses, and parts
run side by side, as the processes of a distributed graph do.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, DoubleType, IntegerType, LongType, ShortType

from grafonda.functions.orderings import Ordering
from grafonda.plans.deltas import Falling
from grafonda.plans.scratch import cut, drop

#: Vertices and arcs of a part, about: a task holds those of one part.
PART_ROWS = 1 << 20
#: Weights beyond it (and null or other types of weights) are added by Spark alone, arc by arc between rounds.
_LARGEST = 1 << 53
_WHOLE = (ByteType, ShortType, IntegerType, LongType)


def takes(kind: DataType) -> bool:
    """Whether values of this type can be drained in parts."""
    return isinstance(kind, (IntegerType, LongType, DoubleType))


def _drain(message: Callable, whole: bool, max_level: int | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function of a part's arcs (src, dst, weight) and vertices (id, bucket, cand, level, hot) that drains it: (part, id, cand, level) of what ran.

    It is sent to workers by value, which need not have this package.
    """

    def run(arcs, members):
        import numpy as np
        import pyarrow as pa

        def column(table, name, kind):
            return table.column(name).to_numpy().astype(kind, copy=False)

        members = members.sort_by([("bucket", "ascending"), ("id", "ascending")])
        ids, bucket, hot = column(members, "id", np.int64), column(members, "bucket", np.int64), column(members, "hot", bool).copy()
        kind = np.int64 if whole else np.float64
        known = members.column("cand").is_valid().to_numpy().copy()
        value, level = column(members.set_column(members.column_names.index("cand"), "cand", members.column("cand").fill_null(0)), "cand", kind).copy(), members.column("level").fill_null(0).to_numpy().astype(np.int64)
        ran = np.zeros(len(ids), bool)
        by_id = np.argsort(ids)
        place = lambda x: by_id[np.searchsorted(ids, x, sorter=by_id)]
        src, dst, weight = place(column(arcs, "src", np.int64)), place(column(arcs, "dst", np.int64)), arcs.column("weight").to_numpy()
        order = np.argsort(src, kind="stable")
        dst, weight = dst[order].astype(np.int32), weight[order]
        first = np.searchsorted(src[order], np.arange(len(ids) + 1))
        del src, order, by_id
        if max_level is not None:
            hot &= level < max_level
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        ends = np.r_[starts[1:], len(ids)]
        class_of = np.repeat(np.arange(len(starts)), ends - starts)
        waiting = np.bincount(class_of[hot], minlength=len(starts))
        while waiting.any():
            b = int(np.argmax(waiting > 0))
            live = starts[b] + np.flatnonzero(hot[starts[b] : ends[b]])
            hot[live], waiting[b], ran[live] = False, 0, True
            n = first[live + 1] - first[live]
            at = np.repeat(first[live] - np.cumsum(n) + n, n) + np.arange(n.sum())
            if not len(at):
                continue
            old = np.repeat(value[live], n)
            to, cand, steps = dst[at], np.asarray(message(old, weight[at])).astype(kind), np.repeat(level[live] + 1, n)
            if whole and ((old > 0) & (cand < old - 2 * _LARGEST)).any():
                raise OverflowError("a sum is out of range")
            better = ~known[to] | (cand < value[to])
            to, cand, steps = to[better], cand[better], steps[better]
            best = np.lexsort((steps, cand, to))
            to, cand, steps = to[best], cand[best], steps[best]
            one = np.r_[True, to[1:] != to[:-1]] if len(to) else np.zeros(0, bool)
            to, cand, steps = to[one], cand[one], steps[one]
            value[to], level[to], known[to] = cand, steps, True
            ran[to] = True  # at the last level, what got better is given back too
            if max_level is not None:
                to = to[steps < max_level]
            fresh = to[~hot[to]]
            hot[fresh] = True
            waiting += np.bincount(class_of[fresh], minlength=len(starts))
        part = members.column("part")[0].as_py()
        n = int(ran.sum())
        return pa.table({"part": pa.array(np.full(n, part, np.int32)), "id": ids[ran], "cand": value[ran], "level": level[ran].astype(np.int32)})

    return run


def drained(vertices: DataFrame, edges: DataFrame, start: DataFrame, message: Callable[[Column, Column], Column], *, ordering: Ordering, max_level: int | None = None, max_rounds: int | None = None) -> DataFrame:
    """(id, value, level) as `fixpoint` gives it, for an ordering whose bucket is made of id alone.

    `message` is also called with arrays, so it has to be arithmetic.
    """
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1)
    arcs = cut(edges.select("src", "dst", weight.alias("weight")))
    kind, weighs = start.schema["cand"].dataType, arcs.schema["weight"].dataType
    item = F.struct(F.col("cand").cast(kind).alias("cand"), F.col("level").cast("int").alias("level"))
    first = start.where("cand is not null").groupBy("id").agg(F.min("cand").alias("cand")).withColumn("level", F.lit(0))

    # parts of about as many vertices and arcs, by bucket and id; the ends of a part are its own
    ids = cut(vertices.select(F.col("id").cast("bigint").alias("id"), F.lit(True).alias("own")))
    rows = ids.union(arcs.select(F.col("src").cast("bigint"), F.lit(False)))
    n_parts = max(1, -(-rows.count() // PART_ROWS))
    dealt = rows.withColumn("bucket", ordering()).repartitionByRange(n_parts, "bucket", "id").select("id", "own", F.spark_partition_id().alias("part"))
    place = cut(dealt.groupBy("id", "part").agg(F.max("own").alias("own")).where("own").select("id", "part"))
    to = place.select(F.col("id").alias("dst"), F.col("part").alias("dst_part"))
    placed = arcs.join(place.withColumnRenamed("id", "src"), "src").join(to, "dst")
    simple = F.col("weight").between(-_LARGEST, _LARGEST) if isinstance(weighs, (*_WHOLE, DoubleType)) else F.lit(False)
    own = F.coalesce((F.col("part") == F.col("dst_part")) & simple, F.lit(False))
    inner = cut(placed.where(own).select("part", "src", "dst", "weight").repartition(n_parts, "part"), "part")
    outer = cut(placed.where(~own).select("src", "dst", "weight", "dst_part"))
    drop(arcs)
    drop(ids)
    crossed = bool(outer.take(1))

    values = Falling(place.join(first, "id", "left").select("part", "id", F.when(F.col("cand").isNotNull(), item).alias("value")), "part")
    drain = _drain(message, not isinstance(kind, DoubleType), max_level)
    flat = ("part", "id", "value.cand", "value.level", "value")
    pending = cut(values.base.where("value is not null").select(*flat))
    number = 0
    while max_rounds is None or number <= max_rounds:
        rows, touched = pending.agg(F.count(F.lit(1)), F.collect_set("part")).first()
        if number:
            values.add(pending, rows)
        if not rows:
            break
        here = F.col("part").isin(touched)
        hot = pending.select("part", "id", F.lit(True).alias("hot"))
        members = values.table().where(here & F.col("id").isNotNull()).join(hot, ["part", "id"], "left")
        members = members.select("part", "id", ordering().cast("bigint").alias("bucket"), "value.cand", "value.level", F.coalesce("hot", F.lit(False)).alias("hot"))
        done = inner.where(here).groupBy("part").cogroup(members.groupBy("part")).applyInArrow(drain, "part int, id bigint, cand " + ("double" if isinstance(kind, DoubleType) else "bigint") + ", level int")
        ran = cut(done.withColumn("value", item).select(*flat))
        if not number:
            drop(pending)  # all others belong to the values
        values.add(ran, ran.count())
        number += 1
        if not crossed:
            break
        live = ran if max_level is None else ran.where(F.col("level") < max_level)
        sent = live.select(F.col("id").alias("src"), "cand", (F.col("level") + 1).cast("int").alias("level")).join(outer, "src")
        sent = sent.select(F.col("dst_part").alias("part"), F.col("dst").alias("id"), message(F.col("cand"), F.col("weight")).cast(kind).alias("cand"), "level").where("cand is not null")
        best = cut(sent.groupBy("part", "id").agg(F.min(item).alias("value")))
        met = best.join(values.of(best).select("id", F.col("value").alias("now")), "id")
        pending = cut(met.where("now is null or value.cand < now.cand").select(*flat))
        drop(best)
    else:
        raise RuntimeError(f"no fixpoint in {max_rounds} rounds")
    for table in (inner, outer, place):
        drop(table)
    return values.finish().select("id", "value.cand", "value.level").toDF("id", "value", "level")
