"""Graph algebra on edge tables.

A graph is vertices(id) and edges(src, dst[, weight]), directed arcs; an undirected
graph holds both arcs.  Every operation is a relational one and returns a new graph.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafonda.plans.scratch import cut


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame

    # -- construction ---------------------------------------------------------
    @staticmethod
    def from_edges(edges: DataFrame, vertices: DataFrame | None = None, src: str = "src", dst: str = "dst", weight: str | None = None) -> Graph:
        """Arcs with null ends are dropped; without a vertex table the vertices are the arcs' ends."""
        columns = [F.col(src).cast("bigint").alias("src"), F.col(dst).cast("bigint").alias("dst")]
        columns += [F.col(weight).alias("weight")] if weight else []
        arcs = edges.select(*columns).where("src is not null and dst is not null")
        ends = arcs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        return Graph(ends if vertices is None else vertices.select(F.col(vertices.columns[0]).cast("bigint").alias("id")).distinct(), arcs)

    def _with(self, edges: DataFrame) -> Graph:
        return Graph(self.vertices, edges)

    def preprocess(self, drop_loops: bool = True) -> Graph:
        """Without repeated arcs (the smallest weight stays) and, by default, without self-loops."""
        arcs = self.edges.where("src <> dst") if drop_loops else self.edges
        return self._with(arcs.groupBy("src", "dst").agg(F.min("weight").alias("weight")) if "weight" in arcs.columns else arcs.distinct())

    def symmetrize(self) -> Graph:
        """Adds the opposite of each arc."""
        return self._with(self.edges.unionByName(self.reverse().edges))

    def reverse(self) -> Graph:
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        return self._with(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))

    # -- mutations ------------------------------------------------------------
    def add_vertices(self, more: DataFrame) -> Graph:
        return Graph(self.vertices.union(more.select(F.col(more.columns[0]).cast("bigint"))).distinct(), self.edges)

    def add_edges(self, more: DataFrame) -> Graph:
        """New ends become vertices."""
        arcs = self.edges.unionByName(more.select(*self.edges.columns))
        return Graph(self.vertices.union(more.select(F.explode(F.array("src", "dst")))).distinct(), arcs)

    def remove_edges(self, gone: DataFrame) -> Graph:
        """Removes every arc between the pairs (src, dst) of `gone`."""
        return self._with(self.edges.join(gone.select("src", "dst"), ["src", "dst"], "left_anti"))

    def remove_edge_if(self, condition: Column) -> Graph:
        return self._with(self.edges.where(~F.coalesce(condition, F.lit(False))))

    def clear_vertices(self, ids: DataFrame, out: bool = True, into: bool = True) -> Graph:
        """Removes the arcs out of and into the given vertices, which stay."""
        gone, arcs = ids.select(F.col(ids.columns[0]).alias("gone")), self.edges
        if out:
            arcs = arcs.join(gone, F.col("src") == F.col("gone"), "left_anti")
        if into:
            arcs = arcs.join(gone, F.col("dst") == F.col("gone"), "left_anti")
        return self._with(arcs)

    def remove_vertices(self, ids: DataFrame) -> Graph:
        gone = ids.select(F.col(ids.columns[0]).alias("id"))
        return Graph(self.vertices.join(gone, "id", "left_anti"), self.clear_vertices(ids).edges)

    # -- access ---------------------------------------------------------------
    def counts(self) -> DataFrame:
        """One row (n_vertices, n_edges)."""
        return self.vertices.agg(F.count(F.lit(1)).alias("n_vertices")).crossJoin(self.edges.agg(F.count(F.lit(1)).alias("n_edges")))  # two single rows

    def verify_counts(self, n_vertices: int, n_edges: int, flipped: bool = False) -> None:
        """Raises unless the counts are the expected ones; a flipped graph has twice the arcs."""
        got = self.counts().first()
        if (got[0], got[1]) != (n_vertices, n_edges * (1 + flipped)):
            raise ValueError(f"expected {n_vertices} vertices and {n_edges * (1 + flipped)} arcs, found {got[0]} and {got[1]}")

    def out_edges(self, ids: DataFrame) -> DataFrame:
        """Arcs out of the given vertices, repeated arcs included."""
        return self.edges.join(ids.select(F.col(ids.columns[0]).alias("src")), "src", "left_semi")

    def adjacent(self) -> DataFrame:
        """(id, neighbours): distinct out-neighbours, ascending."""
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("neighbours"))

    def has_edges(self, pairs: DataFrame) -> DataFrame:
        """pairs(src, dst) with the number of arcs between them as n_arcs."""
        found = self.edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n_arcs"))
        return pairs.join(found, ["src", "dst"], "left").withColumn("n_arcs", F.coalesce("n_arcs", F.lit(0).cast("bigint")))

    def _degrees(self, end: str, name: str) -> DataFrame:
        own = self.edges.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias(name))
        return self.vertices.join(own, "id", "left").select("id", F.coalesce(name, F.lit(0).cast("bigint")).alias(name))

    def out_degrees(self) -> DataFrame:
        return self._degrees("src", "out_degree")

    def in_degrees(self) -> DataFrame:
        return self._degrees("dst", "in_degree")

    def degrees(self) -> DataFrame:
        return self.out_degrees().join(self.in_degrees(), "id")

    # -- views ----------------------------------------------------------------
    def filter(self, edge: Column | None = None, vertex: Column | None = None) -> Graph:
        """Arcs and vertices that satisfy the predicates; arcs with a removed end go too."""
        arcs = self.edges if edge is None else self.edges.where(edge)
        if vertex is None:
            return self._with(arcs)
        kept = self.vertices.where(vertex)
        return Graph(kept, arcs).restrict(kept)

    def restrict(self, ids: DataFrame, complement: bool = False) -> Graph:
        """The subgraph on the given vertices, or on all others."""
        chosen = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
        kept = self.vertices.join(chosen, "id", "left_anti" if complement else "left_semi")
        arcs = self.edges.join(kept.select(F.col("id").alias("src")), "src", "left_semi").join(kept.select(F.col("id").alias("dst")), "dst", "left_semi")
        return Graph(kept, arcs.select(*self.edges.columns))

    def local_subgraph(self, owner: Callable[[Column], Column]) -> Graph:
        """Arcs whose ends have the same owner(id)."""
        return self._with(self.edges.where(owner(F.col("src")) == owner(F.col("dst"))))

    # -- numberings -----------------------------------------------------------
    def index(self) -> DataFrame:
        """(id, lid): dense numbers from 0 in the order of ids; a range sort and two passes, no single task."""
        return dense_index(self.vertices, F.col("id"))

    def horizontal_ids(self, parts: int) -> DataFrame:
        """(id, lid): round-robin numbers, lid = local * parts + owner of block-assigned ids."""
        block = F.ceil((self.vertices.agg(F.max("id") + 1).first()[0] or 0) / F.lit(parts)).cast("bigint")
        return self.vertices.select("id", (F.pmod("id", block) * parts + F.floor(F.col("id") / block)).cast("bigint").alias("lid"))

    def vertical_ids(self) -> DataFrame:
        return self.vertices.select("id", F.col("id").alias("lid"))

    def degree_ids(self, descending: bool = False) -> DataFrame:
        """(id, lid): rank by out-degree; ties by id."""
        ranked = self.out_degrees()
        sign = -1 if descending else 1
        return dense_index(ranked, F.col("out_degree") * sign, F.col("id")).select("id", "lid")

    def renumber(self, mapping: DataFrame) -> Graph:
        """The graph under new ids; mapping(id, lid) must cover the vertices."""
        a, b = mapping.select(F.col("id").alias("src"), F.col("lid").alias("s")), mapping.select(F.col("id").alias("dst"), F.col("lid").alias("d"))
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        arcs = self.edges.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), *rest)
        return Graph(self.vertices.join(mapping, "id").select(F.col("lid").alias("id")), arcs)

    def redistribute(self, mapping: DataFrame, flip: bool = False) -> Graph:
        """Renumbered, without self-loops, with opposite arcs if flip, dealt by source."""
        moved = self.renumber(mapping)
        moved = moved._with(moved.edges.where("src <> dst"))
        moved = moved.symmetrize() if flip else moved
        return moved._with(moved.edges.repartition("src"))


def _numbered(rows: DataFrame, size: Column, inside: Column, *order: Column) -> DataFrame:
    """rows with _at, `inside` over the rows so far in a range partition, and _before, the summed sizes of the partitions before it."""
    keyed = rows.select("*", F.struct(*order).alias("_key"))
    parts = cut(keyed.repartitionByRange("_key").withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(size.alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    so_far = Window.partitionBy("_part").orderBy("_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return parts.withColumn("_at", inside.over(so_far)).join(F.broadcast(before), "_part")  # one row per partition


def dense_index(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with lid, dense from 0 in the given order.

    Range partitions are sorted on their own and numbered from the sums of the
    partitions before them; only one count per partition meets in one place.
    """
    found = _numbered(rows, F.count(F.lit(1)), F.row_number(), *order)
    return found.select(*rows.columns, (F.col("_before") + F.col("_at") - 1).cast("bigint").alias("lid"))


def running_sum(rows: DataFrame, column: str, *order: Column) -> DataFrame:
    """rows with upto, the sum of the column over this row and all before it; made like `dense_index`."""
    found = _numbered(rows, F.sum(column), F.sum(column), *order)
    return found.select(*rows.columns, (F.col("_before") + F.col("_at")).cast("bigint").alias("upto"))


def followers(rows: DataFrame, column: str, *order: Column) -> DataFrame:
    """rows with next, the column's value in the next row of the order; the last row, which has none, is left out.

    Range partitions are sorted on their own; the first row of each is also handed to
    the partition before it.
    """
    keyed = rows.select("*", F.struct(*order).alias("_key"))
    parts = cut(keyed.repartitionByRange("_key").withColumn("_part", F.spark_partition_id()))
    heads = parts.groupBy("_part").agg(F.min(F.struct("_key", F.col(column).alias("v"))).alias("head")).orderBy("_part")
    to = heads.select(F.lag("_part").over(Window.orderBy("_part")).alias("_part"), F.col("head.v").alias("_head")).where("_part is not null")
    inside = F.lead(F.struct(F.col(column).alias("v"))).over(Window.partitionBy("_part").orderBy("_key"))
    found = parts.withColumn("_next", inside).join(F.broadcast(to), "_part", "left")  # one row per partition
    nxt = F.when(F.col("_next").isNotNull(), F.col("_next.v")).otherwise(F.col("_head"))
    return found.where("_next is not null or _head is not null").select(*rows.columns, nxt.alias("next"))
