"""Summaries of runs and of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafonda.operators.graph import running_sum


def time_statistics(times: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """(mean, sd, min, q1, median, q3, max) of a column, per group if given; quartiles are the values at indices n/4, n/2 and n/4 + n/2.

    Values are counted first and the counts are summed up over range partitions of
    (group, value), so no task holds a group and a frequent value is one row.
    """
    key = F.col(by) if by else F.lit(0)
    rows = times.where(F.col(column).isNotNull()).select(key.alias("_by"), F.col(column).cast("double").alias("x"))
    placed = running_sum(rows.groupBy("_by", "x").agg(F.count(F.lit(1)).alias("n")), "n", F.col("_by"), F.col("x"))
    ends = placed.groupBy("_by").agg(F.min(F.col("upto") - F.col("n")).alias("first"), F.sum("n").alias("size"))
    moments = rows.groupBy("_by").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.min("x").alias("min"), F.max("x").alias("max"))
    quarter, half = F.floor(F.col("size") / 4), F.floor(F.col("size") / 2)
    upto = F.col("upto") - F.col("first")

    def at(index):  # noqa: ANN001, ANN202
        return F.max(F.when((upto - F.col("n") <= index) & (index < upto), F.col("x")))

    same = F.col("p._by").eqNullSafe(F.col("e._by"))
    found = placed.alias("p").join(ends.alias("e"), same).groupBy(F.col("p._by").alias("_by")).agg(at(quarter).alias("q1"), at(half).alias("median"), at(quarter + half).alias("q3"))
    both = found.alias("p").join(moments.alias("e"), same)
    return both.select(*([F.col("p._by").alias(by)] if by else []), "mean", "sd", "min", "q1", "median", "q3", "max")


def visited(found: DataFrame, column: str) -> DataFrame:
    """One row (n_visited): vertices with a value."""
    return found.agg(F.count(column).alias("n_visited"))


def visited_edges(edges: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """One row (n_edges): arcs out of visited vertices."""
    seen = found.where(F.col(column).isNotNull()).select(F.col("id").alias("src"))
    return edges.join(seen, "src", "left_semi").agg(F.count(F.lit(1)).alias("n_edges"))
