"""Text and Parquet readers of edge tables.

All readers are plain scans of text with expressions over each line; a path may be a
file, a folder of segments or a pattern.  Where a line's place matters (the header of
a coordinate file, the vertices of a METIS file), lines are ordered by the file's name,
the place of the scanned stretch in the file and the row in that stretch, so it makes
no difference in which order files and stretches are scanned.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grafonda.functions.bits import uniform
from grafonda.operators.graph import Graph, dense_index


def _lines(spark: SparkSession, path: str, comment: str) -> DataFrame:
    lines = spark.read.text(path).select(F.trim("value").alias("value"))
    return lines.where((F.col("value") != "") & ~F.col("value").startswith(comment))


def _fields(lines: DataFrame, one_based: bool, weight: bool) -> DataFrame:
    parts = F.split("value", r"\s+")
    shift = 1 if one_based else 0
    columns = [(parts[i].cast("bigint") - shift).alias(c) for i, c in enumerate(("src", "dst"))]
    return lines.select(*columns, *([F.get(parts, F.lit(2)).cast("int").alias("weight")] if weight else []))


def _flip(edges: DataFrame, flip: bool) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)) if flip else edges


def edge_list(spark: SparkSession, path: str, *, one_based: bool = True, flip: bool = False, comment: str = "%", drop_loops: bool = True) -> DataFrame:
    """(src, dst) of lines `src dst`; self-loops are dropped."""
    edges = _fields(_lines(spark, path, comment), one_based, False)
    return _flip(edges.where("src <> dst") if drop_loops else edges, flip)


def weighted_edge_list(spark: SparkSession, path: str, *, one_based: bool = False, flip: bool = False, comment: str = "#") -> DataFrame:
    """(src, dst, weight) of lines `src dst w`."""
    return _flip(_fields(_lines(spark, path, comment), one_based, True), flip)


def with_weights(edges: DataFrame, most: int = 255, seed: int = 12345) -> DataFrame:
    """edges with a weight in 1..most that depends on the arc and the seed alone."""
    return edges.withColumn("weight", (F.floor(uniform(seed, "src", "dst") * most) + 1).cast("int"))


def matrix_market_header(spark: SparkSession, path: str) -> tuple[int, int]:
    """(vertices, edges) of the first line that is not a comment: the larger of rows and columns, and the entries."""
    rows, cols, entries = (int(x) for x in _lines(spark, path, "%").first()[0].split()[:3])
    return max(rows, cols), entries


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block, at) of every line: file by name, place of the scan's stretch in it, and the row in that stretch."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return lines.withColumn("at", F.monotonically_increasing_id())


def matrix_market(spark: SparkSession, path: str, *, one_based: bool = True, flip: bool = False, preprocess: bool = False) -> DataFrame:
    """(src, dst) of a coordinate file, or of several; the first line of each file that is no comment is its header, whatever it says."""
    lines = _placed(spark, path).withColumn("value", F.trim("value")).where((F.col("value") != "") & ~F.col("value").startswith("%"))
    place = F.struct("block", "at")
    first = lines.groupBy("file").agg(F.min(place).alias("header"))  # a row per file
    body = lines.join(first, "file").where(place != F.col("header")).select("value")
    edges = _fields(body, one_based, False)
    return _flip(edges.where("src <> dst").distinct() if preprocess else edges, flip)


def snap_header(spark: SparkSession, path: str) -> tuple[int, int]:
    """(vertices, edges) of the comment `# Nodes: N Edges: M`."""
    line = spark.read.text(path).where(F.col("value").rlike(r"^#\s*Nodes:")).first()[0]
    nodes, edges = re.search(r"Nodes:\s*(\d+)\s+Edges:\s*(\d+)", line).groups()
    return int(nodes), int(edges)


def snap(spark: SparkSession, path: str, *, weight: bool = False, flip: bool = False) -> DataFrame:
    return _flip(_fields(_lines(spark, path, "#"), False, weight), flip)


def segmented(spark: SparkSession, folder: str, prefix: str = "", *, one_based: bool = True, preprocess: bool = False) -> DataFrame:
    """Edge lists in all files of a folder whose names begin with the prefix."""
    edges = edge_list(spark, f"{folder.rstrip('/')}/{prefix}*", one_based=one_based)
    return edges.distinct() if preprocess else edges


def dimacs(spark: SparkSession, path: str) -> Graph:
    """`p kind n m`, then `a src dst w` or `e src dst`; ids are made 0-based, missing weights are 1."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select(parts.alias("f"))
    edges = lines.where(F.col("f")[0].isin("a", "e")).select(
        (F.col("f")[1].cast("bigint") - 1).alias("src"), (F.col("f")[2].cast("bigint") - 1).alias("dst"), F.coalesce(F.get("f", F.lit(3)).cast("int"), F.lit(1)).alias("weight")
    )
    n = lines.where(F.col("f")[0] == "p").first()
    vertices = spark.range(int(n[0][2])) if n else edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return Graph(vertices, edges)


def metis(spark: SparkSession, path: str) -> Graph:
    """Header `n m [fmt]`, then one line of 1-based neighbours per vertex, with weights if fmt ends in 1.

    Several files are read one after another in the order of their names, as one.
    """
    lines = _placed(spark, path).where(~F.col("value").startswith("%"))
    numbered = dense_index(lines, F.col("file"), F.col("block"), F.col("at")).select("value", F.col("lid").alias("line"))
    head = numbered.where("line = 0").first()[0].split()
    weighted = len(head) > 2 and head[2].endswith("1")
    n = int(head[0])
    fields = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    step = 2 if weighted else 1
    cells = numbered.where((F.col("line") > 0) & (F.col("line") <= n)).select((F.col("line") - 1).alias("src"), fields.alias("f"))
    pairs = cells.where(F.size("f") >= step).select("src", "f", F.explode(F.sequence(F.lit(0), F.size("f") - step, F.lit(step))).alias("i"))
    weight: Column = F.get("f", F.col("i") + 1).cast("int") if weighted else F.lit(1)
    edges = pairs.select("src", (F.get("f", F.col("i")).cast("bigint") - 1).alias("dst"), weight.alias("weight"))
    return Graph(spark.range(n), edges)


def parquet(spark: SparkSession, path: str, src: str = "src", dst: str = "dst", weight: str | None = None) -> DataFrame:
    """Edge columns of a Parquet table; only those are read."""
    columns = [F.col(src).cast("bigint").alias("src"), F.col(dst).cast("bigint").alias("dst")]
    return spark.read.parquet(path).select(*columns, *([F.col(weight).alias("weight")] if weight else []))
