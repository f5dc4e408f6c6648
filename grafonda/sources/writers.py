"""Writers of graphs and of degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafonda.operators.graph import Graph


def graphviz_lines(graph: Graph, labels: DataFrame | None = None, *, directed: bool = True, cluster: Column | None = None) -> DataFrame:
    """(rank, cluster, step, line) of a DOT file, in the order of these columns: vertices with the label column of labels(id, label), arcs with their weights as labels.

    `cluster`, an expression of id, puts vertices into numbered clusters; a cluster is
    an opening line, a line per vertex and a closing line.
    """
    named = graph.vertices if labels is None else graph.vertices.join(labels.select("id", F.col(labels.columns[1]).cast("string").alias("label")), "id", "left")
    tag = F.lit("") if labels is None else F.concat(F.lit(' [label="'), F.coalesce("label", F.lit("")), F.lit('"]'))
    none = F.lit(None).cast("bigint")
    nodes = named.select(F.lit(1).alias("rank"), (none if cluster is None else cluster.cast("bigint")).alias("cluster"), F.lit(1).alias("step"), F.concat(F.col("id").cast("string"), tag, F.lit(";")).alias("line"))
    if cluster is not None:
        clusters = nodes.where("cluster is not null").select("rank", "cluster").distinct()
        nodes = nodes.union(clusters.select("rank", "cluster", F.lit(0), F.concat(F.lit("subgraph cluster_"), F.col("cluster").cast("string"), F.lit(" {"))))
        nodes = nodes.union(clusters.select("rank", "cluster", F.lit(2), F.lit("}")))
    arrow = " -> " if directed else " -- "
    weight = F.concat(F.lit(' [label="'), F.col("weight").cast("string"), F.lit('"]')) if "weight" in graph.edges.columns else F.lit("")
    arcs = graph.edges.select(F.lit(2), none, F.lit(1), F.concat(F.col("src").cast("string"), F.lit(arrow), F.col("dst").cast("string"), weight, F.lit(";")))
    frame = [(0, None, 1, ("digraph" if directed else "graph") + " G {"), (3, None, 1, "}")]
    return nodes.union(arcs).union(graph.vertices.sparkSession.createDataFrame(frame, "rank int, cluster long, step int, line string"))


def write_graphviz(graph: Graph, path: str, labels: DataFrame | None = None, **options) -> None:  # noqa: ANN003
    """DOT is one file by its format, so one task writes it: for graphs that are drawn."""
    lines = graphviz_lines(graph, labels, **options).repartition(1).sortWithinPartitions("rank", "cluster", "step", "line")
    lines.select("line").write.mode("overwrite").text(path)


def write_degrees(graph: Graph, path: str) -> None:
    """Tab-separated vertex and out-degree, a file per partition."""
    graph.out_degrees().write.mode("overwrite").option("sep", "\t").csv(path)
