"""Text formats, generators and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from grafonda.operators import components
from grafonda.operators.graph import Graph
from grafonda.sources import generators, readers, writers
from grafonda.streaming.ingest import ComponentStream


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_edge_lists(spark, tmp_path):
    (tmp_path / "a1.txt").write_text("% comment\n1 2\n2 2\n\n3\t1\n")
    (tmp_path / "a2.txt").write_text("1 3\n")
    assert rows(readers.edge_list(spark, str(tmp_path / "a1.txt"))) == [(0, 1), (2, 0)]
    assert rows(readers.edge_list(spark, str(tmp_path / "a1.txt"), flip=True)) == [(0, 1), (0, 2), (1, 0), (2, 0)]
    assert rows(readers.segmented(spark, str(tmp_path), "a")) == [(0, 1), (0, 2), (2, 0)]


def test_matrix_market_and_snap(spark, tmp_path):
    m = tmp_path / "m.mtx"
    m.write_text("%%MatrixMarket\n% c\n3 4 3\n1 2\n2 2\n1 2\n")
    assert readers.matrix_market_header(spark, str(m)) == (4, 3)
    assert rows(readers.matrix_market(spark, str(m))) == [(0, 1), (0, 1), (1, 1)]
    assert rows(readers.matrix_market(spark, str(m), preprocess=True)) == [(0, 1)]
    m.write_text("%%MatrixMarket\n3 3 3\n1 2 5\n3 3 3\n% c\n2 1 4\n")  # an entry that reads like the header
    assert rows(readers.matrix_market(spark, str(m))) == [(0, 1), (1, 0), (2, 2)]
    (tmp_path / "parts").mkdir()
    for name, text in (("a", "2 2 1\n1 2\n"), ("b", "% x\n2 2 1\n2 2\n")):
        (tmp_path / "parts" / name).write_text(text)
    assert rows(readers.matrix_market(spark, str(tmp_path / "parts"))) == [(0, 1), (1, 1)]
    s = tmp_path / "s.txt"
    s.write_text("# Nodes: 3 Edges: 2\n# x\n0 1 5\n1 2 7\n")
    assert readers.snap_header(spark, str(s)) == (3, 2)
    assert rows(readers.snap(spark, str(s), weight=True)) == [(0, 1, 5), (1, 2, 7)]


def test_dimacs_and_metis(spark, tmp_path):
    d = tmp_path / "d.gr"
    d.write_text("c x\np sp 3 2\na 1 2 4\na 2 3 6\n")
    g = readers.dimacs(spark, str(d))
    assert g.vertices.count() == 3 and rows(g.edges) == [(0, 1, 4), (1, 2, 6)]
    m = tmp_path / "m.graph"
    m.write_text("5 9 1\n3 1\n2 2 4 1 5 2\n2 7 4 3\n5 1\n1 1 2 1\n")
    want = [(0, 2, 1), (1, 1, 2), (1, 3, 1), (1, 4, 2), (2, 1, 7), (2, 3, 3), (3, 4, 1), (4, 0, 1), (4, 1, 1)]
    assert rows(readers.metis(spark, str(m)).edges) == want
    lines = m.read_text().splitlines(keepends=True)
    (tmp_path / "cut").mkdir()
    for name, part in (("1", lines[:1] * 1 + lines[1:2]), ("2", lines[2:3]), ("0", ["% first\n"]), ("3", ["% " + "long " * 500 + "\n", *lines[3:]])):
        (tmp_path / "cut" / name).write_text("".join(part))
    assert rows(readers.metis(spark, str(tmp_path / "cut")).edges) == want  # by name, though the longest is scanned first


def test_writers(spark, tmp_path):
    g = generators.mesh(spark, 2, 2)
    writers.write_degrees(g, str(tmp_path / "deg"))
    assert rows(spark.read.option("sep", "\t").csv(str(tmp_path / "deg"))) == [(str(i), "2") for i in range(4)]
    writers.write_graphviz(g, str(tmp_path / "dot"), g.vertices.withColumn("x", F.col("id") * 2), cluster=F.col("id") % 2)
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "dot")).collect())
    assert text.startswith("digraph G {") and "0 -> 1;" in text and "subgraph cluster_1" in text and text.endswith("}")


def test_generators(spark):
    for g in (generators.rmat(spark, 8), generators.kronecker(spark, 8), generators.rmat_lower(spark, 8)):
        lo, hi = g.agg(F.min(F.least("src", "dst")), F.max(F.greatest("src", "dst"))).first()
        assert 0 <= lo and hi < 256
    again = [sorted(map(tuple, generators.rmat(spark, 6, seed=9).collect())) for _ in range(2)]
    assert again[0] == again[1]
    assert generators.rmat_unique(spark, 8, 500).distinct().count() == 500
    n = generators.erdos_renyi(spark, 400, 0.02).edges
    assert 2700 < n.count() < 3700 and n.distinct().count() == n.count()
    assert set(r[0] for r in generators.mesh(spark, 5, 4, torus=True).out_degrees().select("out_degree").distinct().collect()) == {4}
    assert generators.small_world(spark, 100, 4, 0.0).edges.count() == 400
    w = readers.with_weights(generators.mesh(spark, 5, 4).edges, 10).agg(F.min("weight"), F.max("weight")).first()
    assert 1 <= w[0] and w[1] <= 10


def test_stream_of_arcs(spark, tmp_path):
    keeper = ComponentStream(spark, str(tmp_path / "forest"))
    frame = lambda pairs: spark.createDataFrame(pairs, "src long, dst long")
    keeper.batch(frame([(3, 4), (1, 2)]), 0)
    keeper.batch(frame([(2, 3)]), 1)
    keeper.batch(frame([(2, 3)]), 1)  # a repeated batch
    assert rows(keeper.forest()) == [(1, 1), (2, 1), (3, 1), (4, 1)]
    whole = Graph.from_edges(frame([(3, 4), (1, 2), (2, 3)]))
    assert rows(components.cc(whole).select("id", "component")) == rows(keeper.forest())


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    frame = lambda pairs: spark.createDataFrame(pairs, "src long, dst long")
    ComponentStream(spark, str(tmp_path / "forest")).batch(frame([(3, 4), (1, 2)]), 0)
    again = ComponentStream(spark, str(tmp_path / "forest"))
    again.batch(frame([(9, 8)]), 0)  # applied before, so it is not taken again
    again.batch(frame([(2, 3)]), 1)
    assert rows(again.forest()) == [(1, 1), (2, 1), (3, 1), (4, 1)]
