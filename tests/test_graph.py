"""Kernels on small graphs against values worked out by hand or by plain Python."""

from __future__ import annotations

import heapq
import random

import pytest
from pyspark.sql import functions as F

from grafonda.functions import bits, orderings
from grafonda.operators import checks, components, cores, independent, ranks, summaries, traversal, triangles
from grafonda.operators.graph import Graph
from grafonda.plans.fixpoint import WorkStats

H1 = [(0, 2, 1), (1, 1, 2), (1, 3, 1), (1, 4, 2), (2, 1, 7), (2, 3, 3), (3, 4, 1), (4, 0, 1), (4, 1, 1)]
H2 = [(0, 1, 10), (0, 2, 5), (1, 3, 1), (1, 2, 2), (2, 1, 3), (2, 3, 9), (2, 4, 2), (3, 4, 4), (4, 3, 6), (4, 0, 7)]


def graph(spark, arcs, n):
    rows = [(a[0], a[1], a[2] if len(a) > 2 else 1) for a in arcs]
    return Graph.from_edges(spark.createDataFrame(rows, "src long, dst long, weight int"), spark.range(n), weight="weight")


@pytest.fixture(scope="module")
def h3(spark):
    return graph(spark, [(0, 1), (1, 2), (0, 2), (2, 3)], 5).symmetrize()


def values(df, column):
    return {r["id"]: r[column] for r in df.collect()}


def source(spark):
    return spark.createDataFrame([(0,)], "id long")


def test_shortest_paths_of_the_samples(spark):
    g = graph(spark, H1, 5)
    want = {0: 0, 1: 6, 2: 1, 3: 4, 4: 5}
    assert values(traversal.sssp(g, source(spark)), "dist") == want
    for order in (orderings.delta(3), orderings.named("thread_klevel", 2), orderings.dijkstra(), orderings.vertex_delta(2)):
        assert values(traversal.sssp(g, source(spark), order), "dist") == want
    assert values(traversal.sssp_eager(g, source(spark), 1), "dist") == want
    assert values(traversal.bfs(g, source(spark)), "level") == {0: 0, 2: 1, 1: 2, 3: 2, 4: 3}
    assert values(traversal.sssp_delta(graph(spark, H2, 5), source(spark)), "dist") == {0: 0, 1: 8, 2: 5, 3: 9, 4: 7}
    assert not checks.check_sssp(g, traversal.sssp(g, source(spark)), source(spark)).collect()
    assert traversal.auto_delta(g) == 2


def test_heavy_arcs_go_once(spark):
    rng = random.Random(3)
    arcs = [(rng.randrange(40), rng.randrange(40), rng.choice([1, 2, 3, 30, 45])) for _ in range(110)]
    g = graph(spark, arcs, 40)
    want = values(traversal.sssp(g, source(spark)), "dist")
    for width in (2, 10, 50):
        assert values(traversal.sssp_delta(g, source(spark), width), "dist") == want


def test_rounds_write_the_frontier_only(spark, monkeypatch):
    """On a long path every round has one pending vertex; the values are read, not rewritten."""
    from grafonda.plans import deltas, fixpoint

    n, written = 12, []
    g = graph(spark, [(i, i + 1) for i in range(n - 1)], n)
    monkeypatch.setattr(fixpoint, "_fits_broadcast", lambda _: False)

    def counted(df, *columns):
        out = keep(df, *columns)
        written.append(out.count())
        return out

    keep = fixpoint.cut
    monkeypatch.setattr(fixpoint, "cut", counted)
    monkeypatch.setattr(deltas.Falling, "MOST", 3)
    assert values(traversal.bfs(g, source(spark)), "level") == {i: i for i in range(n)}
    assert written[0] == n - 1 and max(written[1:]) == 1


def test_vertex_buckets_are_drained_in_parts(spark, monkeypatch):
    """A path that jumps between buckets of vertices takes a round for each part it enters, not for each arc."""
    from grafonda.plans import blocks, fixpoint

    n, rounds = 24, []
    path = [i // 2 if i % 2 == 0 else n - 1 - i // 2 for i in range(n)]
    g = graph(spark, list(zip(path, path[1:])), n + 1)

    def counted(df, *columns):
        rounds.append(1)
        return keep(df, *columns)

    keep = blocks.cut
    for module in (blocks, fixpoint):  # every round writes a table at least
        monkeypatch.setattr(module, "cut", counted)
    assert values(traversal.sssp(g, source(spark), orderings.vertex_delta(3)), "dist") == {v: i for i, v in enumerate(path)} | {n: None}
    assert len(rounds) < 10


def test_parts_of_vertex_buckets_give_the_same_distances(spark, monkeypatch):
    from grafonda.plans import blocks

    rng = random.Random(5)
    arcs = [(rng.randrange(14), rng.randrange(14), rng.choice([0, 1, 2, 9, 2**30])) for _ in range(26)]
    odd = [(0, 1, None), (0, 77, 1), (77, 2, 0)]  # without a weight, to and from no vertex

    def nearest(cost):
        found = {0: 0, 7: 0}
        for _ in range(16):
            for a, b, w in arcs:
                if a in found:
                    found[b] = min(found.get(b, found[a] + cost(w)), found[a] + cost(w))
        return {v: found.get(v) for v in range(16)}

    two = spark.createDataFrame([(0,), (7,)], "id long")
    monkeypatch.setattr(blocks, "PART_ROWS", 25)
    g = Graph(spark.range(16), spark.createDataFrame(arcs + odd, "src long, dst long, weight int"))
    assert values(traversal.sssp(g, two, orderings.vertex_delta(4)), "dist") == nearest(lambda w: w)
    g = Graph(spark.range(16), spark.createDataFrame(arcs, "src long, dst long, weight int"))
    assert values(traversal.bfs(g, two, orderings.vertex_delta(4), max_level=2), "level") == {v: x if x is not None and x <= 2 else None for v, x in nearest(lambda w: 1).items()}


def test_random_graph_against_dijkstra(spark):
    rng = random.Random(1)
    arcs = [(rng.randrange(60), rng.randrange(60), rng.randint(0, 20)) for _ in range(150)]
    far, heap = {}, [(0, 0)]
    while heap:
        d, v = heapq.heappop(heap)
        if v not in far:
            far[v] = d
            for a, b, w in arcs:
                if a == v:
                    heapq.heappush(heap, (d + w, b))
    stats = WorkStats()
    got = values(traversal.sssp(graph(spark, arcs, 60), source(spark), stats=stats), "dist")
    assert got == {v: far.get(v) for v in range(60)}
    assert stats.useful == len(far) and stats.rounds > 1


def test_small_symmetric_graph(h3, spark):
    assert triangles.striped(h3).first()[0] == 1
    for count in (triangles.successors, triangles.predecessors_of, triangles.middle, triangles.two_levels):
        assert count(h3).first()[0] == 1
    assert [tuple(r) for r in triangles.enumerate_triangles(h3).collect()] == [(0, 1, 2)]
    for find in (components.cc, components.cc_flood, components.cc_hook, components.cc_flood_then_hook):
        assert values(find(h3), "component") == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4}
    assert values(components.number_components(components.cc(h3)), "number") == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1}
    assert values(cores.kcore(h3), "core") == {0: 2, 1: 2, 2: 2, 3: 1, 4: 0}
    assert values(cores.kcore_min_degree(h3), "core") == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0}
    assert [k for k, v in sorted(values(independent.mis_fix(h3), "in_mis").items()) if v] == [0, 3, 4]
    assert values(independent.colouring(h3), "color") == {0: 0, 1: 1, 2: 2, 3: 0, 4: 0}
    for find in (independent.mis_luby_a, independent.mis_luby_b):
        assert not checks.check_mis(h3, find(h3)).collect()
    assert traversal.connected(h3, 0, 3) and not traversal.connected(h3, 0, 4)


def test_repeats_and_loops_do_not_matter(h3, spark):
    messy = Graph(h3.vertices, h3.edges.union(h3.edges).union(spark.createDataFrame([(1, 1, 9)], "src long, dst long, weight int")))
    clean = messy.preprocess()
    assert sorted(map(tuple, clean.edges.collect())) == sorted(map(tuple, h3.edges.collect()))
    assert triangles.striped(messy).first()[0] == 1
    assert values(cores.kcore(messy), "core") == values(cores.kcore(h3), "core")


def test_empty_edge_set(spark):
    g = graph(spark, [], 3)
    assert values(components.cc(g), "component") == {0: 0, 1: 1, 2: 2}
    assert values(traversal.bfs(g, source(spark)), "level") == {0: 0, 1: None, 2: None}
    assert triangles.striped(g).first()[0] == 0
    assert values(cores.kcore(g), "core") == {0: 0, 1: 0, 2: 0}
    assert all(values(independent.mis_fix(g), "in_mis").values())
    assert [round(r["rank"], 6) for r in ranks.pagerank(g, 3).collect()] == [0.15] * 3


def test_long_path_has_one_component(spark):
    n = 300
    g = graph(spark, [(i, i + 1) for i in range(n - 1)], n)
    assert set(values(components.cc(g), "component").values()) == {0}


def test_checks_find_faults(h3, spark):
    def ids(df):
        return sorted(r["id"] for r in df.collect())

    def frame(column, kind, values):
        return spark.createDataFrame(list(enumerate(values)), f"id long, {column} {kind}")

    one, s = source(spark), h3.vertices
    assert not ids(checks.check_bfs(h3, frame("level", "int", [0, 1, 1, 2, None]), one))
    assert ids(checks.check_bfs(h3, frame("level", "int", [None] * 5), one)) == [0]
    assert ids(checks.check_bfs(h3, frame("level", "int", [0] * 5), one)) == [1, 2, 3, 4]
    assert ids(checks.check_bfs(h3, frame("level", "int", [0, 1, 1]), one)) == [3, 4]  # missing
    assert ids(checks.check_sssp(h3, frame("dist", "long", [0, 1, 1, 3, None]), one)) == [3]
    assert ids(checks.check_sssp(h3, frame("dist", "long", [0, 1, 1, 1, None]), one)) == [3]
    assert ids(checks.check_cc(h3, frame("component", "long", [0] * 5))) == [4]
    assert ids(checks.check_cc(h3, frame("component", "long", range(5)))) == [1, 2, 3]
    assert not ids(checks.check_cc(h3, components.cc_flood(h3)))
    assert ids(checks.check_mis(h3, s.withColumn("in_mis", F.lit(True)))) == [0, 1, 2, 3]
    assert ids(checks.check_mis(h3, s.withColumn("in_mis", F.lit(False)))) == [0, 1, 2, 3, 4]
    assert ids(checks.check_mis(h3, frame("in_mis", "boolean", [True, False, False]))) == [3, 4]
    assert ids(checks.check_colouring(h3, s.withColumn("color", F.lit(0)))) == [1, 2, 3]
    assert ids(checks.check_colouring(h3, frame("color", "int", [0, 1, 2, 1, 0]))) == [3]
    assert not ids(checks.check_kcore(h3, frame("core", "long", [2, 2, 2, 1, 0])))
    assert ids(checks.check_kcore(h3, frame("core", "long", [3] * 5))) == [0, 1, 3, 4]  # vertex 2 does have three such neighbours
    assert ids(checks.check_kcore(h3, frame("core", "long", [0] * 5))) == [0, 1, 2, 3]
    assert ids(checks.check_kcore(h3, frame("core", "long", [0, 1, 1, 1, 0]))) == [0]
    assert ids(checks.check_kcore(h3, frame("core", "long", [2, 2, 2, 1]))) == []  # the left-out one is not claimed
    found = [(0, 1, 2), (0, 1, 2), (1, 2, 3)]
    assert sorted(map(tuple, checks.check_triangles(h3, spark.createDataFrame(found, "a long, b long, c long")).collect())) == [(0, 1, 2), (1, 2, 3)]
    assert checks.check_triangles(h3, spark.createDataFrame([], "a long, b long, c long")).count() == 1
    ranked = ranks.pagerank(h3, 80)
    assert not ids(checks.check_pagerank(h3, ranked, 1e-3))
    assert 2 in ids(checks.check_pagerank(h3, ranked.where("id <> 2"), 1e-3))


def test_algebra(h3, spark):
    two = spark.createDataFrame([(2,)], "id long")
    assert h3.remove_vertices(two).counts().first() == (4, 2)
    assert h3.restrict(two, complement=True).counts().first() == (4, 2)
    assert h3.filter(F.col("src") < F.col("dst")).edges.count() == 4
    assert values(h3.degree_ids(), "lid") == {4: 0, 3: 1, 0: 2, 1: 3, 2: 4}
    assert values(h3.horizontal_ids(2), "lid") == {0: 0, 1: 2, 2: 4, 3: 1, 4: 3}
    h3.verify_counts(5, 4, flipped=True)
    with pytest.raises(ValueError):
        h3.verify_counts(5, 5)


def test_bits_and_times(spark):
    row = spark.range(1).select(bits.reverse_bits(F.lit(6), 4).alias("r"), bits.high32(bits.pack32(F.lit(7), F.lit(9))).alias("h")).first()
    assert (row["r"], row["h"]) == (6, 7)
    assert spark.range(64).select(bits.scramble(F.col("id"), 6, 5).alias("s")).distinct().count() == 64
    t = summaries.time_statistics(spark.createDataFrame([(float(x),) for x in (5, 1, 4, 2, 3)], "x double"), "x").first()
    assert (t["mean"], t["min"], t["q1"], t["median"], t["q3"], t["max"]) == (3.0, 1.0, 2.0, 3.0, 4.0, 5.0)


def test_statistics_per_group_with_frequent_values(spark):
    rows = [("a", 1.0)] * 700 + [("a", 2.0)] * 200 + [("a", 9.0)] * 101 + [(None, 4.0), ("b", None), ("c", 7.0)]
    got = {r["k"]: r for r in summaries.time_statistics(spark.createDataFrame(rows, "k string, x double"), "x", "k").collect()}
    assert set(got) == {"a", None, "c"}
    ordered = sorted(x for k, x in rows if k == "a")
    n = len(ordered)
    assert (got["a"]["q1"], got["a"]["median"], got["a"]["q3"]) == (ordered[n // 4], ordered[n // 2], ordered[n // 4 + n // 2])
    assert (got[None]["median"], got["c"]["min"], got["c"]["max"]) == (4.0, 7.0, 7.0)
    assert not summaries.time_statistics(spark.createDataFrame([], "x double"), "x").collect()


def test_triangles_at_a_hub(spark):
    rim = 40
    g = graph(spark, [(0, i) for i in range(1, rim + 1)] + [(i, i % rim + 1) for i in range(1, rim + 1)], rim + 1).symmetrize()
    for count in (triangles.striped, triangles.successors, triangles.predecessors_of, triangles.middle, triangles.two_levels):
        assert count(g).first()[0] == rim


def test_sources_and_two_way_reach(spark):
    g = graph(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (4, 0)], 5)
    assert sorted(r[0] for r in traversal.two_way(g, source(spark)).collect()) == [0, 1, 2]
    drawn = [sorted(r[0] for r in traversal.random_sources(g, 2, seed=7).collect()) for _ in range(2)]
    assert drawn[0] == drawn[1] and len(drawn[0]) == 2 and 3 not in drawn[0]
    assert traversal.random_sources(g, 9).count() == 4


def test_messages_and_id_keys(h3, spark):
    got = {r["id"]: (r["min"], r["sum"]) for r in ranks.combine(h3.edges, h3.vertices.withColumn("value", F.col("id")), F.min, F.sum).collect()}
    assert got == {0: (1, 3), 1: (0, 2), 2: (0, 4), 3: (2, 2)}
    assert values(independent.mis_luby_ids(h3), "in_mis") == values(independent.mis_fix(h3), "in_mis")


def test_work_of_a_path_with_a_detour(spark):
    stats = WorkStats()
    g = graph(spark, [(0, 1, 9), (0, 2, 1), (2, 1, 1), (1, 3, 1)], 4)
    assert values(traversal.sssp(g, source(spark), stats=stats), "dist") == {0: 0, 1: 2, 2: 1, 3: 3}
    assert (stats.useful, stats.invalidated, stats.rejected, stats.edges) == (4, 2, 0, 5)
