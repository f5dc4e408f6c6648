"""Registered queries of the graph engine and their SQL.

The graphs come from whole relational tables: parts sold in one order at the same
discount (undirected, weighted by a formula of the ids), customers and suppliers that
trade (bipartite), and users that follow each other in the event stream (directed).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafonda.functions import bits, orderings
from grafonda.operators import checks, components, cores, independent, ranks, summaries, traversal, triangles
from grafonda.operators.graph import Graph, followers
from grafonda.plans.fixpoint import WorkStats
from grafonda.plans.scratch import cut, shared_dir
from grafonda.sources import generators, readers, writers
from grafonda.streaming.ingest import ComponentStream


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): parts of one order with the same discount, a < b."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_discount", "l_partkey")
    x, y = lines.withColumnRenamed("l_partkey", "a"), lines.withColumnRenamed("l_partkey", "b")
    return x.join(y, ["l_orderkey", "l_discount"]).where("a < b").select("a", "b").distinct()


def purchases(spark: SparkSession, sf_dir: str) -> Graph:
    weight = (1 + (F.col("a") * 31 + F.col("b") * 17) % 100).cast("int")
    arcs = pairs(spark, sf_dir).select(F.col("a").alias("src"), F.col("b").alias("dst"), weight.alias("weight"))
    graph = Graph.from_edges(arcs, table(spark, sf_dir, "part").select("p_partkey"), weight="weight").symmetrize()
    return Graph(graph.vertices, cut(graph.edges))


def transitions(spark: SparkSession, sf_dir: str) -> Graph:
    """Distinct arcs from a user to the next user in the stream, which is ordered by time and number."""
    found = followers(table(spark, sf_dir, "events"), "user_id", F.col("ts"), F.col("event_id"))
    return Graph.from_edges(found.select(F.col("user_id").alias("src"), F.col("next").alias("dst")).where("src <> dst").distinct())


def weighted_transitions(spark: SparkSession, sf_dir: str) -> Graph:
    arcs = transitions(spark, sf_dir).edges
    return Graph.from_edges(cut(arcs.withColumn("weight", (1 + F.pmod(F.col("src") * 3 + F.col("dst"), F.lit(5))).cast("int"))), weight="weight")


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, weight): supplier ids (from 1,000,000), customer ids, lines between them."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.groupBy((F.col("l_suppkey") + 1_000_000).alias("src"), F.col("o_custkey").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))


def first_source(graph: Graph) -> DataFrame:
    """The smallest vertex with an arc."""
    return graph.edges.agg(F.min("src").alias("id"))


PAIRS_SQL = """u AS (SELECT DISTINCT x.l_partkey AS a, y.l_partkey AS b FROM lineitem x JOIN lineitem y
  ON x.l_orderkey = y.l_orderkey AND x.l_discount = y.l_discount AND x.l_partkey < y.l_partkey)"""
GRAPH_SQL = f"""{PAIRS_SQL},
e AS (SELECT a AS src, b AS dst, (1 + (a * 31 + b * 17) % 100)::INT AS weight FROM u UNION ALL SELECT b, a, (1 + (a * 31 + b * 17) % 100)::INT FROM u),
v AS (SELECT p_partkey AS id FROM part)"""
TRANS_SQL = """t0 AS (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events),
e AS (SELECT DISTINCT src, dst FROM t0 WHERE dst IS NOT NULL AND src <> dst),
v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"""
WEIGHTED_SQL = TRANS_SQL.replace("e AS (SELECT DISTINCT src, dst FROM", "e AS (SELECT DISTINCT src, dst, (1 + (src * 3 + dst) % 5)::INT AS weight FROM")
TRADE_SQL = """e AS (SELECT l_suppkey + 1000000 AS src, o_custkey AS dst, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""
BFS_SQL = f"""WITH RECURSIVE {GRAPH_SQL},
r(id, level) AS (SELECT min(src), 0 FROM e UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON e.src = r.id WHERE r.level < 24),
best AS (SELECT id, min(level) AS level FROM r GROUP BY id)"""
SSSP_SQL = f"""WITH RECURSIVE {GRAPH_SQL},
r(id, dist) USING KEY (id) AS (
  SELECT min(src) AS id, 0::BIGINT AS dist FROM e
  UNION
  SELECT id, dist FROM (SELECT e.dst AS id, min(r.dist + e.weight) AS dist FROM r JOIN e ON e.src = r.id GROUP BY e.dst) c
  WHERE NOT EXISTS (SELECT 1 FROM recurring.r AS s WHERE s.id = c.id AND s.dist <= c.dist))"""
WEIGHTED_SSSP_SQL = SSSP_SQL.replace(GRAPH_SQL, WEIGHTED_SQL)
CC_SQL = f"""WITH RECURSIVE {GRAPH_SQL},
r(id, component) USING KEY (id) AS (
  SELECT id, id AS component FROM v
  UNION
  SELECT id, component FROM (SELECT e.dst AS id, min(r.component) AS component FROM r JOIN e ON e.src = r.id GROUP BY e.dst) c
  WHERE EXISTS (SELECT 1 FROM recurring.r AS s WHERE s.id = c.id AND s.component > c.component))"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, function: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = function
    if sql:
        ORACLE_SQL[name] = sql


def on_purchases(function: Callable[[Graph], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: function(purchases(spark, sf_dir))


def _drawn(graph: Graph, count: int) -> DataFrame:
    """Distances from drawn sources, summed up: the sources, those with an arc out, those at distance 0, the vertices, and those with a wrong distance."""
    sources = cut(traversal.random_sources(graph, count))
    found = cut(traversal.sssp(graph, sources))
    able = sources.join(graph.edges.select(F.col("src").alias("id")), "id", "left_semi")
    zero = found.where("dist = 0").join(sources, "id", "left_semi")
    figures = {"n_sources": sources, "n_able": able, "n_at_zero": zero, "n_vertices": found, "n_wrong": checks.check_sssp(graph, found, sources)}
    return graph.vertices.sparkSession.createDataFrame([tuple(x.count() for x in figures.values())], ", ".join(f"{k} long" for k in figures))


def _checked(check: Callable[[DataFrame], DataFrame], found: DataFrame, spoiled: DataFrame) -> DataFrame:
    """One row: rows of a result, those a check finds wrong, and those it finds wrong in a spoiled copy."""
    figures = {"n_rows": found, "n_wrong": check(found), "n_spoiled": check(spoiled)}
    return found.sparkSession.createDataFrame([tuple(x.count() for x in figures.values())], ", ".join(f"{k} long" for k in figures))


def with_graph(select: str) -> str:
    return f"WITH {GRAPH_SQL} {select}"


# -- triangles ------------------------------------------------------------------
_T = f"WITH {PAIRS_SQL} SELECT count(*) AS triangles FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b"
for _name, _count in (
    ("tc_striped", triangles.striped), ("tc_psp", triangles.predecessors_of), ("tc_sps", triangles.middle), ("tc_sss", triangles.successors), ("tc_level", triangles.two_levels),
):
    add(_name, on_purchases(_count), _T)
add("tc_enumerate", on_purchases(triangles.enumerate_triangles), f"WITH {PAIRS_SQL} SELECT x.a AS a, x.b AS b, y.b AS c FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b")
add(
    "tc_local_counts",
    on_purchases(triangles.local_counts),
    with_graph("""SELECT v.id, count(t.id) AS triangles FROM v LEFT JOIN (SELECT unnest([x.a, x.b, y.b]) AS id FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b) t
  ON t.id = v.id GROUP BY v.id"""),
)

# -- algebra --------------------------------------------------------------------
add("src_parquet", lambda s, d: readers.parquet(s, f"{d}/lineitem.parquet", "l_orderkey", "l_partkey"), "SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem")
add("g_build", on_purchases(lambda g: g.edges), with_graph("SELECT * FROM e"))
add("g_counts", on_purchases(lambda g: g.counts()), with_graph("SELECT (SELECT count(*) FROM v) AS n_vertices, (SELECT count(*) FROM e) AS n_edges"))
add("g_degrees", lambda s, d: transitions(s, d).degrees(), f"WITH {TRANS_SQL} SELECT id, (SELECT count(*) FROM e WHERE src = id) AS out_degree, (SELECT count(*) FROM e WHERE dst = id) AS in_degree FROM v")
add("g_out_degree", on_purchases(lambda g: g.out_degrees()), with_graph("SELECT id, count(src) AS out_degree FROM v LEFT JOIN e ON src = id GROUP BY id"))
add("g_in_degree", on_purchases(lambda g: g.in_degrees()), with_graph("SELECT id, count(dst) AS in_degree FROM v LEFT JOIN e ON dst = id GROUP BY id"))
add("g_reverse", lambda s, d: transitions(s, d).reverse().edges, f"WITH {TRANS_SQL} SELECT dst AS src, src AS dst FROM e")
add("g_symmetrize", lambda s, d: transitions(s, d).symmetrize().preprocess().edges, f"WITH {TRANS_SQL} SELECT src, dst FROM e UNION SELECT dst, src FROM e")
add(
    "g_preprocess",
    lambda s, d: Graph.from_edges(readers.parquet(s, f"{d}/lineitem.parquet", "l_partkey", "l_suppkey")).preprocess().edges,
    "SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey <> l_suppkey",
)
add("g_out_edges", on_purchases(lambda g: g.out_edges(g.vertices.where("id % 10 = 3"))), with_graph("SELECT src, dst, weight FROM e WHERE src % 10 = 3"))
add("g_adjacent", on_purchases(lambda g: g.adjacent().select("id", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))),
    with_graph("SELECT src AS id, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS neighbours FROM (SELECT DISTINCT src, dst FROM e) GROUP BY src"))
add(
    "g_edge_lookup",
    on_purchases(lambda g: g.has_edges(g.vertices.select(F.col("id").alias("src"), (F.col("id") * 7 % 1000 + 1).alias("dst")))),
    with_graph("SELECT p.src, p.dst, count(e.src) AS n_arcs FROM (SELECT id AS src, id * 7 % 1000 + 1 AS dst FROM v) p LEFT JOIN e ON e.src = p.src AND e.dst = p.dst GROUP BY 1, 2"),
)
add("g_filter", on_purchases(lambda g: g.filter(F.col("weight") > 50, F.col("id") % 3 != 0).edges), with_graph("SELECT src, dst, weight FROM e WHERE weight > 50 AND src % 3 <> 0 AND dst % 3 <> 0"))
add("g_filter_subset", on_purchases(lambda g: g.restrict(g.vertices.where("id < 500")).counts()), with_graph("SELECT (SELECT count(*) FROM v WHERE id < 500) AS n_vertices, (SELECT count(*) FROM e WHERE src < 500 AND dst < 500) AS n_edges"))
add("g_filter_complement", on_purchases(lambda g: g.restrict(g.vertices.where("id < 500"), complement=True).counts()), with_graph("SELECT (SELECT count(*) FROM v WHERE id >= 500) AS n_vertices, (SELECT count(*) FROM e WHERE src >= 500 AND dst >= 500) AS n_edges"))
add("g_local_subgraph", on_purchases(lambda g: g.local_subgraph(lambda x: F.pmod(x, F.lit(4))).edges), with_graph("SELECT src, dst, weight FROM e WHERE src % 4 = dst % 4"))
add("g_remove_vertices", on_purchases(lambda g: g.remove_vertices(g.vertices.where("id % 5 = 0")).edges), with_graph("SELECT src, dst, weight FROM e WHERE src % 5 <> 0 AND dst % 5 <> 0"))
add("g_remove_edge_if", on_purchases(lambda g: g.remove_edge_if(F.col("weight") % 2 == 0).edges), with_graph("SELECT src, dst, weight FROM e WHERE weight % 2 <> 0"))
add("g_clear_out_edges", on_purchases(lambda g: g.clear_vertices(g.vertices.where("id % 5 = 0"), into=False).edges), with_graph("SELECT src, dst, weight FROM e WHERE src % 5 <> 0"))
add("g_add_edges", on_purchases(lambda g: g.add_edges(g.vertices.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1).alias("weight"))).counts()),
    with_graph("SELECT (SELECT count(*) FROM (SELECT id FROM v UNION SELECT id + 1 FROM v)) AS n_vertices, (SELECT count(*) FROM e) + (SELECT count(*) FROM v) AS n_edges"))
add("g_add_vertices", on_purchases(lambda g: g.add_vertices(g.vertices.select(F.col("id") + 1)).counts()), with_graph("SELECT (SELECT count(*) FROM (SELECT id FROM v UNION SELECT id + 1 FROM v)) AS n_vertices, (SELECT count(*) FROM e) AS n_edges"))
add("g_remove_edges", on_purchases(lambda g: g.remove_edges(g.edges.where("weight % 7 = 0")).edges), with_graph("SELECT src, dst, weight FROM e WHERE (src, dst) NOT IN (SELECT (src, dst) FROM e WHERE weight % 7 = 0)"))
add("g_clear_vertices", on_purchases(lambda g: g.clear_vertices(g.vertices.where("id % 5 = 0")).counts()), with_graph("SELECT (SELECT count(*) FROM v) AS n_vertices, (SELECT count(*) FROM e WHERE src % 5 <> 0 AND dst % 5 <> 0) AS n_edges"))
add("g_property_filter", on_purchases(lambda g: g.restrict(g.out_degrees().where("out_degree >= 8").select("id")).edges), "WITH " + GRAPH_SQL + (", h AS (SELECT src AS id FROM e GROUP BY src HAVING count(*) >= 8) SELECT src, dst, weight FROM e WHERE src IN (SELECT id FROM h) AND dst IN (SELECT id FROM h)"))
add("g_index", on_purchases(lambda g: g.index()), with_graph("SELECT id, row_number() OVER (ORDER BY id) - 1 AS lid FROM v"))
add("id_vertical", on_purchases(lambda g: g.vertical_ids()), with_graph("SELECT id, id AS lid FROM v"))
add("id_horizontal", on_purchases(lambda g: g.horizontal_ids(4)), with_graph("SELECT id, (id % b) * 4 + id // b AS lid FROM v, (SELECT ceil((max(id) + 1) / 4)::BIGINT AS b FROM v)"))
add("id_degree", on_purchases(lambda g: g.degree_ids()), with_graph("SELECT id, row_number() OVER (ORDER BY n, id) - 1 AS lid FROM (SELECT id, count(src) AS n FROM v LEFT JOIN e ON src = id GROUP BY id)"))
add("id_shuffle", on_purchases(lambda g: g.renumber(g.vertices.select("id", (F.col("id") * 3 + 1).alias("lid"))).edges), with_graph("SELECT src * 3 + 1 AS src, dst * 3 + 1 AS dst, weight FROM e"))
add("redistribute", lambda s, d: (g := transitions(s, d)).redistribute(g.vertices.select("id", (-F.col("id")).alias("lid")), flip=True).edges, f"WITH {TRANS_SQL} SELECT -src AS src, -dst AS dst FROM e UNION ALL SELECT -dst, -src FROM e")

# -- traversal ------------------------------------------------------------------
_BFS = f"{BFS_SQL} SELECT v.id, best.level::INT AS level FROM v LEFT JOIN best ON best.id = v.id"
for _name, _order in (
    ("bfs_chaotic", orderings.chaotic()), ("bfs_level", orderings.level()), ("bfs_klevel", orderings.klevel(3)),
    ("bfs_node_level", orderings.named("node_level")), ("bfs_numa_level", orderings.named("numa_level")), ("bfs_async", orderings.named("thread_chaotic")),
):
    add(_name, on_purchases(lambda g, o=_order: traversal.bfs(g, first_source(g), o)), _BFS)
add("bfs_max_level", on_purchases(lambda g: traversal.bfs(g, first_source(g), max_level=3)), f"{BFS_SQL} SELECT v.id, (CASE WHEN best.level <= 3 THEN best.level END)::INT AS level FROM v LEFT JOIN best ON best.id = v.id")
add("bfs_predecessors", on_purchases(lambda g: traversal.predecessors(g, cut(traversal.bfs(g, first_source(g))))),
    f"""{BFS_SQL} SELECT v.id, best.level::INT AS level, (SELECT min(e.src) FROM e JOIN best p ON p.id = e.src WHERE e.dst = v.id AND p.level = best.level - 1) AS parent
FROM v LEFT JOIN best ON best.id = v.id""")  # fmt: skip
add("reach", on_purchases(lambda g: traversal.reach(g, first_source(g))), f"{BFS_SQL} SELECT id FROM best")
_SSSP = f"{SSSP_SQL} SELECT v.id, r.dist FROM v LEFT JOIN r ON r.id = v.id"
add("sssp_chaotic", on_purchases(lambda g: traversal.sssp(g, first_source(g))), _SSSP)
add("sssp_delta", on_purchases(lambda g: traversal.sssp_delta(g, first_source(g), 60)), _SSSP)
add("sssp_delta_buckets", on_purchases(lambda g: traversal.sssp_buckets(g, first_source(g), 80)), _SSSP)
_WEIGHTED = f"{WEIGHTED_SSSP_SQL} SELECT v.id, r.dist FROM v LEFT JOIN r ON r.id = v.id"
add("sssp_dijkstra", lambda s, d: (g := weighted_transitions(s, d), traversal.sssp_dijkstra(g, first_source(g)))[1], _WEIGHTED)
add("ord_vertex_delta", lambda s, d: (g := weighted_transitions(s, d), traversal.sssp(g, first_source(g), orderings.vertex_delta(500)))[1], _WEIGHTED)
add("sssp_kla", on_purchases(lambda g: traversal.sssp_kla(g, first_source(g), 4)), _SSSP)
add("sssp_eager", on_purchases(lambda g: traversal.sssp_eager(g, first_source(g), 80)), _SSSP)
add("sssp_dc", on_purchases(lambda g: traversal.sssp(g, first_source(g), orderings.named("thread_chaotic"))), _SSSP)
add("sssp_visited_edges", on_purchases(lambda g: summaries.visited_edges(g.edges, cut(traversal.sssp(g, first_source(g))), "dist")), f"{SSSP_SQL} SELECT count(*) AS n_edges FROM e JOIN r ON r.id = e.src")
add("sssp_random_sources", on_purchases(lambda g: _drawn(g, 3)), with_graph("SELECT 3::BIGINT AS n_sources, 3::BIGINT AS n_able, 3::BIGINT AS n_at_zero, count(*) AS n_vertices, 0::BIGINT AS n_wrong FROM v"))
add("bfs_visited_color", on_purchases(lambda g: traversal.bfs(g, first_source(g)).select("id", F.col("level").isNotNull().alias("visited"))), f"{BFS_SQL} SELECT v.id, best.id IS NOT NULL AS visited FROM v LEFT JOIN best ON best.id = v.id")
add(
    "scc_of_source",
    lambda s, d: (g := Graph.from_edges(cut(transitions(s, d).edges)), traversal.two_way(g, first_source(g)))[1],
    f"""WITH RECURSIVE {TRANS_SQL},
f(id) AS (SELECT min(src) FROM e UNION SELECT e.dst FROM f JOIN e ON e.src = f.id), b(id) AS (SELECT min(src) FROM e UNION SELECT e.src FROM b JOIN e ON e.dst = b.id)
SELECT f.id FROM f JOIN b ON b.id = f.id""",
)
add("sssp_visited_count", on_purchases(lambda g: summaries.visited(traversal.sssp(g, first_source(g)), "dist")), f"{SSSP_SQL} SELECT count(*) AS n_visited FROM r")


def _work(graph: Graph) -> DataFrame:
    stats = WorkStats()
    traversal.bfs(graph, first_source(graph), orderings.level(), stats=stats)
    return graph.vertices.sparkSession.createDataFrame([(stats.useful, stats.invalidated, stats.edges)], "useful long, invalidated long, edges long")


add("work_stats", on_purchases(_work), f"{BFS_SQL} SELECT (SELECT count(*) FROM best) AS useful, 0::BIGINT AS invalidated, (SELECT count(*) FROM e JOIN best ON id = src) AS edges")

# -- components -----------------------------------------------------------------
_CC = f"{CC_SQL} SELECT id, component FROM r"
add("cc", on_purchases(components.cc), _CC)
add("cc_chaotic", on_purchases(components.cc_flood), _CC)
add("cc_delta", on_purchases(lambda g: components.cc_flood(g, orderings.delta(500))), _CC)
add("cc_level", on_purchases(lambda g: components.cc_flood(g, orderings.level())), _CC)
add("cc_level_thread_dj", on_purchases(lambda g: components.cc_flood(g, orderings.named("thread_level"))), _CC)
add("cc_priority", on_purchases(lambda g: components.cc_flood(g, orderings.named("thread_chaotic"))), _CC)
add("cc_sv", on_purchases(components.cc_hook), _CC)
add("cc_ps_sv", on_purchases(components.cc_flood_then_hook), _CC)
add("cc_number_components", on_purchases(lambda g: components.number_components(cut(components.cc(g)))), f"{CC_SQL} SELECT id, dense_rank() OVER (ORDER BY component) - 1 AS number FROM r")
add("cc_stats", on_purchases(lambda g: components.component_sizes(cut(components.cc(g)), None)), f"{CC_SQL} SELECT component, count(*) AS size, round(100 * count(*) / (SELECT count(*) FROM v), 6) AS percent FROM r GROUP BY component")

# -- sets, colours, cores -------------------------------------------------------
_ROUNDS = 40


def _decided(first: str, column: str, rule: str) -> str:
    """Rounds of a decision over smaller neighbours, as chained tables."""
    steps = [f"s0 AS MATERIALIZED (SELECT id, {first} AS {column} FROM v)"]
    for i in range(1, _ROUNDS):
        steps.append(f"s{i} AS MATERIALIZED (SELECT s.id, CASE WHEN s.{column} IS NOT NULL THEN s.{column} ELSE {rule} END AS {column} FROM s{i - 1} s LEFT JOIN (SELECT l.b AS id, list(n.{column}) AS seen FROM u l JOIN s{i - 1} n ON n.id = l.a GROUP BY l.b) m ON m.id = s.id)")
    return f"WITH {GRAPH_SQL}, " + ",\n".join(steps) + f" SELECT id, {column} FROM s{_ROUNDS - 1}"


_MIS = _decided("NULL::BOOLEAN", "in_mis", "CASE WHEN seen IS NULL THEN true WHEN list_contains(seen, true) THEN false WHEN list_count(seen) < len(seen) THEN NULL ELSE true END")
add("mis_fix", on_purchases(independent.mis_fix), _MIS)
add("mis_luby_av1", on_purchases(independent.mis_luby_ids), _MIS)
_LUBY = with_graph("SELECT count(*) AS n_rows, 0::BIGINT AS n_wrong, count(*) AS n_spoiled FROM v")


def _luby_checked(find: Callable[[Graph], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The set is checked against its definition; the spoiled copy leaves every vertex out, so each one is wrong."""
    return on_purchases(lambda g: (m := cut(find(g)), _checked(lambda df: checks.check_mis(g, df), m, m.withColumn("in_mis", F.lit(False))))[1])


add("mis_luby_av2", _luby_checked(lambda g: independent.mis_luby_a(g, seed=2)), _LUBY)
add("gc_jp", on_purchases(independent.colouring), _decided("NULL::INT", "color", "CASE WHEN seen IS NULL THEN 0 WHEN list_count(seen) < len(seen) THEN NULL ELSE list_min(list_filter(range(0, len(seen) + 1), lambda c: NOT list_contains(seen, c::INT)))::INT END"))
add("mis_luby_a", _luby_checked(independent.mis_luby_a), _LUBY)
add("mis_luby_b", _luby_checked(independent.mis_luby_b), _LUBY)


def _core_sql() -> str:
    steps = ["s0 AS MATERIALIZED (SELECT v.id, count(src) AS core FROM v LEFT JOIN e ON src = v.id GROUP BY v.id)"]
    for i in range(1, _ROUNDS):
        steps.append(
            f"s{i} AS MATERIALIZED (SELECT v.id, coalesce(h, 0) AS core FROM v LEFT JOIN (SELECT src, max(least(core, k)) AS h FROM (SELECT e.src, s.core, row_number() OVER (PARTITION BY e.src ORDER BY s.core DESC) AS k FROM e JOIN s{i - 1} s ON s.id = e.dst) GROUP BY src) ON src = v.id)"
        )
    return f"WITH {GRAPH_SQL}, " + ",\n".join(steps) + f" SELECT id, core FROM s{_ROUNDS - 1}"


add("kcore", on_purchases(cores.kcore), _core_sql())
add("kcore_min_degree", on_purchases(cores.kcore_min_degree), f"{CC_SQL}, d AS (SELECT v.id, count(src) AS n FROM v LEFT JOIN e ON src = v.id GROUP BY v.id) SELECT r.id, min(n) OVER (PARTITION BY component) AS core FROM r JOIN d ON d.id = r.id")

# -- ranks ----------------------------------------------------------------------


def _rank_sql(rounds: int) -> str:
    steps = ["o AS (SELECT src, count(*) AS n FROM e GROUP BY src)", "r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS rank FROM v)"]
    for i in range(1, rounds + 1):
        steps.append(f"r{i} AS MATERIALIZED (SELECT v.id, 0.15::DOUBLE + 0.85::DOUBLE * coalesce(g, 0) AS rank FROM v LEFT JOIN (SELECT e.dst, sum(r.rank / o.n) AS g FROM e JOIN o ON o.src = e.src JOIN r{i - 1} r ON r.id = e.src GROUP BY e.dst) ON dst = v.id)")
    return ", ".join(steps)


def _rounded(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.round(column, 6))


add("pr_sync", on_purchases(lambda g: _rounded(ranks.pagerank(g, 20), "rank")), f"WITH {GRAPH_SQL}, {_rank_sql(20)} SELECT id, round(rank, 6) AS rank FROM r20")
add("pr_directed", lambda s, d: _rounded(ranks.pagerank(transitions(s, d), 10), "rank"), f"WITH {TRANS_SQL}, {_rank_sql(10)} SELECT id, round(rank, 6) AS rank FROM r10")
add("pr_until", on_purchases(lambda g: ranks.pagerank_until(g, 1e-4)))
add("spmv", lambda s, d: ranks.spmv(trade(s, d), table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("value"))),
    f"WITH {TRADE_SQL} SELECT src AS id, sum(weight * c_nationkey)::BIGINT AS value FROM e JOIN customer ON c_custkey = dst GROUP BY src")

# -- messages along arcs: combined before the shuffle -----------------------------
add("red_duplicate_removal", lambda s, d: table(s, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct(), "SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem")
add("red_combination", on_purchases(lambda g: ranks.combine(g.edges, g.vertices.select("id", F.col("id").alias("value")), F.min, F.max, F.sum)),
    with_graph("SELECT dst AS id, min(src)::BIGINT AS min, max(src)::BIGINT AS max, sum(src)::BIGINT AS sum FROM e GROUP BY dst"))

# -- checks of results: of a right one and of a spoiled copy, whose faults SQL counts by their own definition ----------


def _spoil(column: str, by: str) -> Callable[[DataFrame], DataFrame]:
    """Another value at every seventh vertex, and every eleventh left out."""
    return lambda df: df.where("id % 11 <> 5").withColumn(column, F.when(F.col("id") % 7 == 3, F.expr(by)).otherwise(F.col(column)))


def _vf(find: Callable[[Graph], DataFrame], check: Callable[[Graph, DataFrame], DataFrame], spoil: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(graph: Graph) -> DataFrame:
        found = cut(find(graph))
        return _checked(lambda df: check(graph, df), found, cut(spoil(found)))

    return on_purchases(run)


def _vf_sql(head: str, result: str, column: str, by: str, wrong: str) -> str:
    """`wrong` selects from s(id, x), the spoiled result, and v; result gives r0(id, x)."""
    spoiled = f"s AS MATERIALIZED (SELECT id, CASE WHEN id % 7 = 3 THEN {by} ELSE {column} END AS x FROM r0 WHERE id % 11 <> 5)"
    return f"{head}, r0 AS MATERIALIZED ({result}), {spoiled} SELECT (SELECT count(*) FROM r0) AS n_rows, 0::BIGINT AS n_wrong, (SELECT count(*) FROM ({wrong})) AS n_spoiled"


def _least_sql(step: str) -> str:
    return f"""SELECT v.id FROM v LEFT JOIN s ON s.id = v.id LEFT JOIN (SELECT e.dst, min(s.x + {step}) AS best FROM e JOIN s ON s.id = e.src GROUP BY e.dst) b ON b.dst = v.id
WHERE s.id IS NULL OR s.x IS DISTINCT FROM CASE WHEN v.id = (SELECT min(src) FROM e) THEN 0 ELSE best END"""


_NEAR = "JOIN s p ON p.id = e.src JOIN s q ON q.id = e.dst WHERE e.src <> e.dst"
add("vf_bfs", _vf(lambda g: traversal.bfs(g, first_source(g)), lambda g, df: checks.check_bfs(g, df, first_source(g)), _spoil("level", "level + 1")),
    _vf_sql(BFS_SQL, "SELECT v.id, best.level FROM v LEFT JOIN best ON best.id = v.id", "level", "level + 1", _least_sql("1")))
add("vf_sssp", _vf(lambda g: traversal.sssp(g, first_source(g)), lambda g, df: checks.check_sssp(g, df, first_source(g)), _spoil("dist", "dist - 1")),
    _vf_sql(SSSP_SQL, "SELECT v.id, r.dist FROM v LEFT JOIN r ON r.id = v.id", "dist", "dist - 1", _least_sql("e.weight")))
add("vf_cc", _vf(components.cc_flood, checks.check_cc, _spoil("component", "id")),
    _vf_sql(CC_SQL, "SELECT id, component FROM r", "component", "id", "SELECT r0.id FROM r0 LEFT JOIN s ON s.id = r0.id WHERE s.x IS DISTINCT FROM r0.component"))
add("vf_mis", _vf(independent.mis_fix, checks.check_mis, _spoil("in_mis", "not in_mis")),
    _vf_sql(_MIS.rsplit(" SELECT ", 1)[0], "SELECT id, in_mis FROM s39", "in_mis", "NOT in_mis", f"""SELECT e.src AS id FROM e {_NEAR} AND p.x AND q.x
UNION SELECT id FROM s WHERE NOT x AND id NOT IN (SELECT e.src FROM e JOIN s q ON q.id = e.dst WHERE e.src <> e.dst AND q.x) UNION SELECT id FROM v WHERE id NOT IN (SELECT id FROM s)"""))  # fmt: skip
add("vf_gc", _vf(independent.colouring, checks.check_colouring, _spoil("color", "color + 1")),
    _vf_sql(ORACLE_SQL["gc_jp"].rsplit(" SELECT ", 1)[0], "SELECT id, color FROM s39", "color", "color + 1", """SELECT v.id FROM v LEFT JOIN s ON s.id = v.id
LEFT JOIN (SELECT l.b AS id, list(q.x) AS seen FROM u l JOIN s q ON q.id = l.a GROUP BY l.b) m ON m.id = v.id
WHERE s.id IS NULL OR s.x <> coalesce(list_min(list_filter(range(0, len(seen) + 1), lambda c: NOT list_contains(seen, c::INT))), 0)"""))  # fmt: skip
add("vf_tc", on_purchases(lambda g: (t := cut(triangles.enumerate_triangles(g)), _checked(lambda df: checks.check_triangles(g, df), t, t.where("a % 7 <> 3").union(t.where("a % 7 = 4")).union(t.where("a % 7 = 5").select("a", "b", F.col("b").alias("c")))))[1]),
    f"WITH {PAIRS_SQL}, t AS (SELECT x.a AS a, x.b AS b, y.b AS c FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b) SELECT count(*) AS n_rows, 0::BIGINT AS n_wrong, count(*) FILTER (a % 7 IN (3, 4)) + (SELECT count(*) FROM (SELECT DISTINCT a, b FROM t WHERE a % 7 = 5)) AS n_spoiled FROM t")
add("vf_pr", on_purchases(lambda g: (r := cut(ranks.pagerank(g, 60)), _checked(lambda df: checks.check_pagerank(g, df, 1e-3), r, r.where("id % 11 <> 5").select("id", (F.col("rank") + F.when(F.col("id") % 7 == 3, 1000.0).otherwise(0.0)).alias("rank"))))[1]),
    f"""WITH {GRAPH_SQL}, {_rank_sql(60)}, s AS MATERIALIZED (SELECT id, rank + CASE WHEN id % 7 = 3 THEN 1000.0::DOUBLE ELSE 0 END AS x FROM r60 WHERE id % 11 <> 5)
SELECT (SELECT count(*) FROM r60) AS n_rows, 0::BIGINT AS n_wrong, (SELECT count(*) FROM v LEFT JOIN s ON s.id = v.id LEFT JOIN (SELECT e.dst, sum(s.x / o.n) AS g FROM e JOIN o ON o.src = e.src JOIN s ON s.id = e.src GROUP BY e.dst) h ON h.dst = v.id
WHERE s.id IS NULL OR abs(s.x - (0.15::DOUBLE + 0.85::DOUBLE * coalesce(g, 0))) > 1e-3) AS n_spoiled""")  # fmt: skip
add("vf_kcore", _vf(cores.kcore, checks.check_kcore, lambda df: df.withColumn("core", F.lit(0).cast("bigint"))), with_graph("SELECT (SELECT count(*) FROM v) AS n_rows, 0::BIGINT AS n_wrong, (SELECT count(DISTINCT src) FROM e) AS n_spoiled"))

# -- functions and summaries ------------------------------------------------------
add("fn_pack32", lambda s, d: trade(s, d).select("src", "dst", bits.high32(bits.pack32(F.col("src"), F.col("dst"))).alias("high"), bits.low32(bits.pack32(F.col("src"), F.col("dst"))).alias("low")),
    f"WITH {TRADE_SQL} SELECT src, dst, src AS high, dst AS low FROM e")
add("bucket_classes", on_purchases(lambda g: g.edges.select(F.floor(F.col("weight") / 10).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))), with_graph("SELECT (weight // 10)::BIGINT AS bucket, count(*) AS n FROM e GROUP BY 1"))
add("time_statistics", lambda s, d: _rounded(_rounded(summaries.time_statistics(table(s, d, "events"), "value", "event_type"), "mean"), "sd"),
    """WITH r AS (SELECT event_type, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd, min(x) AS min, max(x) FILTER (i = n // 4) AS q1, max(x) FILTER (i = n // 2) AS median, max(x) FILTER (i = n // 2 + n // 4) AS q3, max(x) AS max FROM r GROUP BY event_type""")  # fmt: skip


# -- text formats, generators, streams --------------------------------------------
def _text(spark: SparkSession, lines: DataFrame) -> str:
    import uuid

    path = f"{shared_dir(spark)}/grafonda-{spark.sparkContext.applicationId}/text-{uuid.uuid4().hex}"
    lines.write.text(path)
    return path


def _edge_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws(" ", (F.col("a") + 1).cast("string"), (F.col("b") + 1).cast("string"))
    return readers.edge_list(spark, _text(spark, pairs(spark, sf_dir).select(line)), flip=True)


def _weighted_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = purchases(spark, sf_dir).edges
    return readers.weighted_edge_list(spark, _text(spark, e.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in e.columns]))))


def _matrix_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs under a header that gives the largest id, as coordinate entries."""
    found = cut(pairs(spark, sf_dir))
    line = F.concat_ws(" ", (F.col("a") + 1).cast("string"), (F.col("b") + 1).cast("string")).alias("value")
    top = found.agg(F.concat_ws(" ", F.max("b") + 1, F.max("b") + 1, F.count(F.lit(1))).alias("value"))
    path = _text(spark, _ordered(top, found.select(line)))
    n, m = readers.matrix_market_header(spark, path)
    edges = readers.matrix_market(spark, path)
    return edges.withColumns({"n": F.lit(n).cast("bigint"), "m": F.lit(m).cast("bigint")})


def _ordered(top: DataFrame, lines: DataFrame) -> DataFrame:
    """A file's header line before its lines: one partition, as a format with a header asks for."""
    both = top.withColumn("at", F.lit(0)).union(lines.withColumn("at", F.lit(1)))
    return both.repartition(1).sortWithinPartitions("at", "value").select("value")


def _snap_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(pairs(spark, sf_dir))
    top = found.agg(F.format_string("# Nodes: %d Edges: %d", F.max("b") + 1, F.count(F.lit(1))).alias("value"))
    path = _text(spark, _ordered(top, found.select(F.concat_ws("\t", "a", "b").alias("value"))))
    n, m = readers.snap_header(spark, path)
    return readers.snap(spark, path).withColumns({"n": F.lit(n).cast("bigint"), "m": F.lit(m).cast("bigint")})


def _dimacs_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = purchases(spark, sf_dir).edges
    top = e.agg(F.format_string("p sp %d %d", F.max("src") + 1, F.count(F.lit(1))).alias("value"))
    lines = e.select(F.concat_ws(" ", F.lit("a"), F.col("src") + 1, F.col("dst") + 1, F.col("weight")).alias("value"))
    return readers.dimacs(spark, _text(spark, _ordered(top, lines))).edges


def _metis_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, which are numbered from 0 without gaps, are the lines of the file."""
    g = purchases(spark, sf_dir)
    cells = g.edges.groupBy(F.col("src").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("dst", "weight"))), lambda x: F.concat_ws(" ", x["dst"] + 1, x["weight"])), " ").alias("value"))
    lines = g.vertices.join(cells, "id", "left").select("id", F.coalesce("value", F.lit("")).alias("value"))
    top = g.counts().select(F.lit(-1).cast("bigint").alias("id"), F.concat_ws(" ", "n_vertices", "n_edges", F.lit("1")).alias("value"))
    path = _text(spark, top.union(lines).repartition(1).sortWithinPartitions("id").select("value"))
    return readers.metis(spark, path).edges


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws(" ", F.col("a") + 1, F.col("b") + 1).alias("value")
    both = pairs(spark, sf_dir).select(line)
    return readers.segmented(spark, _text(spark, both.union(both).repartition(4)), "part", preprocess=True)


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the symmetric graph, checked against those of the one-way arcs; a difference raises."""
    g = purchases(spark, sf_dir)
    n, m = g.counts().first()
    Graph(g.vertices, g.edges.where("src < dst")).symmetrize().verify_counts(n, m // 2, flipped=True)
    return g.counts()


def _degree_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/grafonda-{spark.sparkContext.applicationId}/degrees-{uuid.uuid4().hex}"
    writers.write_degrees(purchases(spark, sf_dir), path)
    return spark.read.option("sep", "\t").schema("id long, out_degree long").csv(path)


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    top = f"{shared_dir(spark)}/grafonda-{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    arcs = pairs(spark, sf_dir).toDF("src", "dst").repartition(3)
    arcs.write.parquet(f"{top}/in")
    stream = spark.readStream.schema("src long, dst long").option("maxFilesPerTrigger", 2).parquet(f"{top}/in")
    keeper = ComponentStream(spark, f"{top}/forest")
    keeper.start(stream, f"{top}/checkpoint").awaitTermination()
    return keeper.forest()


add("src_edge_list", _edge_file, with_graph("SELECT src, dst FROM e"))
add("src_weighted", _weighted_file, with_graph("SELECT src, dst, weight FROM e"))
_HEAD = "(SELECT max(b) + 1 FROM u)::BIGINT AS n, (SELECT count(*) FROM u) AS m"
add("src_mmio", _matrix_file, f"WITH {PAIRS_SQL} SELECT a AS src, b AS dst, {_HEAD} FROM u")
add("src_snap_header", _snap_file, f"WITH {PAIRS_SQL} SELECT a AS src, b AS dst, {_HEAD} FROM u")
add("src_dimacs", _dimacs_file, with_graph("SELECT src, dst, weight FROM e"))
add("src_metis", _metis_file, with_graph("SELECT src, dst, weight FROM e"))
add("src_segmented", _segments, f"WITH {PAIRS_SQL} SELECT a AS src, b AS dst FROM u")
add("graph_verify_load", _verified, ORACLE_SQL["g_counts"])
add("snk_degree_file", _degree_file, ORACLE_SQL["g_out_degree"])
add("stream_components", _streamed, f"{CC_SQL} SELECT id, component FROM r WHERE id IN (SELECT src FROM e)")
add("snk_graphviz", on_purchases(lambda g: writers.graphviz_lines(g).select("line")),
    with_graph("""SELECT 'digraph G {' AS line UNION ALL SELECT '}' UNION ALL SELECT id::VARCHAR || ';' FROM v UNION ALL SELECT src || ' -> ' || dst || ' [label="' || weight || '"];' FROM e"""))
add("gen_mesh", lambda s, d: generators.mesh(s, 40, 30).edges, """WITH c AS (SELECT i, j FROM range(40) a(i), range(30) b(j)), n AS (SELECT i, j, i + x AS k, j + y AS l FROM c, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) m(x, y))
SELECT j * 40 + i AS src, l * 40 + k AS dst FROM n WHERE k BETWEEN 0 AND 39 AND l BETWEEN 0 AND 29""")


def _profile(edges: DataFrame, size: int) -> DataFrame:
    """One row about generated arcs that their definition fixes: number, ends out of range, self-loops, repeats."""
    once = edges.select("src", "dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("src") < 0) | (F.col("dst") < 0) | (F.col("src") >= size) | (F.col("dst") >= size)).alias("out"))
    return once.agg(F.sum("n").alias("n_arcs"), F.sum("out").alias("n_outside"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("n")).otherwise(0)).alias("n_loops"), F.sum(F.col("n") - 1).alias("n_repeats"))


def _add_generator(name: str, make: Callable[[SparkSession], DataFrame], size: int, fixed: dict[str, int]) -> None:
    """The arcs, and under name_profile those of their figures that are fixed, with SQL."""
    add(name, lambda s, d: make(s))
    add(f"{name}_profile", lambda s, d: _profile(make(s), size).select(*[F.col(k).cast("bigint").alias(k) for k in fixed]), "SELECT " + ", ".join(f"{v}::BIGINT AS {k}" for k, v in fixed.items()))


_add_generator("gen_kronecker", lambda s: generators.kronecker(s, 10), 1024, {"n_arcs": 16384, "n_outside": 0})
_add_generator("gen_rmat1", lambda s: generators.rmat(s, 10, abc=generators.RMAT1), 1024, {"n_arcs": 16384, "n_outside": 0})
_add_generator("gen_rmat2", lambda s: generators.rmat(s, 10, abc=generators.RMAT2), 1024, {"n_arcs": 16384, "n_outside": 0})
_add_generator("gen_rmat_rec", lambda s: generators.rmat_lower(s, 10), 1024, {"n_outside": 0, "n_loops": 0})
_add_generator("gen_rmat_unique", lambda s: generators.rmat_unique(s, 10, 4000), 1024, {"n_arcs": 4000, "n_outside": 0, "n_repeats": 0})
_add_generator("gen_er", lambda s: generators.erdos_renyi(s, 1000, 0.01).edges, 1000, {"n_outside": 0, "n_loops": 0, "n_repeats": 0})
_add_generator("gen_small_world", lambda s: generators.small_world(s, 1000, 4, 0.05).edges, 1000, {"n_arcs": 4000, "n_outside": 0})
add("gen_weights", on_purchases(lambda g: readers.with_weights(g.edges.drop("weight"))))
add("gen_weights_profile", on_purchases(lambda g: readers.with_weights(g.edges.drop("weight")).agg(F.count(F.lit(1)).alias("n"), F.min("weight").alias("lo"), F.count_if(F.col("weight") > 255).alias("over"))), with_graph("SELECT count(*) AS n, 1 AS lo, 0::BIGINT AS over FROM e"))
