"""Registered queries against their SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from grafonda import catalog

SF = "/root/testdata/sf0.001"
QUICK = [
    "tc_striped", "tc_sss", "tc_local_counts", "g_build", "g_degrees", "g_symmetrize", "g_edge_lookup", "g_filter", "g_index", "id_horizontal", "id_degree", "redistribute",
    "bfs_level", "sssp_chaotic", "cc", "cc_stats", "mis_fix", "gc_jp", "kcore", "pr_sync", "spmv", "time_statistics", "src_edge_list", "src_mmio", "snk_graphviz", "scc_of_source",
    "vf_bfs", "vf_tc", "vf_kcore", "mis_luby_a", "gen_er_profile", "sssp_delta",
]


def plain(frame, columns):
    def one(v):
        if v is None or v != v:
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(repr([one(v.item() if hasattr(v, "item") else v) for v in row]) for row in frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist())


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("customer", "part", "orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.sql(catalog.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert plain(got, columns) == plain(want, columns)


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).first()[0] == 343
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
