"""The pipeline's stages on the smallest tables, and held-out accuracy of language identification."""

from __future__ import annotations

import duckdb
from grafonda.llm import langid, licenses, quality
from grafonda.plans.scratch import cut

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, SF))
        assert docs.columns == columns, name
        after = docs.count()
        assert after == before if name == "secrets" else after <= before
        before = after
    ids = [r[0] for r in docs.select("doc_id").collect()]
    assert len(set(ids)) == len(ids) > 50
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r[0] for r in last.select("doc_id").collect()} == set(ids)


def test_held_out_languages(spark):
    found = langid.query(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = found.where("held_out")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count()


def test_sql_of_native_queries(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for module in (quality, licenses):
        got = sorted(map(repr, (tuple(r) for r in module.query(spark, SF).collect())))
        names = ", ".join(module.query(spark, SF).columns)
        want = sorted(map(repr, con.sql(f"SELECT {names} FROM ({module.ORACLE_SQL})").fetchall()))
        assert got == want
