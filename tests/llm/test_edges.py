"""Every query and the pipeline on empty, all-null, unlabelled and one-row tables with clashing extra columns."""

from __future__ import annotations

import pytest
from grafonda.llm import fingerprints, langid, licenses, packing, quality, secrets, sentencepiece_codec, token_counts
from grafonda.llm.queries import QUERIES
from grafonda.plans.scratch import cut

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"
TEXT = "the man and the dog went to the house and it was on that day in the town with a friend."


def tables(spark, folder, docs, pages):
    spark.createDataFrame(docs, DOCS).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(pages, PAGES).coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return str(folder)


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "op1_html_blocks"])
def test_queries_on_empty_tables(spark, tmp_path, name):
    assert QUERIES[name](spark, tables(spark, tmp_path, [], [])).collect() == []


def test_pipeline_on_empty_null_and_unlabelled_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "empty", [], [])).count() == 0
    null = tables(spark, tmp_path / "null", [(None, None, None, None, None)] * 3, [(None, None, None)])
    assert corpus_pipeline.run(spark, null).count() == 0  # too short for the quality rules
    rows = [(1, TEXT, None, None, None), (2, TEXT, None, None, None), (3, None, None, None, None)]
    packed = corpus_pipeline.run(spark, tables(spark, tmp_path / "plain", rows, [])).collect()
    assert [(r["doc_id"], r["piece"], r["start"], r["offset"]) for r in packed] == [(1, 0, 0, 0)]


def test_queries_on_null_rows(spark, tmp_path):
    sf = tables(spark, tmp_path, [(None, None, None, None, None), (4, None, "en", None, None)], [(None, None, None)])
    got = {n: sorted(map(tuple, QUERIES[n](spark, sf).collect()), key=str) for n in QUERIES if n not in ("op1_html_blocks", "op10_fingerprints")}
    assert got["op2_near_dedup"] == [(4, 0, 4, True), (None, 0, None, True)]
    assert got["op3_quality"] == [(4, 0, 0, 0, 0, 0, True, False), (None, 0, 0, 0, 0, 0, True, False)]
    assert [r[:4] for r in got["op4_packing"]] == [(4, 0, 0, 1), (None, 0, 0, 1)]
    assert len({r[5] for r in got["op4_packing"]}) == 1 and sorted(r[6] for r in got["op4_packing"]) == [0, 1]
    assert [r[2:4] for r in got["op5_langid"]] == [("und", 0.0)] * 2
    assert got["op6_licenses"] == []
    assert [r[1] for r in got["op7_sentencepiece"]] == [0, 0]
    assert [r[1:4] for r in got["op8_secrets"]] == [(0, 0, 0)] * 2
    assert [(r[0], r[4]) for r in got["op9_token_counts"]] == [(4, 0), (None, 0)]
    prints = QUERIES["op10_fingerprints"](spark, sf).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"], r["near_next"]) for r in prints) == [("4", 0, 1.0), ("None", 0, 1.0)]


def test_clashing_columns(spark):
    """Names that the operators use themselves, as extra columns of the input."""
    names = "id text2 n sig key bin piece section ends tie range q_n q_text symbols_per_word words h w present loose label cell lang_pred".split()
    df = spark.createDataFrame([(1, TEXT), (2, None)], "doc_id long, text string")
    for name in names:
        df = df.withColumn(name, df["doc_id"] * 0)
    assert quality.quality(df).count() == 2
    assert packing.pack(df).count() == 2
    model = langid.fit({"en": [TEXT] * 4})
    assert langid.identify(df, model).count() == 2
    assert licenses.license_scan(df).count() == 0
    assert sentencepiece_codec.encode(df).count() == 2
    assert secrets.scan(df).count() == 2
    assert token_counts.section_tokens(df).count() == 2
    assert fingerprints.fingerprint(df).count() == 2
    for stage in (quality.stage, secrets.stage):
        assert cut(stage(spark, df, "")).columns == df.columns


def test_stages_keep_odd_rows_defined(spark):
    """Null ids, repeated rows and long texts through the stages that return documents."""
    long = " ".join(f"{TEXT[:-1]} {i}" for i in range(4000))
    rows = [(None, TEXT, "en", None, 1), (7, TEXT + " again and more", "en", "s", 2), (7, TEXT + " again and more", "en", "s", 2), (8, long, None, "s", None), (9, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = cut(stage(spark, docs, ""))
        assert out.columns == docs.columns, name
        ids = [r["doc_id"] for r in out.collect()]
        if name in ("near_dedup", "secrets"):
            assert sorted(map(str, ids)) == ["7", "7", "8", "9", "None"], name  # rows of one id are one document
    assert [r["doc_id"] for r in quality.stage(spark, docs, "").collect() if r["doc_id"] == 9] == []
