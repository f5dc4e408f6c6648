"""Corpus preparation over `documents`: five stages, each written as Parquet and read again as the next one's input.

Documents that fail the quality rules go, then those of no learned language, then all
but one of each group of near duplicates; secrets are replaced by a mark; what is left
is packed into sequences of 4096 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grafonda.llm import langid, near_dedup, packing, quality, secrets
from grafonda.llm.common import read
from grafonda.plans.scratch import cut

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("quality", quality.stage),
    ("langid", langid.stage),
    ("near_dedup", near_dedup.stage),
    ("secrets", secrets.stage),
    ("packing", packing.stage),
]

#: Language models, near-duplicate classes, compression and tokenisation are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed corpus."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
