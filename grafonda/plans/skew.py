"""Joins with a summary per key that adaptive execution can split where a key is frequent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def meet(rows: DataFrame, key: str, summary: DataFrame) -> DataFrame:
    """rows joined with the one row that summary has for a key, an integer.

    A summary that was aggregated by the key already lies where the join wants it, so
    Spark would join in the aggregate's own stage, which it cannot split: all rows of
    a frequent key would meet in one task.  Here the key passes through an expression
    that changes nothing but hides this; the join then has two shuffles of its own,
    of which adaptive execution deals a long partition to several tasks.
    """
    hidden = F.col(key).bitwiseXOR(F.lit(1)).bitwiseXOR(F.lit(1))
    return rows.join(summary.withColumn(key, hidden), key)
