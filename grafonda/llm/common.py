"""What the corpus operators share: reading tables and getting the package to executors."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_SHIPPED: set[str] = set()
#: Rows of one Arrow batch between the JVM and Python: some MB of text, where Spark's 10,000 would be tens of MB on either side.
BATCH_ROWS = 1000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let executors import this package: a zip of it goes out through Spark's own file server, once."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    top = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="grafonda-ship-")  # the file server reads the zip for as long as the application runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = os.path.join(folder, "grafonda_ship.zip")
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(name)


def give_back() -> None:
    """Return freed memory to the system: workers outlive their tasks, and what they keep counts against the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def in_arrow(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """rows.mapInArrow(run, schema) in batches of at most BATCH_ROWS rows, by workers that end their tasks with little memory.

    A smaller batch size of the session stays; a larger one is lowered for the session.
    """
    spark = rows.sparkSession
    ship(spark)
    if not 0 < int(spark.conf.get(_BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(_BATCH_SETTING, BATCH_ROWS)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return rows.mapInArrow(held, schema)


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra columns of any name cannot clash with our own."""
    return df.select(*[df[c] for c in columns])


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
