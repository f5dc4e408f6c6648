"""Lineage cuts through tables in the shared folder.

An iterative plan has to forget its history or it grows with every round.  `cut`
writes a frame as Parquet in the folder that `spark.checkpoint.dir` names and reads
it back: the copy survives the loss of any executor, and the reader knows its true
size, which lets Catalyst choose join sides from measured bytes.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or a folder of our own in local mode where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="grafonda-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return "file://" + _OWN[app]


def cut(df: DataFrame, *partition_cols: str) -> DataFrame:
    """Materialise a frame in the shared folder and return a reader of the copy."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/grafonda-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    writer = df.write.mode("error").option("compression", "zstd")
    if partition_cols:
        writer = writer.partitionBy(*partition_cols)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path  # noqa: SLF001
    return out


def drop(df: DataFrame | None) -> None:
    """Delete the copy behind a frame that `cut` returned; other frames are left alone."""
    path = getattr(df, "_scratch_path", None)
    if path is None:
        return
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)
