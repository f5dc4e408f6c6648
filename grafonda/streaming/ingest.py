"""Components over a stream of arcs.

Each micro-batch joins the stored forest (id, component) with the batch's arcs and
contracts both again; the forest is a versioned table, written before the old one is
left, so a repeated batch after a failure gives the same forest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafonda.operators.components import star_components
from grafonda.plans.scratch import drop


class ComponentStream:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.version = self._stored()

    def _stored(self) -> int | None:
        """The last whole version in the folder, so a restarted driver goes on from it."""
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        top = jvm.org.apache.hadoop.fs.Path(self.folder)
        whole = top.getFileSystem(conf).globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/v*/_SUCCESS")) or []
        return max((int(x.getPath().getParent().getName()[1:]) for x in whole), default=None)

    def forest(self) -> DataFrame | None:
        """(id, component) after the last batch."""
        return None if self.version is None else self.spark.read.parquet(f"{self.folder}/v{self.version}")

    def batch(self, arcs: DataFrame, number: int) -> None:
        """The function for foreachBatch; arcs(src, dst)."""
        if self.version is not None and self.version >= number:  # the batch was applied before its commit got through
            return
        known = self.forest()
        edges = arcs.select("src", "dst")
        if known is not None:
            edges = edges.union(known.select(F.col("id").alias("src"), F.col("component").alias("dst")))
        found = star_components(edges)
        found.write.mode("overwrite").parquet(f"{self.folder}/v{number}")
        drop(found)
        self.version = number

    def start(self, stream: DataFrame, checkpoint: str, **trigger):  # noqa: ANN003, ANN201
        """Run over a streaming frame of arcs."""
        return stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
