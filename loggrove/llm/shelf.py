"""Written tables of one job, which are deleted as soon as no later step reads them."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from loggrove.scratch import scratch_path


class Shelf:
    def __init__(self, spark: SparkSession):
        self.spark, self._paths = spark, {}

    def put(self, frame: DataFrame, label: str) -> DataFrame:
        """Write ``frame`` below the shared folder and return a scan of it."""
        path = self._paths[label] = scratch_path(self.spark, label)
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        """Delete tables, and let Spark delete the shuffle files of finished steps.

        Spark keeps a shuffle's files until its driver has collected the plan as garbage, which
        a large heap puts off for long.
        """
        jvm = self.spark._jvm
        for label in labels:
            path = jvm.org.apache.hadoop.fs.Path(self._paths.pop(label))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        jvm.System.gc()
