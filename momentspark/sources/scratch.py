"""Scratch tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; only where that is unset, one of our own (tests, a single machine)."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if named:
        return named
    if conf.get("spark.master", "").startswith("local["):
        own = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    else:
        own = f"{conf.get('spark.sql.warehouse.dir', 'spark-warehouse')}/scratch"
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


class Scratch:
    """Parquet tables under one fresh subfolder of the shared folder.

    Writing a table cuts the lineage: what reads it again after the loss of an executor starts from files
    that every machine can see. `drop` removes a table which no later plan reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        self._delete(df.scratch_path)

    def clear(self) -> None:
        """Removes all tables, once no plan reads them any more."""
        self._delete(self.root)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
