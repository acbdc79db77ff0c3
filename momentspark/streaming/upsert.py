"""Keyed tables that grow and change by batches: rows of new keys are added with ids of their own, rows of known keys replaced.

A table is Parquet, partitioned by `bucket`, a hash of the key. A batch reads and rewrites only the buckets that its keys fall in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 64


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def merge(stored: DataFrame, changes: DataFrame, key: str, order: str, buckets: int = BUCKETS) -> DataFrame:
    """`stored` (id, bucket, key, order and more) with `changes` (the same without id and bucket): of each key the row with the greatest `order`, a change
    before what is stored where they are equal. A known key keeps its id. New ones get the ids after the greatest of their bucket that leave
    `bucket` as the rest by `buckets`, in order of the key; so ids are unique in the table although only its touched buckets are looked at.

    Rows of a null key are left out. Of several changes of a key that are equal in `order`, the greatest row counts.
    """
    columns = [c for c in stored.columns if c not in ("id", "bucket", key)]
    new = changes.where(F.col(key).isNotNull()).select(key, F.struct(F.col(order).alias("_at"), F.lit(1).alias("_new"), F.struct(*columns).alias("row")).alias("v"), F.lit(None).cast("long").alias("id"))
    old = stored.select(key, F.struct(F.col(order).alias("_at"), F.lit(0).alias("_new"), F.struct(*columns).alias("row")).alias("v"), "id")
    rows = old.unionByName(new).groupBy(key).agg(F.max("v").alias("v"), F.max("id").alias("id")).withColumn("bucket", bucket_of(key, buckets))
    top = rows.groupBy("bucket").agg(F.max("id").alias("top"))
    fresh = rows.where("id is null").withColumn("nth", F.row_number().over(Window.partitionBy("bucket").orderBy(key))).join(top, "bucket")
    fresh = fresh.withColumn("id", F.coalesce(F.col("top") + F.col("nth") * buckets, (F.col("nth") - 1) * buckets + F.col("bucket")).cast("long")).drop("nth", "top")
    return rows.where("id is not null").unionByName(fresh.select(rows.columns)).select("id", key, *(F.col("v.row")[c].alias(c) for c in columns), "bucket")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def touched(table: DataFrame, buckets: list[int]) -> DataFrame:
    return table.where(F.col("bucket").isin(buckets))


def upsert(path: str, key: str, order: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: `merge` of a batch into the table at `path`. A batch that is run again, whole or after it broke off, leaves one row of each key.

    What is rewritten lies complete in `<path>.merged/<batch>` before the table is touched. The partitions are then replaced one by one by Spark's dynamic
    overwrite; a batch that broke off there is put in place from that copy when it is run again, since partitions may be missing by then.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        copy = f"{path}.merged/{batch_id}"
        if not _exists(spark, f"{copy}/_SUCCESS"):
            here = [r[0] for r in batch.where(F.col(key).isNotNull()).select(bucket_of(key, buckets).alias("b")).distinct().collect()]  # `buckets` at most
            if not here:
                return
            if _exists(spark, path):
                stored = touched(spark.read.parquet(path), here)
            else:
                stored = batch.limit(0).select(F.lit(None).cast("long").alias("id"), "*", F.lit(None).cast("int").alias("bucket"))
            merge(stored, batch, key, order, buckets).write.mode("overwrite").partitionBy("bucket").parquet(copy)
        spark.read.parquet(copy).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{copy}/_SUCCESS")
        done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done.getParent(), True)

    return write


def ingest_upserts(source: DataFrame, path: str, key: str, order: str, checkpoint: str, buckets: int = BUCKETS):
    """Resumable ingest of a file stream with updates: a restart goes on after the last batch that ended."""
    return source.writeStream.foreachBatch(upsert(path, key, order, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
