"""Change events applied to a store in micro-batches, once for each available file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def apply_changes(spark: SparkSession, source: str, schema: str, store: str, checkpoint: str, key: str = "document_id") -> None:
    """Fold change files (key, version, change, ...) into the Parquet store; running it again changes nothing.

    A batch's newest event of a key wins; 'D' deletes. Each batch writes the
    next generation of the store beside the old one and then names it.
    """

    def fold(batch: DataFrame, epoch: int) -> None:
        w = Window.partitionBy(key).orderBy(F.desc("version"))
        last = batch.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
        old = current(batch.sparkSession, store)
        kept = last if old is None else last.unionByName(old.join(last.select(key), key, "left_anti"))
        kept.filter("change <> 'D'").write.mode("overwrite").parquet(f"{store}/generation={epoch}")

    query = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def current(spark: SparkSession, store: str) -> DataFrame | None:
    """The newest generation."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    found = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path) if s.getPath().getName().startswith("generation=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.parquet(f"{store}/generation={max(found)}") if found else None
