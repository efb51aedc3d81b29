"""Stored tables by partition and bucket: appends, and upserts that read and rewrite only the parts their keys lie in."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headcast.streaming.replay import fresh_folder

BUCKET = "bucket"
#: More parts than this are found by a join with the batch's own instead of a list in the filter.
FEW_PARTS = 5_000


def bucketed(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """``df`` with the bucket of its keys; equal keys are in one bucket whatever else they meet."""
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def append_rows(df: DataFrame, path: str, partition: str, keys: Sequence[str], buckets: int = 8) -> None:
    """Adds rows as they are."""
    parts = [partition, BUCKET]
    bucketed(df, keys, buckets).repartition(*parts).write.mode("append").partitionBy(*parts).parquet(path)


def stored(spark: SparkSession, path: str, schema: str, partition: str) -> DataFrame:
    """The table; empty if nothing was written yet. ``schema`` names all columns, the partition's too."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], f"{schema}, {BUCKET} int")
    return spark.read.schema(f"{schema}, {BUCKET} int").parquet(path)


def touched(table: DataFrame, batch: DataFrame, partition: str) -> DataFrame:
    """The rows of ``table`` in the partitions and buckets that ``batch`` (with buckets) lies in: other files aren't opened."""
    parts = batch.select(partition, BUCKET).distinct()
    found = parts.limit(FEW_PARTS + 1).collect()
    if len(found) > FEW_PARTS:
        return table.join(F.broadcast(parts), [partition, BUCKET], "left_semi")
    lie = F.lit(False)
    for bucket in sorted({r[1] for r in found}):
        own: list = [r[0] for r in found if r[1] == bucket and r[0] is not None]
        inside: Column = F.col(partition).isin(own)
        if any(r[0] is None and r[1] == bucket for r in found):
            inside = inside | F.col(partition).isNull()
        lie = lie | ((F.col(BUCKET) == bucket) & inside)
    return table.where(lie)


def upsert_rows(batch: DataFrame, path: str, schema: str, partition: str, keys: Sequence[str], merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = 8) -> None:
    """Writes what ``merge(stored rows, batch)`` gives in place of the parts that the batch touches.

    A key must belong to one partition for good (the partition is among the keys, or follows from them). The merged rows are
    written aside first, since a part can't be read while it is replaced; a failure before the last step changes nothing.
    """
    spark, parts = batch.sparkSession, [partition, BUCKET]
    fresh = bucketed(batch, keys, buckets)
    old = touched(stored(spark, path, schema, partition), fresh, partition).drop(BUCKET)
    aside = fresh_folder(spark, "upsert")
    bucketed(merge(old, batch), keys, buckets).repartition(*parts).write.partitionBy(*parts).parquet(aside)
    merged = spark.read.schema(f"{schema}, {BUCKET} int").parquet(aside)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
