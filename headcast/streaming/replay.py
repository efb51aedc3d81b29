"""Tables as streams of numbered micro-batches, and what a streaming plan gave over them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headcast.checkpoints import ensure_checkpoint_dir

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def as_stream(df: DataFrame, batch: Column, files: int = 1) -> DataFrame:
    """``df`` as a stream whose micro-batches are the rows of equal ``batch``, in ascending order.

    ``df`` is computed once, into a staging folder by batch. From there each batch is written as ``files`` files in its turn,
    and the file source takes that many at a time, oldest first. The numbers of batches are few and known to the driver; a
    stream that exists already is read as it comes instead.
    """
    spark = df.sparkSession
    folder, staging = fresh_folder(spark, "replay"), fresh_folder(spark, "staged")
    df.withColumn("__batch", batch.cast("long")).where("__batch is not null").write.partitionBy("__batch").parquet(staging)
    numbered = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("__batch", T.LongType())])).parquet(staging)
    for (number,) in sorted(numbered.select("__batch").distinct().collect()):
        part = numbered.where(F.col("__batch") == number).drop("__batch")
        # every batch has exactly so many files, empty ones included, so that batches keep step with the source
        part.repartition(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(folder)


@dataclass
class Ran:
    """What a stream gave, and its progress: rows its watermark dropped, and how many micro-batches ran."""

    rows: DataFrame
    dropped: int
    batches: int


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Keyed state with timers needs the RocksDB store; the session's own choice is put back afterwards."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def run_through(stream: DataFrame, mode: str = "append", checkpoint: str | None = None, out: str | None = None) -> Ran:
    """Runs ``stream`` over everything that is there; each micro-batch is written under its number, so that a repeated one
    overwrites itself. Rows come with ``batch``. A run with the ``checkpoint`` and ``out`` of one before goes on from it."""
    spark = stream.sparkSession
    folder = fresh_folder(spark, "stream")
    out = out or f"{folder}/out"
    with keyed_state(spark):
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or f"{folder}/state").trigger(availableNow=True)
        query = writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")).start()
        query.awaitTermination()
    states = [s for p in query.recentProgress for s in p["stateOperators"]]
    schema = stream.schema.add("batch", "long")
    rows = spark.read.schema(schema).option("basePath", out).parquet(out) if query.recentProgress and _exists(spark, out) else spark.createDataFrame([], schema)
    return Ran(rows, sum(s["numRowsDroppedByWatermark"] for s in states), len(query.recentProgress))


def _exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows in update mode the one of the last batch, for each key."""
    values = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("r")).select("r.*")
