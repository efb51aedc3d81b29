"""Streaming twins of the batch operators: file sources, watermarks, keyed state, and idempotent sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headcast.checkpoints import ensure_checkpoint_dir
from headcast.operators.online import Conformal, known, ordered_fold


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The event table as a stream; its schema is taken from the files themselves.

    A stream's path must be a folder or a pattern: a pattern such as ``event[s].parquet`` fits both a file and a folder.
    """
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path)


def run_once(stream: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Everything that is there now through the streaming plan, written to the shared folder and read back.

    In update mode each micro-batch holds only the keys it changed: it is written under its number (a repeated batch
    overwrites itself), and the newest row of each of ``keys`` counts.
    """
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{folder}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/out")
    if not keys:
        raise ValueError("update mode needs the keys that a later batch replaces")
    writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")).start().awaitTermination()
    every = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/out")
    return every.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "batch").alias("r")).select("r.*")


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their values by type and window; in append mode a window is given out, and its state dropped, once the
    watermark (the latest time seen less ``late``) has passed its end."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    by = timed.withWatermark("at", late).groupBy(F.window("at", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("w.start").alias("start_at"), "event_type", "n", "total")


def sliding_counts(polled: DataFrame, length: str, every: str, late: str) -> DataFrame:
    """Polls, delays and faults per line in windows of ``length`` that begin ``every`` so often, each given out once closed.

    A row counts in each of its windows that is still open: what comes later than a window's end and the delay misses it.
    """
    timed = polled.withColumn("at", F.col("polled_at").cast("timestamp")).withWatermark("at", late)
    by = timed.groupBy(F.window("at", length, every).alias("w"), "line").agg(F.count("*").alias("n_polls"), F.count_if("delayed").alias("n_delayed"), F.count_if("fault").alias("n_fault"))
    return by.select(F.col("w.start").alias("start_at"), "line", "n_polls", "n_delayed", "n_fault")


def rolling_promotions(requests: DataFrame, least: int = 50, length: str = "7 days", every: str = "1 day", late: str = "1 day") -> DataFrame:
    """Pairs asked for ``least`` times or more within any ``length``, as a stream of requests shows them.

    Windowed counts go, in update mode, into a keyed sink: a batch adds the pairs that no earlier batch has added, under its
    own number, so a repeated batch writes the same again and nothing twice. Returns origin, destination, n and batch.
    """
    spark = requests.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/promoted-{uuid.uuid4().hex}"
    schema = T.StructType([*(requests.schema[c] for c in ("origin", "destination")), T.StructField("n", T.LongType())])
    timed = requests.where("success").withColumn("at", F.col("queried_at").cast("timestamp")).withWatermark("at", late)
    counts = timed.groupBy(F.window("at", length, every), "origin", "destination").agg(F.count("*").alias("n"))
    numbers: list[int] = []

    def add(batch: DataFrame, number: int) -> None:
        popular = batch.where(F.col("n") >= least).groupBy("origin", "destination").agg(F.max("n").alias("n"))
        for before in range(number):
            popular = popular.join(batch.sparkSession.read.schema(schema).parquet(f"{folder}/batch={before}"), ["origin", "destination"], "left_anti")
        popular.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        numbers.append(number)

    query = counts.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    every_row = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(every_row).parquet(folder) if numbers else spark.createDataFrame([], every_row)


def first_seen(events: DataFrame, keys: list[str], late: str = "6 hours") -> DataFrame:
    """Insert-if-absent on a stream: the first row of each key within the watermark."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


def interval_join(forecasts: DataFrame, arrivals: DataFrame, wait: str = "2 hours", late: str = "1 hour", how: str = "left_outer") -> DataFrame:
    """Forecasts with the arrivals of their key within ``wait`` after them; both sides forget what can't match any more.

    A forecast that nothing met is given out with nulls once the watermark has passed its window (``how`` outer). A forecast
    meets the arrivals of its own stretch of time, to which those of the next stretch are given too: the state's buckets are a
    key's stretches, not its history, and a forecast is in one of them.
    """
    # a stretch is longer than any wait, also one of days when clocks change
    width = F.expr(f"unix_micros(timestamp_micros(0) + interval {wait})") * 1.25
    stretch = lambda at: F.floor(F.unix_micros(at) / width)
    left = forecasts.withWatermark("leave_at", late).withColumn("__bin", stretch(F.col("leave_at")))
    own = stretch(F.col("arrived_at"))
    right = arrivals.withWatermark("arrived_at", late).withColumn("__a_bin", F.explode(F.array(own, own - 1)))
    met = left.join(right, F.expr(f"key = a_key and __bin = __a_bin and arrived_at >= leave_at and arrived_at <= leave_at + interval {wait}"), how)
    return met.drop("__bin", "__a_bin")


CONFORMAL_STATE = "offset_s double, step_size double, n bigint, missed bigint, weights array<double>"


def conformal_stream(observations: DataFrame, target: float = 0.8, remember: bool = False) -> DataFrame:
    """Conformal offset per key, carried from micro-batch to micro-batch; rows of a batch count in order of ``at``.

    ``observations``: a stream of key, at, raw, seen. Each batch folds its sorted rows, streamed, onto the state written by
    the batch before, and writes the new state under its own number: memory holds one key's state, and a repeated batch
    gives the same again. Returns the state after everything that is there now; unknown values don't count.
    """
    spark, kind = observations.sparkSession, observations.schema["key"].dataType.simpleString()
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/conformal-{uuid.uuid4().hex}"
    schema = f"key {kind}, {CONFORMAL_STATE}"

    def step(fold: Conformal, values: tuple) -> None:
        _, raw, seen, state = values
        if state is not None:
            fold.offset, fold.step_size, fold.n, fold.missed, fold.weights = state["offset_s"], state["step_size"], state["n"], state["missed"], list(state["weights"])
        elif known(raw) and known(seen):
            fold.update(raw, seen)

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.where("at is not null").select("key", "at", "raw", "seen")
        if number:
            before = batch.sparkSession.read.schema(schema).parquet(f"{folder}/batch={number - 1}")
            rows = rows.unionByName(before.select("key", F.struct(*before.columns[1:]).alias("state")), allowMissingColumns=True)
        else:
            rows = rows.withColumn("state", F.lit(None).cast(T.StructType.fromDDL(CONFORMAL_STATE)))
        now = ordered_fold(
            rows.select("key", "at", "raw", "seen", "state"), ["key"], ["at", "raw", "seen"], schema, lambda key: Conformal(target, remember), step, lambda key, f: (*key, f.offset, f.step_size, f.n, f.missed, f.weights)
        )
        now.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        last[0] = number

    last = [-1]
    query = observations.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/cursor").trigger(availableNow=True).start()
    query.awaitTermination()
    if last[0] < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/batch={last[0]}")


def tail_ndjson(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A folder of newline-delimited JSON as a stream; the checkpoint is the cursor, lines that don't parse are left out."""
    lines = spark.readStream.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(folder)
    return lines.where("_corrupt_record is null").drop("_corrupt_record")


def upsert_batches(stream: DataFrame, merge: Callable[[DataFrame], None], checkpoint: str):
    """Runs ``merge`` on every micro-batch; with a keyed merge a repeated batch changes nothing."""
    return stream.writeStream.foreachBatch(lambda batch, _: merge(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
