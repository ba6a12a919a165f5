"""Structured Streaming over event files: windows, sessions, duplicates. A run takes what is there and ends; the checkpoint makes the next one go on."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see."""
    from stratacell.operators.linkage import cut

    if spark.sparkContext.getCheckpointDir() is None:
        cut(spark.range(1))
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base}/{name}-{uuid.uuid4().hex}"


def events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events.parquet").parquet(folder).withColumn("at", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """What a stream gives for the files that are there: appended rows, the last update of each key, or the last complete result (for session windows, which have no updates)."""
    spark = stream.sparkSession
    out, log = shared_folder(spark, "stream"), shared_folder(spark, "log")
    if mode == "append":
        writer = stream.writeStream.outputMode("append").format("parquet").option("path", out)
    elif mode == "update":  # state beyond the watermark goes; a batch writes only what it changed
        writer = stream.writeStream.outputMode("update").foreachBatch(lambda df, k: df.withColumn("_batch", F.lit(k)).write.mode("append").parquet(out))
    else:
        writer = stream.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
    q = writer.option("checkpointLocation", log).trigger(availableNow=True).start()
    q.awaitTermination()
    if mode != "update":
        return spark.read.schema(stream.schema).parquet(out)
    rest = [c for c in stream.columns if c not in keys]
    found = spark.read.schema(stream.schema.add("_batch", "long")).parquet(out)
    return found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, "_r.*")


def tumbling(spark: SparkSession, folder: str, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    own = events(spark, folder).withWatermark("at", late)
    w = F.window("at", width, slide) if slide else F.window("at", width)
    return own.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(spark: SparkSession, folder: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events(spark, folder).withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))


def first_of_each(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    return events(spark, folder).withWatermark("at", "1 hour").dropDuplicates(keys)


def each_batch(stream: DataFrame, f: Callable[[DataFrame, int], None], log: str) -> None:
    """Vote or score batch by batch: f gets each micro-batch once; keys that it has done are in its own sink."""
    stream.writeStream.foreachBatch(f).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
