"""Streams over a folder of event files. Event time is a zoned timestamp, as watermarks demand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.operators.relational import insert_new
from barline.session import shared_folder


def event_stream(spark: SparkSession, base: str, files_per_batch: int = 1) -> DataFrame:
    """The events table as a stream of ticks: (id, timestamp, prices, volume)."""
    schema = spark.read.parquet(f"{base}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(base)
    return as_ticks(raw)


def as_ticks(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id"), F.col("event_type").alias("id"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("value").alias("prices"), F.get_json_object("props", "$.k").cast("double").alias("volume"))


def hour_bar_stream(ticks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Tumbling hours."""
    w = ticks.withWatermark("timestamp", late).groupBy(F.window("timestamp", "1 hour"), "id").agg(F.avg("prices").alias("px"), F.sum("volume").alias("volume"), F.count("*").alias("num"))
    return w.select("id", F.col("window.start").alias("ts"), "px", "volume", "num")


def sliding_stream(ticks: DataFrame, length: str = "24 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    w = ticks.withWatermark("timestamp", late).groupBy(F.window("timestamp", length, step), "id").agg(F.avg("prices").alias("px"), F.count("*").alias("num"))
    return w.select("id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "px", "num")


def session_stream(ticks: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    w = ticks.withWatermark("timestamp", late).groupBy(F.session_window("timestamp", gap), "id").agg(F.count("*").alias("num"))
    return w.select("id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "num")


def dedup_stream(ticks: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    return ticks.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(keys)


def upsert_batch(path: str, keys: list[str]):
    """For foreachBatch: rows with new keys are appended to a Parquet table."""

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        try:
            base = spark.read.parquet(path)
        except Exception as e:  # the first batch has no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            base = spark.createDataFrame([], fresh.schema)
        insert_new(base.limit(0), fresh.join(base.select(*keys), keys, "left_anti"), keys).write.mode("append").parquet(path)

    return put


def run_available(stream: DataFrame, mode: str = "append", watch: list | None = None) -> DataFrame:
    """Runs a stream over what is there and returns its rows as a batch table.

    Batches go to Parquet in the shared folder, a repeated one over itself, with
    the checkpoint beside them; of a complete-mode stream the last one counts.
    ``watch`` receives the progress of the batches: rows, watermark, state.
    """
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession, "stream")
    last = -1

    def put(batch: DataFrame, number: int) -> None:
        nonlocal last
        last = max(last, number)
        batch.write.mode("overwrite").parquet(f"{folder}/rows/b{number:06d}")

    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if watch is not None:
        watch += q.recentProgress
    if last < 0:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows/b{last:06d}" if mode == "complete" else f"{folder}/rows/b*")
