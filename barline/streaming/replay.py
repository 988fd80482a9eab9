"""Tables replayed as streams: files in an order of arrival, with disorder, repeats and late rows where asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.session import shared_folder

FAR = "365 days"


def arrival(time: str, key: str, within: str) -> Column:
    """A time of arrival: the row's own, and up to ``within`` later by the hash of ``key``."""
    share = F.pmod(F.xxhash64(key), F.lit(1000)) / 1000
    return F.timestamp_micros((F.unix_micros(time) + share * F.expr(f"unix_micros(timestamp_micros(0) + INTERVAL {within})")).cast("long"))


def replay(rows: DataFrame, arrives: Column, batches: int = 20, end: Column | None = None) -> DataFrame:
    """``rows`` as a stream of ``batches`` files, each holding an equal span of arrival times.

    ``end``: a row (struct) that arrives ``FAR`` later as the last file; its
    time lets the watermark pass everything. Files are written in one job and
    their times set in order, which is the order a file stream reads them in.
    """
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession, "replay")
    span = rows.select(arrives.alias("a")).agg(F.min(F.unix_micros("a")).alias("low"), F.max(F.unix_micros("a")).alias("high")).first()
    width = ((span.high or 0) - (span.low or 0)) // batches + 1
    number = F.floor((F.unix_micros(arrives) - (span.low or 0)) / width).cast("int")
    rows.withColumn("_file", number).repartition("_file").write.partitionBy("_file").parquet(f"{folder}/rows")
    if end is not None:
        last = spark.range(1).select(end.alias("r")).select("r.*").select(*rows.columns)
        last.withColumn("_file", F.lit(batches)).coalesce(1).write.mode("append").partitionBy("_file").parquet(f"{folder}/rows")
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for i in range(batches + 1):
        at = path(f"{folder}/rows/_file={i}")
        if store.exists(at):
            for f in store.listStatus(at):
                store.setTimes(f.getPath(), 1_000_000_000_000 + i * 1_000_000, -1)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/rows/*")
