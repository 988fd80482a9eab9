"""Sources and sinks. Schemas are given where they are known: inferring one costs a pass over the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barline.functions.columns import nearest_minute

#: A map, as keys differ in case alone (t: open time, T: close time).
CANDLE = "map<string,string>"
PRICE_ARRAYS = "struct<prices:array<array<double>>,market_caps:array<array<double>>,total_volumes:array<array<double>>>"


def read_table(spark: SparkSession, base: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table; a column list reaches the scan."""
    df = spark.read.parquet(f"{base}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_files(spark: SparkSession, paths: list[str], required: list[str] | None = None, skip_broken: bool = True, schema: StructType | None = None) -> DataFrame:
    """Many Parquet files as one table, without rows that miss a key; unreadable or missing ones are left out if so asked.

    Without a ``schema`` a job reads the footers and merges them; broken files
    are then left out of that as well.
    """
    skip = str(skip_broken).lower()
    reader = spark.read.options(ignoreCorruptFiles=skip, ignoreMissingFiles=skip, mergeSchema=str(schema is None).lower())
    df = (reader.schema(schema) if schema is not None else reader).parquet(*paths)
    return df.dropna("any", subset=required) if required else df


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None)


def candles_from_json(raw: DataFrame, column: str = "value") -> DataFrame:
    """Candles from JSON arrays of objects with numbers as strings and epoch milliseconds; the close time is rounded to the minute."""
    c = raw.select(F.explode(F.from_json(column, f"array<{CANDLE}>")).alias("c"))
    number = lambda k, as_: F.col("c")[k].cast("double").alias(as_)
    time = lambda k: F.timestamp_millis(F.col("c")[k].cast("long"))
    return c.select(
        time("t").alias("time_open"), nearest_minute(time("T")).alias("time_close"), F.col("c")["s"].alias("symbol"), F.col("c")["i"].alias("interval"),
        number("o", "open"), number("c", "close"), number("h", "high"), number("l", "low"), number("v", "volume"), F.col("c")["n"].cast("long").alias("num"),
    )


def unnest_price_arrays(raw: DataFrame, key: str = "id", column: str = "value") -> DataFrame:
    """Three arrays of [epoch ms, value] in one JSON object, joined in full on the time."""
    doc = raw.select(key, F.from_json(column, PRICE_ARRAYS).alias("j"))

    def part(name: str) -> DataFrame:
        e = doc.select(key, F.explode(f"j.{name}").alias("e"))
        return e.select(key, F.timestamp_millis(F.col("e")[0].cast("long")).alias("timestamp"), F.col("e")[1].alias(name))

    keys = [key, "timestamp"]
    return part("prices").join(part("market_caps"), keys, "full").join(part("total_volumes"), keys, "full")


def write_table(df: DataFrame, path: str, mode: str = "overwrite", form: str = "parquet", by: list[str] | None = None) -> None:
    """Overwrites or appends; ``by`` partitions the files (a run date, a month)."""
    w = df.write.mode(mode).format(form)
    if form == "csv":
        w = w.option("header", "true")
    (w.partitionBy(*by) if by else w).save(path)


def write_snapshot(df: DataFrame, path: str, run_date: str) -> None:
    """The table as of a run date, as a partition of its own; the same date again replaces that partition alone."""
    day = df.withColumn("run_date", F.lit(run_date).cast("date"))
    day.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(path)


def create_as(df: DataFrame, name: str, path: str | None = None) -> None:
    """CREATE TABLE .. AS SELECT: a Parquet table of the catalogue, in the warehouse or at ``path``; one of that name is replaced."""
    df.createOrReplaceTempView("_created")
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} USING parquet {f"LOCATION '{path}'" if path else ''} AS SELECT * FROM _created")
    spark.catalog.dropTempView("_created")


def insert_into(df: DataFrame, name: str) -> None:
    """INSERT INTO .. SELECT, columns by their names."""
    df.createOrReplaceTempView("_inserted")
    df.sparkSession.sql(f"INSERT INTO {name} BY NAME SELECT * FROM _inserted")
    df.sparkSession.catalog.dropTempView("_inserted")


def dated_name(name: str, day: str) -> str:
    """A table's name with year and month of a date (yyyy-mm-dd) as suffix."""
    return f"{name}_{day[:4]}{day[5:7]}"


def truncate(spark: SparkSession, path: str) -> None:
    """Leaves a Parquet table without rows, with its columns."""
    spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)


def append_log(spark: SparkSession, path: str, kind: str, status: str, message: str) -> None:
    """A row (kind, status, message, at) for a run or an error, appended."""
    row = spark.createDataFrame([(kind, status, message)], "kind string, status string, message string")
    row.withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)
