"""The canonical inputs (ticks, prices, valuations, fundamentals, ...) as views over the TPC-like tables.

Values that later steps compare or rank are rounded here once, so that results
don't depend on the order of floating-point sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.functions.columns import stable_round
from barline.sources.readers import read_table


def ticks(spark: SparkSession, base: str) -> DataFrame:
    """(id, timestamp, prices, market_caps, total_volumes)."""
    e = read_table(spark, base, "events", ["event_type", "ts", "value", "user_id", "props"])
    return e.select(
        F.col("event_type").alias("id"), F.col("ts").alias("timestamp"), F.col("value").alias("prices"), F.col("user_id").cast("double").alias("market_caps"),
        F.get_json_object("props", "$.k").cast("double").alias("total_volumes"),
    )


def _lines(spark: SparkSession, base: str, columns: list[str]) -> DataFrame:
    """Lines with their part. Parts grow with the lines, so they are merged: just below the threshold a broadcast would send all of them through the driver."""
    line = read_table(spark, base, "lineitem", ["l_partkey", "l_shipdate", *columns])
    part = read_table(spark, base, "part", ["p_partkey", "p_brand", "p_retailprice"])
    return line.join(part.hint("merge"), line.l_partkey == part.p_partkey).withColumn("date", F.col("l_shipdate").cast("date")).withColumnRenamed("p_brand", "ticker")


def prices(spark: SparkSession, base: str) -> DataFrame:
    """Daily equity prices: (ticker, date, closeadj, high, low, volume), a row for each ticker and day."""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return _lines(spark, base, ["l_extendedprice", "l_quantity"]).groupBy("ticker", "date").agg(
        stable_round(F.avg(unit), 6).alias("closeadj"), stable_round(F.max(unit), 6).alias("high"), stable_round(F.min(unit), 6).alias("low"), F.sum("l_quantity").alias("volume")
    )


def valuations(spark: SparkSession, base: str) -> DataFrame:
    """(ticker, date, marketcap, ev, evebit, pe, pb, ps)."""
    price = F.col("l_extendedprice")
    return _lines(spark, base, ["l_extendedprice", "l_discount", "l_tax", "l_quantity"]).groupBy("ticker", "date").agg(
        stable_round(F.sum(price), 2).alias("marketcap"), stable_round(F.sum(price * (1 - F.col("l_discount"))), 2).alias("ev"), stable_round(F.avg("p_retailprice"), 4).alias("evebit"),
        stable_round(F.avg("l_discount") * 100, 6).alias("pe"), stable_round(F.avg("l_tax") * 100, 6).alias("pb"), stable_round(F.avg("l_quantity"), 6).alias("ps"),
    )


def fundamentals(spark: SparkSession, base: str) -> DataFrame:
    """Quarterly: (ticker, dimension, datekey, revenue, assets, debt, cashneq, ebit, intexp, capex, equity)."""
    price, kept = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_discount"))
    flag = lambda f: stable_round(F.sum(F.when(F.col("l_returnflag") == f, price)), 2)
    df = _lines(spark, base, ["l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_returnflag"]).withColumn("quarter", F.date_trunc("quarter", "date").cast("date"))
    return df.groupBy("ticker", "quarter").agg(
        F.max("date").alias("datekey"), stable_round(F.sum(kept), 2).alias("revenue"), stable_round(F.sum(price), 2).alias("assets"), flag("R").alias("debt"), flag("N").alias("cashneq"),
        stable_round(F.sum(kept) - 0.9 * F.sum(F.col("p_retailprice") * F.col("l_quantity")), 2).alias("ebit"), stable_round(F.sum(price * F.col("l_tax")) - 1000, 2).alias("intexp"),
        stable_round(F.sum(price * F.col("l_discount")), 2).alias("capex"), flag("A").alias("equity"),
    ).select("ticker", F.lit("ARQ").alias("dimension"), "datekey", "revenue", "assets", "debt", "cashneq", "ebit", "intexp", "capex", "equity")


def metadata(spark: SparkSession, base: str) -> DataFrame:
    """(ticker, famaindustry, sector)."""
    p = read_table(spark, base, "part", ["p_brand", "p_type", "p_size"])
    return p.groupBy(F.col("p_brand").alias("ticker")).agg(F.min("p_type").alias("famaindustry"), F.concat(F.lit("S"), (F.max("p_size") % 4).cast("string")).alias("sector"))


def actions(spark: SparkSession, base: str) -> DataFrame:
    """(ticker, date, action): returned lines stand for delistings."""
    return _lines(spark, base, ["l_returnflag"]).where("l_returnflag = 'R'").select("ticker", "date", F.lit("delisted").alias("action"))
