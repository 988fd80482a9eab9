"""Queries: scans, bars, key grids, periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.functions.columns import stable_round
from barline.operators import bars
from barline.plans.registry import query, view
from barline.sources import canonical as src
from barline.sources.readers import read_table

view("hours", "SELECT id, date_trunc('hour', timestamp) AS ts, round(avg(prices), 8) AS px, avg(market_caps) AS marketcap, avg(total_volumes) AS volume FROM {{ticks}} GROUP BY ALL")
view("days", "SELECT id, CAST(ts AS DATE) AS date, round(arg_max(px, ts), 6) AS px_close, round(avg(px), 6) AS px_avg, round(arg_max(marketcap, ts), 4) AS marketcap, round(avg(volume), 6) AS volume FROM {{hours}} GROUP BY ALL")
view("ohlc", "SELECT id AS symbol, date_trunc('hour', timestamp) AS time_open, arg_min(prices, timestamp) AS open, max(prices) AS high, min(prices) AS low, arg_max(prices, timestamp) AS close, sum(total_volumes) AS volume, count(*) AS num FROM {{ticks}} GROUP BY ALL")
view("months", "SELECT ticker, year(date) AS year, month(date) AS month, last_day(max(date)) AS date, round(avg(closeadj), 2) AS px_close_avg, round(avg(volume), 0) AS volume, arg_max(closeadj, date) AS px_close FROM {{prices}} GROUP BY ALL")
view("weekly_close", "SELECT ticker, CAST(date_trunc('week', date) AS DATE) AS date_start, CAST(date_trunc('week', date) AS DATE) + 4 AS date_end, 'closeadj_close' AS field, arg_max(closeadj, date) AS value FROM {{prices}} GROUP BY ALL")
view("weekly_avg", "SELECT ticker, CAST(date_trunc('week', date) AS DATE) AS date_start, CAST(date_trunc('week', date) AS DATE) + 4 AS date_end, 'volume_avg' AS field, round(avg(volume), 6) AS value FROM {{prices}} GROUP BY ALL")


def hours(spark: SparkSession, d: str) -> DataFrame:
    return bars.hour_bars(src.ticks(spark, d)).withColumn("px", stable_round("px", 8))


def days(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars by the last hour present, rounded for what is built on them."""
    rounded = {"px_close": 6, "px_avg": 6, "marketcap": 4, "volume": 6}
    return bars.last_hour_day_bars(hours(spark, d)).withColumns({c: stable_round(c, n) for c, n in rounded.items()})


def months(spark: SparkSession, d: str) -> DataFrame:
    return bars.month_bars(src.prices(spark, d))


def weekly(spark: SparkSession, d: str) -> DataFrame:
    """Long weekly rows: last close and mean volume."""
    p = src.prices(spark, d)
    return bars.period_close(p, "closeadj").unionByName(bars.period_average(p, "volume").withColumn("value", stable_round("value", 6)))


@query("SELECT id, ts, round(px, 6) AS px, round(marketcap, 6) AS marketcap, round(volume, 6) AS volume FROM {{hours}}")
def bar_hourly(spark: SparkSession, d: str) -> DataFrame:
    return hours(spark, d).select("id", "ts", *[stable_round(c, 6).alias(c) for c in ("px", "marketcap", "volume")])


@query("""SELECT id, CAST(ts AS DATE) AS date, round(max(CASE WHEN hour(ts) = 23 THEN px END), 6) AS px_close, round(avg(px), 6) AS px_avg,
    round(max(CASE WHEN hour(ts) = 23 THEN marketcap END), 4) AS marketcap, round(avg(volume), 6) AS volume FROM {{hours}} GROUP BY ALL""")
def bar_daily_from_hourly(spark: SparkSession, d: str) -> DataFrame:
    rounded = {"px_close": 6, "px_avg": 6, "marketcap": 4, "volume": 6}
    return bars.day_bars(hours(spark, d)).withColumns({c: stable_round(c, n) for c, n in rounded.items()})


@query("SELECT CAST(year AS BIGINT) AS year, CAST(month AS BIGINT) AS month, ticker, date, px_close_avg, volume, px_close FROM {{months}}")
def bar_monthly(spark: SparkSession, d: str) -> DataFrame:
    return months(spark, d).withColumns({c: F.col(c).cast("long") for c in ("year", "month")})


@query("SELECT * FROM {{weekly_close}} UNION ALL SELECT * FROM {{weekly_avg}}")
def bar_weekly_long(spark: SparkSession, d: str) -> DataFrame:
    return weekly(spark, d)


@query("""SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS date_start, last_day(date) AS date_end, 'closeadj_avg' AS field, round(avg(closeadj), 6) AS value
    FROM {{prices}} WHERE date >= DATE '1995-01-01' GROUP BY ALL""")
def bar_monthly_long(spark: SparkSession, d: str) -> DataFrame:
    return bars.period_average(src.prices(spark, d), "closeadj", "MONTH", start="1995-01-01").withColumn("value", stable_round("value", 6))


@query("""SELECT DISTINCT CAST(l_shipdate AS DATE) AS date, CAST(date_trunc('week', l_shipdate) AS DATE) AS start_day, CAST(date_trunc('week', l_shipdate) AS DATE) + 4 AS end_day,
    CAST(l_shipdate AS DATE) - CAST(dayofweek(l_shipdate) AS INTEGER) + 5 AS end_sunday_based FROM lineitem""")
def week_bounds(spark: SparkSession, d: str) -> DataFrame:
    day = read_table(spark, d, "lineitem", ["l_shipdate"]).select(F.col("l_shipdate").cast("date").alias("date")).distinct()
    (start, end), (_, other) = bars.period_bounds("date", "WEEK"), bars.period_bounds("date", "WEEK", sunday_based_end=True)
    return day.select("date", start.alias("start_day"), end.alias("end_day"), other.alias("end_sunday_based"))


@query("SELECT symbol, time_open, open, high, low, close, volume, num FROM {{ohlc}}")
def ohlc_hourly(spark: SparkSession, d: str) -> DataFrame:
    return bars.ohlc_bars(src.ticks(spark, d))


@query("SELECT symbol, arg_max(close, time_open) AS close, max(high) AS high, min(low) AS low, min(time_open) AS time_open FROM {{ohlc}} GROUP BY symbol")
def whole_frame_bar(spark: SparkSession, d: str) -> DataFrame:
    return bars.whole_bar(bars.ohlc_bars(src.ticks(spark, d)), ["symbol"])


@query("""SELECT g.id, g.ts, round(h.px, 6) AS px, round(coalesce(h.marketcap, 0), 6) AS marketcap, round(coalesce(h.volume, 0), 6) AS volume FROM (
      SELECT a.id, b.ts FROM (SELECT id, min(ts) AS first_ts FROM {{hours}} GROUP BY id) a LEFT JOIN (SELECT DISTINCT ts FROM {{hours}}) b ON b.ts >= a.first_ts) g
    LEFT JOIN {{hours}} h ON g.id = h.id AND g.ts = h.ts""")
def key_grid_filled(spark: SparkSession, d: str) -> DataFrame:
    h = hours(spark, d)
    out = bars.filled_grid(bars.key_grid(h, h), h)
    return out.select("id", "ts", *[stable_round(c, 6).alias(c) for c in ("px", "marketcap", "volume")])


@query("""SELECT a.ticker, b.date_start FROM (SELECT ticker, min(date_start) AS f FROM {{weekly_close}} GROUP BY 1) a CROSS JOIN (SELECT DISTINCT date_start FROM {{weekly_close}}) b WHERE b.date_start >= a.f""")
def key_grid_eav(spark: SparkSession, d: str) -> DataFrame:
    w = bars.period_close(src.prices(spark, d), "closeadj")
    return bars.key_grid(w, w, "ticker", "date_start")


@query("SELECT ticker, min(date) AS first_date, max(date) AS last_date FROM {{prices}} GROUP BY 1")
def first_last_trade(spark: SparkSession, d: str) -> DataFrame:
    return bars.first_last(src.prices(spark, d), "ticker")


@query("""SELECT ticker, last_day(max(date)) AS date, round(avg(ev), 2) AS ev, round(avg(evebit), 2) AS evebit, round(avg(marketcap), 2) AS marketcap, round(avg(pb), 2) AS pb, round(avg(pe), 2) AS pe, round(avg(ps), 2) AS ps
    FROM {{valuations}} GROUP BY ticker, year(date), month(date)""")
def valuation_monthly(spark: SparkSession, d: str) -> DataFrame:
    v = src.valuations(spark, d)
    return v.groupBy("ticker", F.trunc("date", "month").alias("_m")).agg(F.last_day(F.max("date")).alias("date"), *[stable_round(F.avg(c), 2).alias(c) for c in ("ev", "evebit", "marketcap", "pb", "pe", "ps")]).drop("_m")


@query("SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events", ["event_id", "event_type", "props"])
    return e.select("event_id", "event_type", F.from_json("props", "k long").getField("k").alias("k"))


@query("""WITH b AS (SELECT symbol, time_open AS time_close, close, high, low FROM {{ohlc}}),
    r AS (SELECT symbol, time_close, close, lag(close, 3) OVER w AS open, CASE WHEN count(*) OVER f = 4 THEN max(high) OVER f END AS high, CASE WHEN count(*) OVER f = 4 THEN min(low) OVER f END AS low
      FROM b WINDOW w AS (PARTITION BY symbol ORDER BY time_close), f AS (PARTITION BY symbol ORDER BY time_close ROWS 3 PRECEDING))
    SELECT symbol, time_close, close, open, high, low FROM r WHERE hour(time_close) % 4 = 0""")
def resample_bars(spark: SparkSession, d: str) -> DataFrame:
    b = bars.ohlc_bars(src.ticks(spark, d)).select("symbol", F.col("time_open").alias("time_close"), "close", "high", "low")
    return bars.resample(b, 240, 60).select("symbol", "time_close", "close", "open", "high", "low")
