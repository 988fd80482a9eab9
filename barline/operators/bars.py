"""Bars: ticks and daily prices rolled up to hours, days, weeks and months, and dense key grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.columns import arr_last, stable_round, truncated, week_end, week_start

LONG_COLUMNS = ["ticker", "date_start", "date_end", "field", "value"]


def hour_bars(ticks: DataFrame) -> DataFrame:
    """Mean price, market cap and volume by id and hour."""
    return ticks.groupBy("id", truncated("hour", "timestamp").alias("ts")).agg(F.avg("prices").alias("px"), F.avg("market_caps").alias("marketcap"), F.avg("total_volumes").alias("volume"))


def ohlc_bars(ticks: DataFrame, unit: str = "hour") -> DataFrame:
    """Open, high, low, close, volume and tick count by id and time unit."""
    return ticks.groupBy(F.col("id").alias("symbol"), truncated(unit, "timestamp").alias("time_open")).agg(
        F.min_by("prices", "timestamp").alias("open"), F.max("prices").alias("high"), F.min("prices").alias("low"), F.max_by("prices", "timestamp").alias("close"),
        F.sum("total_volumes").alias("volume"), F.count("*").alias("num"),
    )


def day_bars(hours: DataFrame, close_hour: int = 23) -> DataFrame:
    """Daily mean price and volume; close and market cap are those of ``close_hour``, NULL without that hour."""
    at_close = lambda c: F.max(F.when(F.hour("ts") == close_hour, F.col(c)))
    return hours.groupBy("id", F.col("ts").cast("date").alias("date")).agg(
        at_close("px").alias("px_close"), F.avg("px").alias("px_avg"), at_close("marketcap").alias("marketcap"), F.avg("volume").alias("volume")
    )


def last_hour_day_bars(hours: DataFrame) -> DataFrame:
    """Daily bars whose close is the day's last hour present."""
    return hours.groupBy("id", F.col("ts").cast("date").alias("date")).agg(
        arr_last("px", "ts").alias("px_close"), F.avg("px").alias("px_avg"), arr_last("marketcap", "ts").alias("marketcap"), F.avg("volume").alias("volume")
    )


def month_bars(prices: DataFrame) -> DataFrame:
    """Month end, mean close, mean volume and last close by ticker and month; one pass, whatever the date range."""
    return prices.groupBy("ticker", F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.last_day(F.max("date")).alias("date"), stable_round(F.avg("closeadj"), 2).alias("px_close_avg"), stable_round(F.avg("volume"), 0).alias("volume"), arr_last("closeadj", "date").alias("px_close")
    )


def period_bounds(date: str, period: str, sunday_based_end: bool = False) -> tuple[Column, Column]:
    """First and last day of a date's WEEK (Monday to Friday) or MONTH."""
    if period.upper() == "WEEK":
        return week_start(date), week_end(date, sunday_based_end)
    if period.upper() == "MONTH":
        return F.trunc(date, "month"), F.last_day(date)
    raise ValueError(f"unknown period {period}")


def period_average(prices: DataFrame, field: str, period: str = "WEEK", start: str | None = None, name: str | None = None) -> DataFrame:
    """Long rows with the mean of a field in each period."""
    return _period(prices, field, period, start, name or f"{field}_avg", F.avg(field))


def period_close(prices: DataFrame, field: str, period: str = "WEEK", start: str | None = None, name: str | None = None) -> DataFrame:
    """Long rows with the last value of a field in each period."""
    return _period(prices, field, period, start, name or f"{field}_close", F.max_by(field, "date"))


def _period(prices: DataFrame, field: str, period: str, start: str | None, name: str, value: Column) -> DataFrame:
    rows = prices.where(F.col("date") >= F.lit(start).cast("date")) if start else prices
    first, last = period_bounds("date", period)
    return rows.groupBy("ticker", first.alias("date_start"), last.alias("date_end")).agg(value.alias("value")).select("ticker", "date_start", "date_end", F.lit(name).alias("field"), "value")


def resample(bars: DataFrame, minutes: int, every: int, key: str = "symbol", time: str = "time_close") -> DataFrame:
    """Longer bars from short ones: rolling extremes over ``minutes // every`` full rows, at close times on the longer grid."""
    n = minutes // every
    w = Window.partitionBy(key).orderBy(time)
    frame = w.rowsBetween(-(n - 1), 0)
    full = F.count(F.lit(1)).over(frame) == n
    rolled = bars.withColumns({"high": F.when(full, F.max("high").over(frame)), "low": F.when(full, F.min("low").over(frame)), "open": F.lag("close", n - 1).over(w)})
    minute = F.minute(time) + 60 * F.hour(time)
    return rolled.where(minute % minutes == 0)


def whole_bar(bars: DataFrame, by: list[str] | None = None) -> DataFrame:
    """All bars (of a key) as one: last close, extremes, first open time."""
    aggs = [F.max_by("close", "time_open").alias("close"), F.max("high").alias("high"), F.min("low").alias("low"), F.min("time_open").alias("time_open")]
    return bars.groupBy(*by).agg(*aggs) if by else bars.agg(*aggs)


def key_grid(keys: DataFrame, times: DataFrame, key: str = "id", time: str = "ts") -> DataFrame:
    """Every observed time for every key from the key's first time on.

    Written as an equality join on the day rather than as a range join: each
    key is expanded to the days from its first one on, and meets the observed
    times of a day. So neither side is broadcast and no nested loop runs.
    """
    first = keys.groupBy(key).agg(F.min(time).alias("_first"))
    end = times.agg(F.max(F.col(time).cast("date")).alias("_end"))
    # one row: the last day observed
    days = first.join(F.broadcast(end)).select(key, "_first", F.explode(F.sequence(F.col("_first").cast("date"), F.col("_end"))).alias("_day"))
    seen = times.select(time).distinct().withColumn("_day", F.col(time).cast("date"))
    return days.join(seen, "_day").where(F.col(time) >= F.col("_first")).select(key, time)


def filled_grid(grid: DataFrame, bars: DataFrame, key: str = "id", time: str = "ts", zero: tuple[str, ...] = ("marketcap", "volume")) -> DataFrame:
    """Bars on every grid point; the named columns are 0 in gaps, others stay NULL."""
    return grid.join(bars, [key, time], "left").fillna(0, list(zero))


def first_last(df: DataFrame, key: str, date: str = "date") -> DataFrame:
    """First and last date of every key."""
    return df.groupBy(key).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"))
