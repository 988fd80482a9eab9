"""Queries: streams over tables that arrive in twenty files, out of order, repeated and late."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.functions.columns import stable_round
from barline.plans.registry import query, view
from barline.plans.signals import LONG, SHORT, px
from barline.sources.readers import read_table

#: Rows arrive up to ten hours after their time, and the watermark waits for twelve.
LATE, BATCHES = "12 hours", 20


def _hours_later(hours: str, time: str = "ts") -> Column:
    return F.timestamp_micros((F.unix_micros(F.col(time).cast("timestamp")) + F.expr(hours).cast("long") * 3_600_000_000).cast("long"))


def _events(spark: SparkSession, d: str, hours: str = "event_id * 7 % 11", end: bool = True, twice: bool = False) -> DataFrame:
    """The events as a stream of ticks; ``end``: with a last row a year later, so that every window closes; ``twice``: each row repeated, hours later."""
    from barline import streaming as st

    e = read_table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    arrives = _hours_later(hours)
    if twice:
        e = e.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1))))
        arrives = _hours_later("event_id * 7 % 5 + 5 * _copy")
    last = e.agg(F.max("ts")).first()[0]
    values = {"event_id": F.lit(-1).cast("long"), "ts": F.lit(last) + F.expr("INTERVAL 365 DAYS"), "event_type": F.lit("~end"), "value": F.lit(0.0)}
    final = F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in e.schema]) if end else None
    return st.as_ticks(st.replay(e, arrives, BATCHES, final))


def _ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("SELECT id, date_trunc('hour', timestamp) AS ts, round(avg(prices), 6) AS px, sum(total_volumes) AS volume, count(*) AS num FROM {{ticks}} GROUP BY ALL")
def stream_hourly_bars(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling hours, each given out once, when the watermark has passed it."""
    from barline import streaming as st

    out = st.run_available(st.hour_bar_stream(_events(spark, d), LATE))
    return _ntz(out.select("id", "ts", stable_round("px", 6).alias("px"), "volume", "num"), "ts")


@query("SELECT id, date_trunc('hour', timestamp) - to_hours(k) AS start, count(*) AS num FROM {{ticks}}, (SELECT unnest(range(0, 3)) AS k) GROUP BY ALL")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    from barline import streaming as st

    out = st.run_available(st.sliding_stream(_events(spark, d), "3 hours", "1 hour", LATE))
    return _ntz(out.select("id", "start", "num"), "start")


@query("SELECT event_id, event_type AS id FROM events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Every event arrives twice, in different files."""
    from barline import streaming as st

    return st.run_available(st.dedup_stream(_events(spark, d, end=False, twice=True), ["event_id"], "1 day")).select("event_id", "id")


@query("""WITH t AS (SELECT id, timestamp, coalesce(timestamp > lag(timestamp) OVER (PARTITION BY id ORDER BY timestamp) + INTERVAL 10 MINUTE, true) AS starts FROM {{ticks}}),
    s AS (SELECT id, timestamp, sum(CAST(starts AS INTEGER)) OVER (PARTITION BY id ORDER BY timestamp) AS k FROM t) SELECT id, min(timestamp) AS "start", max(timestamp) + INTERVAL 10 MINUTE AS "end", count(*) AS num FROM s GROUP BY id, k""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that rows of several files make together."""
    from barline import streaming as st

    out = st.run_available(st.session_stream(_events(spark, d), "10 minutes", LATE))
    return _ntz(out.select("id", "start", "end", "num"), "start", "end")


@query("""WITH t AS (SELECT id, timestamp, prices, coalesce(last_value(CASE WHEN prices >= 60 THEN 1 WHEN prices <= 40 THEN 0 END IGNORE NULLS) OVER (PARTITION BY id ORDER BY timestamp), 0) AS position FROM {{ticks}}),
    b AS (SELECT *, coalesce(lag(position) OVER (PARTITION BY id ORDER BY timestamp), 0) AS before FROM t) SELECT id, timestamp, prices, CAST(position AS INTEGER) AS position FROM b WHERE position <> before""")
def stream_positions(spark: SparkSession, d: str) -> DataFrame:
    from barline import streaming as st

    out = st.run_available(st.position_stream(_events(spark, d), 60.0, 40.0, LATE, "30 days", "event_id"))
    return _ntz(out.select("id", "timestamp", "prices", "position"), "timestamp")


# One event in fifteen arrives 60 hours later. A file's rows are late by the watermark of the file before the last one.
_LATE = "CASE WHEN event_id % 15 = 0 THEN 60 ELSE event_id * 7 % 11 END"
view("arrivals", f"SELECT event_type AS id, ts, epoch_us(ts) + ({_LATE}) * 3600000000 AS a FROM events")
view("files", f"SELECT id, ts, dense_rank() OVER (ORDER BY (a - low) // w) AS b FROM {{{{arrivals}}}}, (SELECT min(a) AS low, (max(a) - min(a)) // {BATCHES} + 1 AS w FROM {{{{arrivals}}}})")
view("watermarks", "SELECT b, max(max(ts)) OVER (ORDER BY b) - INTERVAL 12 HOUR AS mark FROM {{files}} GROUP BY b")


@query("""SELECT id, date_trunc('hour', ts) AS ts, count(*) AS num FROM {{files}} f LEFT JOIN {{watermarks}} m ON m.b = f.b - 2
    WHERE mark IS NULL OR date_trunc('hour', ts) + INTERVAL 1 HOUR > mark GROUP BY ALL""")
def stream_late_rows(spark: SparkSession, d: str) -> DataFrame:
    """Hours of the rows that come in time; later ones are dropped."""
    from barline import streaming as st

    out = st.run_available(st.hour_bar_stream(_events(spark, d, _LATE), LATE))
    return _ntz(out.select("id", "ts", "num"), "ts")


def _bars(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars as a stream: each comes up to nine hours late, and a last one a year later."""
    from barline import streaming as st

    b = px(spark, d).select("symbol", F.col("time_close").cast("timestamp").alias("time_close"), "high", "low", "close")
    last = b.agg(F.max("time_close")).first()[0]
    end = F.struct(F.lit("~end").alias("symbol"), (F.lit(last) + F.expr("INTERVAL 365 DAYS")).alias("time_close"), *[F.lit(0.0).alias(c) for c in ("high", "low", "close")])
    return st.replay(b, _hours_later("hour(time_close) * 7 % 10", "time_close"), BATCHES, end)


def _signals(spark: SparkSession, d: str) -> DataFrame:
    from barline import streaming as st

    return _ntz(st.run_available(st.signal_stream(_bars(spark, d), SHORT, LONG, LATE, "30 days")), "time_close")


@query("SELECT symbol, time_close, round(ao, 6) AS ao, CAST(ao_color AS BIGINT) AS ao_color, CAST(long_signal AS BIGINT) AS long_signal, CAST(short_signal AS BIGINT) AS short_signal FROM {{ao_signal}}")
def stream_signals(spark: SparkSession, d: str) -> DataFrame:
    """The signals of every bar, as the batch operator has them."""
    return _signals(spark, d).select("symbol", "time_close", stable_round("ao", 6).alias("ao"), *[F.col(c).cast("long").alias(c) for c in ("ao_color", "long_signal", "short_signal")])


@query("SELECT symbol, time_close, side, close, round(trade_return, 6) AS trade_return, round(trade_return - .00045, 6) AS total_return, round(total_return_index, 4) AS total_return_index FROM {{trades}}")
def stream_trades(spark: SparkSession, d: str) -> DataFrame:
    """The closed trades, as the batch operator has them."""
    from barline import streaming as st

    t = st.closed_trades(_signals(spark, d))
    return t.select("symbol", "time_close", "side", "close", stable_round("trade_return", 6).alias("trade_return"), stable_round("total_return", 6).alias("total_return"), stable_round("total_return_index", 4).alias("total_return_index"))
