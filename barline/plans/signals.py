"""Queries: oscillator and RSI signals, trades, backtests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.functions.columns import stable_round
from barline.operators import bars
from barline.operators import signals as sg
from barline.plans.features import rounded
from barline.plans.registry import query, view
from barline.sources import canonical as src

SHORT, LONG = 3, 8
_W = "PARTITION BY symbol ORDER BY time_close"
view("bars15", "SELECT id AS symbol, date_trunc('hour', timestamp) AS time_open, date_trunc('hour', timestamp) + INTERVAL 1 HOUR AS time_close, max(prices) + 1000 AS high, min(prices) + 1000 AS low, arg_max(prices, timestamp) + 1000 AS close FROM {{ticks}} GROUP BY ALL")


def _mean(n: int, part: str = "") -> str:
    return f"CASE WHEN count(*) OVER (PARTITION BY {part}symbol ORDER BY time_close ROWS {n - 1} PRECEDING) = {n} THEN avg((high + low) / 2) OVER (PARTITION BY {part}symbol ORDER BY time_close ROWS {n - 1} PRECEDING) END"


def _color(ao: str, w: str = _W) -> str:
    return f"CASE WHEN {ao} IS NOT NULL THEN CASE WHEN round({ao}, 9) >= round(lag({ao}) OVER ({w}), 9) THEN 1 ELSE -1 END END"


view("ao", f"SELECT *, {_color('ao')} AS ao_color FROM (SELECT *, round({_mean(SHORT)} - {_mean(LONG)}, 9) AS ao FROM {{{{bars15}}}})")


def _signals(src_: str, four: bool, w: str = _W) -> str:
    lags = ", ".join(f"lag(ao_color, {k}) OVER ({w}) AS c{k}" for k in (1, 2, 3))
    up, down = "c3 = -1 AND c2 = -1 AND c1 = 1 AND ao_color = 1", "c3 = 1 AND c2 = 1 AND c1 = -1 AND ao_color = -1"
    inside = "rn >= 5 AND nxt IS NOT NULL"
    out_l, out_s = (down, up) if four else ("ao_color = -1", "ao_color = 1")
    pos = lambda a, b: f"coalesce(last_value(CASE WHEN {inside} AND {a} THEN 1 WHEN {inside} AND {b} THEN 0 END IGNORE NULLS) OVER ({w} ROWS UNBOUNDED PRECEDING), 0)"
    return f"""SELECT *, CASE WHEN pl = 1 THEN 1 WHEN lag(pl) OVER ({w}) = 1 THEN -1 ELSE 0 END AS long_signal, CASE WHEN ps = 1 THEN -1 WHEN lag(ps) OVER ({w}) = 1 THEN 1 ELSE 0 END AS short_signal FROM
      (SELECT *, {pos(up, out_l)} AS pl, {pos(down, out_s)} AS ps FROM (SELECT *, {lags}, row_number() OVER ({w}) AS rn, lead(1) OVER ({w}) AS nxt FROM {src_}))"""


view("ao_signal", _signals("{{ao}}", False))


def px(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars; the stand-in prices come near zero, so they are lifted by 1000."""
    b = bars.ohlc_bars(src.ticks(spark, d)).withColumns({c: F.col(c) + 1000 for c in ("high", "low", "close")})
    return b.select("symbol", "time_open", (F.col("time_open") + F.expr("INTERVAL 1 HOUR")).alias("time_close"), "high", "low", "close")


def color(oscillator: DataFrame) -> DataFrame:
    raw, w = oscillator.withColumn("ao", stable_round("ao", 9)), sg._w()
    return raw.withColumn("ao_color", F.when(F.col("ao").isNotNull(), F.when(F.col("ao") >= F.lag("ao").over(w), 1).otherwise(-1)))


def colored(spark: SparkSession, d: str) -> DataFrame:
    return color(sg.awesome_oscillator(px(spark, d), SHORT, LONG))


def signalled(spark: SparkSession, d: str) -> DataFrame:
    return sg.color_signals(colored(spark, d))


_OUT = ["symbol", "time_close", "ao", "ao_color", "long_signal", "short_signal"]


def _out(df: DataFrame) -> DataFrame:
    return rounded(df.select(*_OUT)).withColumns({c: F.col(c).cast("long") for c in _OUT[3:]})


@query("SELECT symbol, time_close, round(ao, 6) AS ao, CAST(ao_color AS BIGINT) AS ao_color, CAST(long_signal AS BIGINT) AS long_signal, CAST(short_signal AS BIGINT) AS short_signal FROM {{ao_signal}}")
def ao_signal(spark: SparkSession, d: str) -> DataFrame:
    return _out(signalled(spark, d))


@query("SELECT symbol, time_close, round(ao, 6) AS ao, CAST(ao_color AS BIGINT) AS ao_color, CAST(long_signal AS BIGINT) AS long_signal, CAST(short_signal AS BIGINT) AS short_signal FROM (" + _signals("{{ao}}", True) + ")")
def ao_signal_4bar(spark: SparkSession, d: str) -> DataFrame:
    return _out(sg.color_signals(colored(spark, d), four_bar_exit=True))


_RSI = f"""SELECT *, CASE WHEN l = 0 THEN CASE WHEN g > 0 THEN 100 END ELSE round(100 - 100 / (1 + g / l), 6) END AS rsi FROM (SELECT *, CASE WHEN count(d) OVER f = 14 THEN avg(greatest(d, 0)) OVER f END AS g, CASE WHEN count(d) OVER f = 14 THEN avg(greatest(-d, 0)) OVER f END AS l
    FROM (SELECT *, close - lag(close) OVER ({_W}) AS d FROM {{{{bars15}}}}) WINDOW f AS ({_W} ROWS 13 PRECEDING))"""
view("rsi", _RSI)
view("stoch", f"""SELECT symbol, time_close, close, rsi, round(sr, 7) AS stoch_rsi, CASE WHEN count(sr) OVER f = 3 THEN round(avg(sr) OVER f, 7) END AS stoch_rsi_smoothed FROM (SELECT *, (rsi - lo) / nullif(hi - lo, 0) AS sr FROM (
    SELECT *, CASE WHEN count(rsi) OVER f = 14 THEN min(rsi) OVER f END AS lo, CASE WHEN count(rsi) OVER f = 14 THEN max(rsi) OVER f END AS hi FROM {{{{rsi}}}} WINDOW f AS ({_W} ROWS 13 PRECEDING))) WINDOW f AS ({_W} ROWS 2 PRECEDING)""")


def stoch(spark: SparkSession, d: str) -> DataFrame:
    out = sg.stoch_rsi(sg.rsi(px(spark, d)).withColumn("rsi", stable_round("rsi", 6)))
    return out.withColumns({c: stable_round(c, 7) for c in ("stoch_rsi", "stoch_rsi_smoothed")})


@query("SELECT symbol, time_close, round(rsi, 6) AS rsi FROM {{rsi}}")
def rsi14(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sg.rsi(px(spark, d)).select("symbol", "time_close", "rsi"))


@query("SELECT symbol, time_close, round(stoch_rsi, 5) AS stoch_rsi, round(stoch_rsi_smoothed, 5) AS stoch_rsi_smoothed FROM {{stoch}}")
def stoch_rsi(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stoch(spark, d).select("symbol", "time_close", "stoch_rsi", "stoch_rsi_smoothed"), 5)


def _levels(up: str, out_l: str, down: str, out_s: str) -> str:
    pos = lambda a, b: f"coalesce(last_value(CASE WHEN {a} THEN 1 WHEN {b} THEN 0 END IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING), 0)"
    return f"""SELECT symbol, time_close, CAST(CASE WHEN pl = 1 THEN 1 WHEN lag(pl) OVER ({_W}) = 1 THEN -1 ELSE 0 END AS BIGINT) AS long_signal, CAST(CASE WHEN ps = 1 THEN -1 WHEN lag(ps) OVER ({_W}) = 1 THEN 1 ELSE 0 END AS BIGINT) AS short_signal FROM
      (SELECT *, {pos(up, out_l)} AS pl, {pos(down, out_s)} AS ps FROM (SELECT *, stoch_rsi_smoothed AS x, CASE WHEN row_number() OVER ({_W}) = 1 THEN last_value(stoch_rsi_smoothed) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE lag(stoch_rsi_smoothed) OVER ({_W}) END AS p FROM {{{{stoch}}}}))"""


def _sig(df: DataFrame) -> DataFrame:
    return df.select("symbol", "time_close", F.col("long_signal").cast("long").alias("long_signal"), F.col("short_signal").cast("long").alias("short_signal"))


@query(_levels("p < .2 AND x > .2", "p > .8 AND x < .8", "p > .8 AND x < .8", "p < .2 AND x > .2"))
def stoch_signal_crossing(spark: SparkSession, d: str) -> DataFrame:
    return _sig(sg.crossing_signals(stoch(spark, d)))


@query(_levels("p > .2 AND x < .2", "x > .8", "p < .8 AND x > .8", "x < .2"))
def stoch_signal_levels(spark: SparkSession, d: str) -> DataFrame:
    return _sig(sg.level_signals(stoch(spark, d)))


def _trades(src_: str, by: str = "symbol") -> str:
    w = f"PARTITION BY {by} ORDER BY time_close"
    side = lambda sig, s, name, k: f"""SELECT *, '{name}' AS side, {k} AS o, (close / nullif(lag(close) OVER ({w}), 0) - 1) * {s} AS trade_return FROM (
      SELECT *, CASE WHEN n = 1 THEN 0 WHEN {sig} = {s} AND before = 0 THEN 1 WHEN {sig} = {-s} THEN -1 ELSE 0 END AS t FROM (SELECT *, row_number() OVER ({w}) AS n, lag({sig}) OVER ({w}) AS before FROM {src_})) WHERE t <> 0"""  # noqa: E731
    return f"""SELECT *, CASE WHEN trade_return IS NOT NULL THEN 100 * product(1 + trade_return) OVER (PARTITION BY {by} ORDER BY time_close, o ROWS UNBOUNDED PRECEDING) END AS total_return_index FROM (
      SELECT * FROM ({side('long_signal', 1, 'long', 0)}) WHERE t = -1 UNION ALL SELECT * FROM ({side('short_signal', -1, 'short', 1)}) WHERE t = -1)"""


view("trades", _trades("{{ao_signal}}"))


@query("SELECT symbol, time_close, side, close, round(trade_return, 6) AS trade_return, round(trade_return - .00045, 6) AS total_return, round(total_return_index, 4) AS total_return_index FROM {{trades}}")
def trades(spark: SparkSession, d: str) -> DataFrame:
    t = sg.trades(signalled(spark, d))
    return t.select("symbol", "time_close", "side", "close", stable_round("trade_return", 6).alias("trade_return"), stable_round("total_return", 6).alias("total_return"), stable_round("total_return_index", 4).alias("total_return_index"))


@query(f"""SELECT symbol, time_close, round(product(CASE WHEN n = 1 THEN 100 ELSE coalesce(step, 1) END) OVER ({_W} ROWS UNBOUNDED PRECEDING), 4) AS total_return_index FROM (SELECT b.symbol, b.time_close, step, row_number() OVER (PARTITION BY b.symbol ORDER BY b.time_close) AS n FROM {{{{bars15}}}} b
    LEFT JOIN (SELECT symbol, time_close, product(1 + coalesce(trade_return, 0)) AS step FROM {{{{trades}}}} GROUP BY 1, 2) t ON b.symbol = t.symbol AND b.time_close = t.time_close)""")
def equity_curve(spark: SparkSession, d: str) -> DataFrame:
    s = signalled(spark, d)
    return sg.equity_curve(s, sg.trades(s)).select("symbol", "time_close", stable_round("total_return_index", 4).alias("total_return_index"))


_WIN = """SELECT s.*, w.a AS window_start, w.b AS window_end, s.symbol || CAST(w.a AS VARCHAR) AS k FROM {{ao_signal}} s JOIN (SELECT symbol, CAST(unnest(range(f, l + INTERVAL 1 DAY, INTERVAL 5 DAY)) AS DATE) AS a, a + 5 AS b FROM (SELECT symbol, CAST(min(time_close) AS DATE) AS f, max(time_close) AS l FROM {{ao_signal}} GROUP BY 1)) w
    ON s.symbol = w.symbol AND s.time_close >= w.a AND s.time_close <= w.b"""


@query("WITH ws AS (" + _WIN + "), t AS (" + _trades("ws", "k") + ") SELECT symbol, window_start, window_end, count(*) AS trades, round(arg_max(total_return_index, (time_close, o)), 4) AS final_index FROM t GROUP BY 1, 2, 3")
def windowed_backtest(spark: SparkSession, d: str) -> DataFrame:
    return sg.windowed_backtest(signalled(spark, d)).withColumn("final_index", stable_round("final_index", 4))


PAIRS = [(s, n) for s in (3, 5) for n in (8, 13)]


def _one(s: int, n: int) -> str:
    raw = f"SELECT *, {_color('ao')} AS ao_color FROM (SELECT *, {_mean(s)} - {_mean(n)} AS ao FROM {{{{bars15}}}})"
    return f"SELECT symbol, CAST({s} AS BIGINT) AS short, CAST({n} AS BIGINT) AS long, count(*) AS trades, round(arg_max(total_return_index, (time_close, o)), 4) AS final_index FROM ({_trades('(' + _signals('(' + raw + ')', False) + ')')}) GROUP BY 1"


_SWEEP = " UNION ALL ".join(_one(s, n) for s, n in PAIRS).replace("round(ao, 9) >= round(lag(ao)", "round(ao, 9) >= round(lag(ao)")


@query(_SWEEP)
def param_sweep(spark: SparkSession, d: str) -> DataFrame:
    return swept(spark, d)


def swept(spark: SparkSession, d: str) -> DataFrame:
    return sg.sweep(px(spark, d), PAIRS).select("symbol", F.col("short").cast("long").alias("short"), F.col("long").cast("long").alias("long"), "trades", stable_round("final_index", 4).alias("final_index"))


@query(f"WITH r AS ({_SWEEP}) SELECT symbol, short, long, final_index FROM r QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY final_index DESC, short, long) = 1")
def best_params(spark: SparkSession, d: str) -> DataFrame:
    return sg.best_parameters(swept(spark, d), ["symbol"])


@query("""WITH f AS (SELECT symbol, CAST(min(time_close) AS DATE) AS f, CAST(max(time_close) AS DATE) AS l FROM {{bars15}} GROUP BY 1), w AS (SELECT symbol, CAST(unnest(range(f, l, INTERVAL 5 DAY)) AS DATE) AS s, l FROM f), r AS (SELECT symbol, s, least(s + 5, l) AS e FROM w)
    SELECT symbol, CASE WHEN e - s < 5 THEN s ELSE e END AS restart FROM r QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY e DESC) = 1""")
def running_restart(spark: SparkSession, d: str) -> DataFrame:
    """Where each symbol's backtest in windows of five days goes on: its last window is done anew if it is short."""
    span = px(spark, d).groupBy("symbol").agg(F.min("time_close").cast("date").alias("f"), F.max("time_close").cast("date").alias("l")).where("f < l")
    starts = span.select("symbol", "l", F.explode(F.expr("sequence(f, date_sub(l, 1), INTERVAL 5 DAYS)")).alias("window_start"))
    return sg.unfinished_from(starts.select("symbol", "window_start", F.least(F.date_add("window_start", 5), "l").alias("window_end")))
