"""Oscillator and RSI signals, trades and backtests, all by windows: symbols run in parallel and no row is looped over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barline.functions.columns import safe_div

KEY, TIME = "symbol", "time_close"


def _w(by: tuple[str, ...] = (KEY,), time: str = TIME) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(time)


def _full(agg: Column, x: Column, w: WindowSpec, n: int) -> Column:
    """An aggregate over n rows, NULL unless all n have a value."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) == n, agg.over(frame))


def awesome_oscillator(px: DataFrame, short: int = 5, long: int = 34, by: tuple[str, ...] = (KEY,)) -> DataFrame:
    """``ao`` (short less long mean of the bar middle) and ``ao_color``: 1 where it is at least the value before, else -1; the first value is -1."""
    w = _w(by)
    mid = (F.col("high") + F.col("low")) / 2
    ao = _full(F.avg(mid), mid, w, short) - _full(F.avg(mid), mid, w, long)
    out = px.withColumn("ao", ao)
    return out.withColumn("ao_color", F.when(F.col("ao").isNotNull(), F.when(F.col("ao") >= F.lag("ao").over(w), 1).otherwise(-1)))


def held(entry: Column, leave: Column, w: WindowSpec) -> Column:
    """1 from an entry on until a row that leaves; entries win on a row that has both."""
    event = F.when(entry, 1).when(leave, 0)
    return F.coalesce(F.last(event, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))


def _signal(df: DataFrame, entry: Column, leave: Column, w: WindowSpec, name: str, side: int) -> DataFrame:
    """``side`` while held, ``-side`` on the row of the exit, else 0."""
    out = df.withColumn("_pos", held(entry, leave, w))
    return out.withColumn(name, F.when(F.col("_pos") == 1, side).when(F.lag("_pos").over(w) == 1, -side).otherwise(0)).drop("_pos")


def color_signals(colored: DataFrame, four_bar_exit: bool = False, by: tuple[str, ...] = (KEY,)) -> DataFrame:
    """``long_signal`` and ``short_signal`` from ``ao_color``.

    Long: in at colors -1, -1, 1, 1 over four bars, out at one -1 (or at the
    reverse pattern of four). Short is the mirror. Rows before the fifth and the
    last one start nothing and end nothing.
    """
    w = _w(by)
    c = [F.lag("ao_color", k).over(w) if k else F.col("ao_color") for k in (3, 2, 1, 0)]
    n = F.row_number().over(w) - 1
    inside = (n >= 4) & F.lead(F.lit(1)).over(w).isNotNull()
    pattern = lambda p: (c[0] == p[0]) & (c[1] == p[1]) & (c[2] == p[2]) & (c[3] == p[3])
    flags = colored.withColumns({
        "_up": F.coalesce(inside & pattern((-1, -1, 1, 1)), F.lit(False)), "_down": F.coalesce(inside & pattern((1, 1, -1, -1)), F.lit(False)),
        "_red": F.coalesce(inside & (F.col("ao_color") == -1), F.lit(False)), "_green": F.coalesce(inside & (F.col("ao_color") == 1), F.lit(False)),
    })
    out = _signal(flags, F.col("_up"), F.col("_down" if four_bar_exit else "_red"), w, "long_signal", 1)
    out = _signal(out, F.col("_down"), F.col("_up" if four_bar_exit else "_green"), w, "short_signal", -1)
    return out.drop("_up", "_down", "_red", "_green")


def rsi(px: DataFrame, n: int = 14) -> DataFrame:
    """Simple-mean RSI; 100 where there was no loss but a gain, NULL where neither."""
    w = _w()
    d = F.col("_d")
    out = px.withColumn("_d", F.col("close") - F.lag("close").over(w))
    out = out.withColumns({"_g": _full(F.avg(F.greatest(d, F.lit(0.0))), d, w, n), "_l": _full(F.avg(F.greatest(-d, F.lit(0.0))), d, w, n)})
    value = F.when(F.col("_l") == 0, F.when(F.col("_g") > 0, 100.0)).otherwise(100 - 100 / (1 + safe_div("_g", "_l")))
    return out.withColumn("rsi", value).drop("_d", "_g", "_l")


def stoch_rsi(df: DataFrame, n: int = 14, smooth: int = 3) -> DataFrame:
    """``stoch_rsi``: place of the RSI between its extremes; ``stoch_rsi_smoothed``: its mean; full windows only."""
    w = _w()
    r = F.col("rsi")
    low, high = _full(F.min(r), r, w, n), _full(F.max(r), r, w, n)
    out = df.withColumns({"_low": low, "_high": high})
    out = out.withColumn("stoch_rsi", safe_div(r - F.col("_low"), F.col("_high") - F.col("_low"))).drop("_low", "_high")
    return out.withColumn("stoch_rsi_smoothed", _full(F.avg("stoch_rsi"), F.col("stoch_rsi"), w, smooth))


def _with_previous(df: DataFrame, indicator: str) -> DataFrame:
    """``_prev``: the row before; for the first row the last one (as an index of -1 has it)."""
    w = _w()
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("_prev", F.when(F.row_number().over(w) == 1, F.last(indicator).over(whole)).otherwise(F.lag(indicator).over(w)))


def crossing_signals(df: DataFrame, indicator: str = "stoch_rsi_smoothed", low: float = 0.2, high: float = 0.8) -> DataFrame:
    """Long: in when the indicator rises through ``low``, out when it falls through ``high``; short is the mirror."""
    x, p, w = F.col(indicator), F.col("_prev"), _w()
    up, down = F.coalesce((p < low) & (x > low), F.lit(False)), F.coalesce((p > high) & (x < high), F.lit(False))
    return _signal(_signal(_with_previous(df, indicator), up, down, w, "long_signal", 1), down, up, w, "short_signal", -1).drop("_prev")


def level_signals(df: DataFrame, indicator: str = "stoch_rsi_smoothed", long: float = 0.2, long_close: float = 0.8, short: float = 0.8, short_close: float = 0.2) -> DataFrame:
    """Long: in when the indicator falls through ``long``, out above ``long_close``; short: in when it rises through ``short``, out below ``short_close``."""
    x, p, w = F.col(indicator), F.col("_prev"), _w()
    no = lambda c: F.coalesce(c, F.lit(False))
    out = _signal(_with_previous(df, indicator), no((p > long) & (x < long)), no(x > long_close), w, "long_signal", 1)
    return _signal(out, no((p < short) & (x > short)), no(x < short_close), w, "short_signal", -1).drop("_prev")


def trades(px: DataFrame, fees: float = -0.00045, net: bool = False, by: tuple[str, ...] = (KEY,)) -> DataFrame:
    """Closed trades of both sides with ``trade_return``, ``total_return`` and ``total_return_index``.

    A trade opens on the first bar of a signal (never on the first row) and
    closes on the bar of the opposite one. The index chains trade returns, or
    returns with fees if ``net``; trades of one time stand long before short.
    """
    w = _w(by)
    n = F.row_number().over(w)
    mark = lambda c, s: F.when(n == 1, 0).when((F.col(c) == s) & (F.lag(c).over(w) == 0), 1).when(F.col(c) == -s, -1).otherwise(0)
    marked = px.withColumns({"long_trade": mark("long_signal", 1), "short_trade": mark("short_signal", -1)})
    sides = []
    for column, sign, order in (("long_trade", 1, 0), ("short_trade", -1, 1)):
        rows = marked.where(F.col(column) != 0).withColumn("trade_return", (safe_div("close", F.lag("close").over(w)) - 1) * sign)
        sides.append(rows.where(F.col(column) == -1).withColumn("_side", F.lit(order)))
    both = sides[0].unionByName(sides[1]).withColumn("total_return", F.col("trade_return") + fees)
    r = F.col("total_return" if net else "trade_return")
    so_far = Window.partitionBy(*by).orderBy(TIME, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("total_return_index", F.when(r.isNotNull(), 100 * F.product(1 + r).over(so_far))).withColumn("side", F.when(F.col("_side") == 0, "long").otherwise("short")).drop("_side")


def equity_curve(px: DataFrame, closed: DataFrame) -> DataFrame:
    """Bars with the index of trades closed so far; 100 on the first bar."""
    per_bar = closed.groupBy(KEY, TIME).agg(F.product(1 + F.coalesce("trade_return", F.lit(0.0))).alias("_step"))
    w = _w()
    out = px.join(per_bar, [KEY, TIME], "left").withColumn("_step", F.when(F.row_number().over(w) == 1, 100.0).otherwise(F.coalesce("_step", F.lit(1.0))))
    return out.withColumn("total_return_index", F.product("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def in_windows(px: DataFrame, days: int = 5, start: str | None = None) -> DataFrame:
    """Bars with the windows (``window_start``, ``window_end``) that hold them; a bar on a shared bound is in both.

    The windows of a bar follow from its time, so nothing is joined.
    """
    if start is None:
        first = F.min(F.col(TIME).cast("date")).over(Window.partitionBy(KEY))
    else:
        first = F.lit(start).cast("date")
    rows = px.withColumn("_first", first)
    i = F.floor(F.datediff(TIME, "_first") / days).cast("int")
    begin = lambda k: F.date_add("_first", k * days)
    on_bound = (F.col(TIME) == begin(i).cast(px.schema[TIME].dataType)) & (i > 0)
    rows = rows.withColumn("_i", i).withColumn("_k", F.explode(F.when(on_bound, F.array(i - 1, i)).otherwise(F.array(i)))).where("_k >= 0")
    return rows.withColumns({"window_start": begin(F.col("_k")), "window_end": begin(F.col("_k") + 1)}).drop("_first", "_i", "_k")


def windowed_backtest(signals: DataFrame, days: int = 5, start: str | None = None, fees: float = -0.00045) -> DataFrame:
    """(symbol, window_start, window_end, trades, final_index) of every window in which a trade closed."""
    by = (KEY, "window_start", "window_end")
    closed = trades(in_windows(signals, days, start), fees, by=by)
    return closed.groupBy(*by).agg(F.count("*").alias("trades"), F.max_by("total_return_index", F.struct(TIME, F.col("side") == "short")).alias("final_index"))


def unfinished_from(results: DataFrame, days: int = 5) -> DataFrame:
    """(symbol, restart): where a running backtest goes on: the start of a last window that is short, else its end."""
    last = results.groupBy(KEY).agg(F.max_by(F.struct("window_start", "window_end"), "window_end").alias("w"))
    short = F.datediff("w.window_end", "w.window_start") < days
    return last.select(KEY, F.when(short, F.col("w.window_start")).otherwise(F.col("w.window_end")).alias("restart"))


def sweep(px: DataFrame, pairs: list[tuple[int, int]], fees: float = -0.00045) -> DataFrame:
    """(symbol, short, long, trades, final_index) of every parameter pair, in one plan.

    Each distinct length's mean is one window column over the same exchange and
    sort; the pairs are then stacked, and (symbol, short, long) is the key of
    everything after.
    """
    w = _w()
    mid = (F.col("high") + F.col("low")) / 2
    lengths = sorted({n for p in pairs for n in p})
    means = px.select("*", *[_full(F.avg(mid), mid, w, n).alias(f"_m{n}") for n in lengths])
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("short"), F.lit(n).alias("long"), (F.col(f"_m{s}") - F.col(f"_m{n}")).alias("ao")) for s, n in pairs])).alias("p")
    by = (KEY, "short", "long")
    g = _w(by)
    stacked = means.select(*px.columns, each).select(*px.columns, "p.*")
    colored = stacked.withColumn("ao_color", F.when(F.col("ao").isNotNull(), F.when(F.col("ao") >= F.lag("ao").over(g), 1).otherwise(-1)))
    closed = trades(color_signals(colored, by=by), fees, by=by)
    return closed.groupBy(*by).agg(F.count("*").alias("trades"), F.max_by("total_return_index", F.struct(TIME, F.col("side") == "short")).alias("final_index"))


def best_parameters(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The pair of the greatest final index (of equals the smallest)."""
    best = F.max_by(F.struct("short", "long", "final_index"), F.struct("final_index", -F.col("short"), -F.col("long"))).alias("b")
    return (results.groupBy(*by) if by else results.groupBy()).agg(best).select(*(by or []), "b.*")
