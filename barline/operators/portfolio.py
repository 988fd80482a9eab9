"""Ranks combined into portfolios, returns with turnover costs, performance statistics, orders.

A portfolio has a row a date before it is chained or summed up; where no key is
given, that series is one window, of as many rows as there are dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.columns import safe_div, stable_round
from barline.functions.ranks import average_rank


def combo_rank(df: DataFrame, columns: list[str], skip_missing: bool = False, name: str = "combo_rank") -> DataFrame:
    """Mean of rank columns: NULL if any is missing, or over those present."""
    if skip_missing:
        n = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
        return df.withColumn(name, safe_div(sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0)), n))
    return df.withColumn(name, sum((F.col(c) for c in columns), F.lit(0.0)) / len(columns))


def top_n(df: DataFrame, score: str, n: int, by: list[str], tie: str, descending: bool = False) -> DataFrame:
    """The n best rows of each group with a score; equal ones by ``tie``."""
    order = F.desc(score) if descending else F.asc(score)
    return df.where(F.col(score).isNotNull()).withColumn("ptf_rank", F.row_number().over(Window.partitionBy(*by).orderBy(order, tie))).where(F.col("ptf_rank") <= n).withColumn("ptf_rank", F.col("ptf_rank").cast("long"))


def top_percentile(df: DataFrame, score: str, cutoff: float, most: int, by: list[str], tie: str, descending: bool = False) -> DataFrame:
    """Rows up to a percentile of their group's scores, at most ``most`` of them."""
    order = F.desc(score) if descending else F.asc(score)
    scored = df.where(F.col(score).isNotNull()).withColumn("percentile_rank", F.percent_rank().over(Window.partitionBy(*by).orderBy(order)))
    kept = scored.where(F.col("percentile_rank") <= cutoff)
    return kept.withColumn("ptf_count", F.row_number().over(Window.partitionBy(*by).orderBy("percentile_rank", tie)).cast("long")).where(F.col("ptf_count") <= most)


def merge_sleeves(sleeves: DataFrame, limited: str, most: int = 10, cap: int = 50) -> DataFrame:
    """Strategies (date, ticker, strategy, pred) merged into one portfolio a date.

    Dense rank by prediction; rows of the ``limited`` strategy ranked above the
    cap but beyond its ``most`` best go; ranked anew and cut at the cap.
    """
    best = F.desc("pred")
    ranked = sleeves.withColumns({
        "rank": F.dense_rank().over(Window.partitionBy("date").orderBy(best)),
        "strat_rank": F.row_number().over(Window.partitionBy("date", "strategy").orderBy(best, "ticker")).cast("long"),
    })
    kept = ranked.where(~((F.col("rank") < cap) & (F.col("strategy") == limited) & (F.col("strat_rank") > most)))
    return kept.withColumn("rank", F.dense_rank().over(Window.partitionBy("date").orderBy(best)).cast("long")).where(F.col("rank") <= cap)


def sticky(candidates: DataFrame, keep: int, pool: int | None = None, threshold: float | None = None, model: str = "model_id", first: int | None = None) -> DataFrame:
    """Portfolios that hold on to what they have: (model_id, date, ticker, pred, held).

    Each date's candidates are the ``pool`` best by ``pred``; with a threshold,
    those at least at min(threshold, the pool's last prediction). Previous
    holdings among them come first, then the best others, up to ``keep``
    (``first`` on the first date). Membership depends on the date before, so a
    model's dates are folded in order, in one row of arrays; ``pool`` names a
    date reach it, with a threshold all those above it. Models run side by side.
    """
    pool = pool or keep
    w = Window.partitionBy(model, "date").orderBy(F.desc("pred"), "ticker")
    ranked = candidates.where("pred is not null").withColumn("_n", F.row_number().over(w))
    if threshold is None:
        cut = ranked.where(F.col("_n") <= pool)
    else:
        floor = F.least(F.lit(threshold), F.min(F.when(F.col("_n") <= pool, F.col("pred"))).over(Window.partitionBy(model, "date")))
        cut = ranked.withColumn("_floor", floor).where(F.col("pred") >= F.col("_floor"))
    return _in_order(cut.select(F.col(model).alias("model_id"), "date", "ticker", "pred"), keep, first or keep)


def low_turnover(lists: DataFrame, keep: int, listed: int, model: str = "model_id") -> DataFrame:
    """Holdings that stay while they are among the ``listed`` best, filled up with the best new ones to ``keep``."""
    return sticky(lists, keep, listed, model=model)


def _in_order(rows: DataFrame, keep: int, first: int) -> DataFrame:
    """Dates folded in order, a model's in one row: each date's candidates as an array, the names held as the state."""
    names = rows.groupBy("model_id", "date").agg(F.sort_array(F.collect_list(F.struct((-F.col("pred")).alias("n"), "ticker"))).alias("c"))
    days = names.groupBy("model_id").agg(F.sort_array(F.collect_list(F.struct("date", "c"))).alias("days"))
    kind = "struct<held:array<string>, out:array<struct<date:date, picked:array<struct<n:double, ticker:string>>, before:array<string>>>>"

    def step(state: Column, day: Column) -> Column:
        has = lambda c: F.array_contains(state["held"], c["ticker"])
        ordered = F.concat(F.filter(day["c"], has), F.filter(day["c"], lambda c: ~has(c)))
        picked = F.slice(ordered, 1, F.when(F.size(state["out"]) > 0, keep).otherwise(first))
        done = F.struct(day["date"].alias("date"), picked.alias("picked"), state["held"].alias("before"))
        return F.struct(picked["ticker"].alias("held"), F.concat(state["out"], F.array(done)).alias("out")).cast(kind)

    start = F.struct(F.array().cast("array<string>").alias("held"), F.array().alias("out")).cast(kind)
    folded = days.select("model_id", F.explode(F.aggregate("days", start, step, lambda s: s["out"])).alias("d"))
    each = folded.select("model_id", "d.date", "d.before", F.explode("d.picked").alias("p"))
    return each.select("model_id", "date", F.col("p.ticker").alias("ticker"), (-F.col("p.n")).alias("pred"), F.array_contains("before", F.col("p.ticker")).alias("held"))


def period_returns(ptf: DataFrame, cost: float, by: list[str] | None = None, ret: str = "next_month_return", names: int = 50, ticker: str = "ticker") -> DataFrame:
    """Equal-weight return, turnover, costs and the chained index of each portfolio and date.

    Turnover counts the next date's names that are new, and stands on the date
    before; the last date has none, so its total return and index are NULL. The
    index is 100 on the first date and chains total returns from the second on.
    The portfolio is read once: a date's names are one set, of a portfolio's
    size, and meet the next date's in a window.
    """
    by = by or []
    return chained_returns(ptf.groupBy(*by, "date").agg(F.coalesce(F.avg(ret), F.lit(0.0)).alias(ret), F.collect_set(ticker).alias("_names")), cost, by, ret, names)


def chained_returns(held: DataFrame, cost: float, by: list[str], ret: str = "next_month_return", names: int = 50) -> DataFrame:
    """``period_returns`` of portfolios that are a row a date already: their mean return, and their names as ``_names``."""
    following = F.lead("_names").over(Window.partitionBy(*by).orderBy("date") if by else Window.partitionBy(F.lit(0)).orderBy("date"))
    new = held.withColumn("_new", F.array_except(following, "_names"))
    out = new.withColumn("turnover", F.when(F.col("_new").isNotNull(), F.size("_new").cast("long"))).drop("_names", "_new")
    out = out.withColumn("trade_costs", F.col("turnover") / names * cost).withColumn("total_return", F.col(ret) - F.col("trade_costs"))
    return chained_index(out, by, "total_return")


def chained_index(df: DataFrame, by: list[str], ret: str, name: str | None = None, start: float = 100.0) -> DataFrame:
    """``start`` on the first row, then times 1 + return; NULL where the return is."""
    w = Window.partitionBy(*by).orderBy("date") if by else Window.partitionBy(F.lit(0)).orderBy("date")
    step = F.when(F.row_number().over(w) > 1, 1 + F.col(ret)).otherwise(F.lit(1.0))
    staged = df.withColumn("_step", step).withColumn("_rn", F.row_number().over(w))
    index = start * F.product("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return staged.withColumn(name or f"{ret}_idx", F.when((F.col("_rn") == 1) | F.col(ret).isNotNull(), index)).drop("_step", "_rn")


def performance(returns: DataFrame, start: int, end_back: int = 2, by: list[str] | None = None, years: float | None = None, per_year: int = 12) -> DataFrame:
    """Statistics over rows start..end (0-based, both included; end counts from the last row by ``end_back``) and over 0..end.

    For each of the two periods: total return, annual standard deviation,
    Sharpe ratio, worst single-period return with its first date ("drawdown"),
    and the true peak-to-trough drawdown of the index.
    """
    by = by or []
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    rows = returns.withColumn("_i", F.row_number().over(w.orderBy("date")) - 1).withColumn("_end", F.count("*").over(w) - end_back)
    begin = F.greatest(F.col("_end") - int(per_year * years), F.lit(0)) if years is not None else F.lit(start)
    rows = rows.where("_i <= _end").withColumn("_start", begin)
    peak = F.max("total_return_idx").over(w.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_dd", F.col("total_return_idx") / peak - 1)

    def stats(period: str, inside: Column) -> list[Column]:
        r = F.when(inside, F.col("total_return"))
        at = F.when(inside, F.col("_i"))
        std = F.stddev_samp(r) * F.sqrt(F.lit(float(per_year)))
        return [
            (F.max_by("total_return_idx", at) / F.min_by("total_return_idx", at) - 1).alias(f"return_{period}"), std.alias(f"std_{period}"), safe_div(F.avg(r) * per_year, std).alias(f"sharpe_{period}"),
            F.min(r).alias(f"drawdown_{period}"), F.min_by("date", F.when(inside & F.col("total_return").isNotNull(), F.struct("total_return", "_i"))).alias(f"drawdown_date_{period}"), F.min(F.when(inside, F.col("_dd"))).alias(f"peak_to_trough_{period}"),
        ]

    return rows.groupBy(*by).agg(*stats("period", F.col("_i") >= F.col("_start")), *stats("all", F.lit(True)))


def performance_v2(returns: DataFrame, years: list[float], by: list[str] | None = None, per_year: int = 12) -> DataFrame:
    """For each look-back the mean of its period over the deviation of the whole (sic), long over ``lookback``."""
    by = by or []
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    rows = returns.withColumn("_i", F.row_number().over(w.orderBy("date")) - 1).withColumn("_end", F.count("*").over(w) - 2).where("_i <= _end")
    aggs = [(F.stddev_samp("total_return") * F.sqrt(F.lit(float(per_year)))).alias("std_all")]
    for i, y in enumerate(years):
        inside = F.col("_i") >= F.col("_end") - int(per_year * y)
        r, at = F.when(inside, F.col("total_return")), F.when(inside, F.col("_i"))
        aggs += [F.avg(r).alias(f"_m{i}"), F.min(r).alias(f"_d{i}"), (F.max_by("total_return_idx", at) / F.min_by("total_return_idx", at) - 1).alias(f"_r{i}"), (F.stddev_samp(r) * F.sqrt(F.lit(float(per_year)))).alias(f"_s{i}")]
    one = rows.groupBy(*by).agg(*aggs)
    each = F.explode(F.array(*[F.struct(F.lit(float(y)).alias("lookback"), F.col(f"_r{i}").alias("total_return"), F.col(f"_s{i}").alias("std"), safe_div(F.col(f"_m{i}") * per_year, "std_all").alias("sharpe"), F.col(f"_d{i}").alias("drawdown")) for i, y in enumerate(years)])).alias("s")
    return one.select(*by, each).select(*by, "s.*")


def stats_long(wide: DataFrame, by: list[str], fields: list[str], period: str) -> DataFrame:
    """(field, value, period) rows of a wide row of statistics."""
    return wide.select(*by, *fields).unpivot(by, fields, "field", "value").withColumn("period", F.lit(period))


def joined_sweep(ranks: DataFrame, combos: DataFrame, n: int, cost: float, ret: str = "next_month_return", most_missing: int = 0) -> DataFrame:
    """Portfolio returns of every combination by a plain join: for few combinations; ``sweep.combo_sweep`` shuffles n names a combination and date.

    ``ranks``: long (date, ticker, variable, rank); ``combos``: (model_id,
    var_1..). Ranks meet the combinations on the variable and are averaged by
    (model, date, ticker), before top-N and returns by model.
    """
    vars_ = [c for c in combos.columns if c.startswith("var_")]
    members = combos.select("model_id", F.explode(F.array(*vars_)).alias("variable"))
    mean = ranks.join(members, "variable").groupBy("model_id", "date", "ticker").agg(F.count("rank").alias("_n"), F.avg("rank").alias("combo_rank"), F.first(ret, True).alias(ret))
    full = mean.where(F.col("_n") >= len(vars_) - most_missing)
    return period_returns(top_n(full, "combo_rank", n, ["model_id", "date"], "ticker"), cost, ["model_id"], ret)


def long_ranks(df: DataFrame, variables: list[str], ret: str, descending: bool = True) -> DataFrame:
    """(date, ticker, variable, rank, ret): mean ranks of all variables by one window over (variable, date)."""
    long = df.select("date", "ticker", ret, F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in variables])).alias("s")).select("date", "ticker", ret, "s.variable", "s.value")
    return long.withColumn("rank", average_rank("value", ["variable", "date"], descending)).where("rank is not null").drop("value")


def best_trailing(returns: DataFrame, lookback: int, by: str = "model_id", index: str = "total_return_idx") -> DataFrame:
    """For each date the model of the greatest index growth over the rows before, and its own return then."""
    w = Window.partitionBy(by).orderBy("date")
    trail = safe_div(F.lag(index, 1).over(w), F.lag(index, lookback).over(w)) - 1
    rows = returns.withColumn("lookback_return", stable_round(trail, 9)).where("lookback_return is not null")
    n = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("lookback_return"), by))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def order_diff(target: DataFrame, held: DataFrame, key: str = "ticker") -> DataFrame:
    """Trades from held to target quantities: (key, new, old, trade, side)."""
    both = target.select(key, F.col("qty").alias("new")).join(held.select(key, F.col("qty").alias("old")), key, "full").fillna(0, ["new", "old"])
    trade = both.withColumn("trade", F.col("new") - F.col("old"))
    return trade.withColumn("side", F.when(F.col("trade") > 0, "buy").when(F.col("trade") < 0, "sell").otherwise("hold"))


def sizing(px: DataFrame, cash: float, names: int = 50, stop: float = 0.85, take: float = 1.2) -> DataFrame:
    """Equal cash for each name: quantity, stop and take-profit prices."""
    return px.withColumns({"target": F.lit(cash / names), "qty": stable_round(safe_div(F.lit(cash / names), "px"), 0), "stop_px": stable_round(F.col("px") * stop, 4), "take_px": stable_round(F.col("px") * take, 4)})


def position_action(df: DataFrame, signal: str = "signal", qty: str = "qty", target: str = "target") -> DataFrame:
    """What to do with a position, by the last signal and the quantities held and wanted."""
    s, q, t = F.col(signal), F.col(qty), F.col(target)
    return df.withColumn("action", F.when((s == 1) & (q == 0), "open").when((s != 1) & (q > 0), "close").when((s == 1) & (q < t), "add").when((s == 1) & (q > t), "cut").otherwise("none"))
