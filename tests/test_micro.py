"""Micro-fixtures with hand-computed answers."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barline import functions as fn
from barline.functions import ranks as rk
from barline.operators import bars, portfolio, relational, signals
from barline.operators import features as ft


def col(df, name, *order):
    return [r[name] for r in df.orderBy(*order).collect()]


def near(a, b, eps=1e-9):
    return len(a) == len(b) and all((x is None and y is None) or (x is not None and y is not None and abs(x - y) < eps) for x, y in zip(a, b, strict=True))


D = [date(2024, m, 1) for m in range(1, 8)]


def test_returns_turnover_and_index(spark):
    rows = [(D[0], "A", 0.10), (D[0], "B", 0.0), (D[1], "A", 0.02), (D[1], "C", 0.04), (D[2], "C", None), (D[2], "D", None)]
    r = portfolio.period_returns(spark.createDataFrame(rows, "date date, ticker string, next_month_return double"), 0.01)
    assert near(col(r, "next_month_return", "date"), [0.05, 0.03, 0.0])
    assert col(r, "turnover", "date") == [1, 1, None]
    assert near(col(r, "trade_costs", "date"), [0.0002, 0.0002, None])
    assert near(col(r, "total_return", "date"), [0.0498, 0.0298, None])
    assert near(col(r, "total_return_idx", "date"), [100, 102.98, None])


COLORS = [-1, -1, -1, -1, 1, 1, 1, -1, 1, 1]


def colored(spark, colors, close=None):
    t = datetime(2024, 1, 1)
    rows = [("s", t + timedelta(minutes=i), c, float((close or [1] * len(colors))[i])) for i, c in enumerate(colors)]
    return spark.createDataFrame(rows, "symbol string, time_close timestamp_ntz, ao_color int, close double")


def test_color_signals(spark):
    assert col(signals.color_signals(colored(spark, COLORS)), "long_signal", "time_close") == [0, 0, 0, 0, 0, 1, 1, -1, 0, 0]
    assert col(signals.color_signals(colored(spark, COLORS), True), "long_signal", "time_close") == [0, 0, 0, 0, 0, 1, 1, 1, 1, 1]


def test_trades(spark):
    t = signals.trades(signals.color_signals(colored(spark, COLORS, [10, 10, 10, 10, 10, 10, 11, 12, 12, 12]))).where("side = 'long'").collect()
    assert len(t) == 1 and abs(t[0].trade_return - 0.2) < 1e-12 and abs(t[0].total_return_index - 120) < 1e-9


def loop(colors, four):
    """The state machine written as a loop over bars."""
    n, out = len(colors), {"long": [0] * len(colors), "short": [0] * len(colors)}
    for side, s in (("long", 1), ("short", -1)):
        sig = out[side]
        for i in range(4, n - 1):
            last = [s * c for c in colors[i - 3 : i + 1]]
            if last == [-1, -1, 1, 1]:
                sig[i:] = [s] * (n - i)
            elif sig[i - 1] == s and (last == [1, 1, -1, -1] if four else last[-1] == -1):
                sig[i] = -s
                sig[i + 1 :] = [0] * (n - i - 1)
    return out


@pytest.mark.parametrize("four", [False, True])
def test_signals_are_those_of_a_loop(spark, four):
    r, rows = random.Random(9), []
    runs = [[r.choice([-1, 1]) for _ in range(r.randrange(5, 30))] for _ in range(150)]
    for k, run in enumerate(runs):
        rows += [(f"s{k:03d}", datetime(2024, 1, 1) + timedelta(minutes=i), c) for i, c in enumerate(run)]
    got = signals.color_signals(spark.createDataFrame(rows, "symbol string, time_close timestamp_ntz, ao_color int"), four).orderBy("symbol", "time_close").collect()
    at = 0
    for run in runs:
        part, want = got[at : at + len(run)], loop(run, four)
        at += len(run)
        assert [x.long_signal for x in part] == want["long"] and [x.short_signal for x in part] == want["short"]


def test_ranks(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, 5.0)], "i int, x double").withColumn("d", F.lit(1))
    assert near(col(df.withColumn("r", rk.pct_rank("x", ["d"])), "r", "i"), [0.25, 0.625, 0.625, 1])
    assert near(col(df.withColumn("r", rk.sql_percent_rank("x", ["d"], False)), "r", "i"), [0, 1 / 3, 1 / 3, 1])
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, 10.0), (5, None)], "i int, x double").withColumn("d", F.lit(1))
    assert col(df.withColumn("b", rk.quantile_bin("x", ["d"])), "b", "i") == [1, 2, 4, 5, None]
    assert col(df.withColumn("r", rk.guarded_rank("x", ["d"])), "r", "i") == [4, 3, 2, 1, None]


def test_rolling_means_and_changes(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(1, 5)], "k string, i int, x double")
    out = ft.with_features(df, "k", "i", [ft.Feature("m", "mean", "x", 3), ft.Feature("f", "mean", "x", 3, full=True)])
    assert near(col(out, "m", "i"), [1, 1.5, 2, 3]) and near(col(out, "f", "i"), [None, None, 2, 3])
    df = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 10.0), ("a", 3, 11.0)], "k string, i int, x double")
    assert near(col(ft.with_features(df, "k", "i", [ft.Feature("p", "pct", "x", digits=6)]), "p", "i"), [None, None, 0.1])


def test_scalars(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([-0.5, -0.1, -0.05, 0.0, 2.0, float("nan"), float("-inf")])], "i int, x double")
    assert near(col(df.where("i < 5").withColumn("y", fn.clip_below("x", -0.1)), "y", "i"), [None, None, -0.05, 0, 2])
    assert col(df.withColumn("y", fn.inf_to_null("x")), "y", "i")[5:] == [None, None]
    days = spark.createDataFrame([(date(2024, 1, 7),), (date(2024, 1, 3),)], "d date")
    out = days.select("d", fn.week_start("d").alias("s"), fn.week_end("d").alias("e"), fn.week_end("d", True).alias("b")).orderBy("d").collect()
    assert [(r.s, r.e, r.b) for r in out] == [(date(2024, 1, 1), date(2024, 1, 5), date(2024, 1, 5)), (date(2024, 1, 1), date(2024, 1, 5), date(2024, 1, 12))]


def test_low_turnover(spark):
    lists = {0: "ABCD", 1: "CBDA", 2: "CDB"}
    rows = [("m", D[k], t, float(-i)) for k, ts in lists.items() for i, t in enumerate(ts)]
    out = portfolio.low_turnover(spark.createDataFrame(rows, "model_id string, date date, ticker string, pred double"), 2, 4).collect()
    held = {}
    for r in out:
        held.setdefault(r.date, set()).add(r.ticker)
    assert [held[D[k]] for k in range(3)] == [{"A", "B"}, {"A", "B"}, {"B", "C"}]


def test_sticky_keeps_51_by_default_rule_of_callers(spark):
    rows = [("m", d, f"t{i:03d}", float((i * 37 + k * 11) % 200)) for k, d in enumerate(D[:3]) for i in range(200)]
    df = spark.createDataFrame(rows, "model_id string, date date, ticker string, pred double")
    out = portfolio.sticky(df, 51, 101, first=50)
    assert [r["count"] for r in out.groupBy("date").count().orderBy("date").collect()] == [50, 51, 51]
    assert out.where("held").count() > 0


def test_performance(spark):
    rows = [(D[i], r, x) for i, (r, x) in enumerate([(0.01, 100.0), (0.02, 102.0), (-0.03, 98.94), (0.04, 102.8976), (None, None)])]
    df = spark.createDataFrame(rows, "date date, total_return double, total_return_idx double")
    s = portfolio.performance(df, 0, end_back=2).first()
    assert abs(s.return_all - 0.028976) < 1e-9 and abs(s.std_all - 0.10198) < 1e-5 and abs(s.sharpe_all - 1.1767) < 1e-4
    assert s.drawdown_all == -0.03 and s.drawdown_date_all == D[2] and abs(s.peak_to_trough_all - (98.94 / 102 - 1)) < 1e-12


def test_crossover_and_ffill(spark):
    df = spark.createDataFrame([(1, 3.0, 1.0), (2, 1.0, 2.0), (3, None, 1.0)], "i int, a double, b double")
    assert col(ft.gaps_and_crossovers(df, {"x": ("a", "b")}), "cross_x", "i") == [-2, -999, -999]
    df = spark.createDataFrame([("t", i, x) for i, x in enumerate([None, 1.0, None, 3.0])], "k string, i int, x double")
    assert col(relational.group_ffill(df, "k", "i", ["x"]), "x", "i") == [None, 1, 1, 3]


def test_grid_has_no_nested_loop(spark):
    rows = [("a", datetime(2024, 1, 1, 5)), ("b", datetime(2024, 1, 2, 1)), ("a", datetime(2024, 1, 3, 2))]
    df = spark.createDataFrame(rows, "id string, ts timestamp_ntz")
    grid = bars.key_grid(df, df)
    assert sorted((r.id, r.ts.day) for r in grid.collect()) == [("a", 1), ("a", 2), ("a", 3), ("b", 2), ("b", 3)]


def test_windows_share_their_bounds(spark):
    t = [datetime(2024, 1, 1, 6), datetime(2024, 1, 6), datetime(2024, 1, 8)]
    df = spark.createDataFrame([("s", x) for x in t], "symbol string, time_close timestamp_ntz")
    got = sorted((r.time_close, r.window_start) for r in signals.in_windows(df).collect())
    assert got == [(t[0], date(2024, 1, 1)), (t[1], date(2024, 1, 1)), (t[1], date(2024, 1, 6)), (t[2], date(2024, 1, 6))]


def test_upserts_profiles_and_draws(spark):
    base = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    new = spark.createDataFrame([(2, 9.0), (3, 3.0)], "k int, v double")
    assert sorted(map(tuple, relational.upsert(base, new, ["k"]).collect())) == [(1, 1), (2, 9), (3, 3)]
    assert sorted(map(tuple, relational.insert_new(base, new, ["k"]).collect())) == [(1, 1), (2, 2), (3, 3)]
    assert relational.sample_draws(spark.createDataFrame([(c,) for c in "abcdef"], "variable string"), 5, 3).groupBy("draw").count().where("count = 3").count() == 5
    corr = spark.createDataFrame([("a", "b", 0.95), ("b", "c", 0.1)], "var_1 string, var_2 string, corr double")
    imp = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "variable string, importance double")
    assert {r.variable for r in relational.prune_correlated(corr, imp).collect()} == {"b", "c"}
