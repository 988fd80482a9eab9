"""Queries: lags, rolling features, long-table features, windows of values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.functions.columns import stable_round
from barline.operators import features as ft
from barline.operators.bars import period_close
from barline.plans.bars import days, months, weekly
from barline.plans.registry import query, view
from barline.sources import canonical as src

DAY_LAGS, MONTH_LAGS = [1, 2, 3, 5, 10, 28, 56], [1, 2, 3, 6, 12, 18]
_W = "OVER (PARTITION BY id ORDER BY date)"
_M = "OVER (PARTITION BY ticker ORDER BY date)"


def rounded(df: DataFrame, digits: int = 6, *keep: str) -> DataFrame:
    """Doubles rounded, other columns as they are."""
    return df.select(*[stable_round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def _roll(f: str, col: str, n: int, by: str = "id", order: str = "date") -> str:
    return f"{f}({col}) OVER (PARTITION BY {by} ORDER BY {order} ROWS {n - 1} PRECEDING)"


view("day_returns", "SELECT *, " + ", ".join([f"lag({b}, {n}) {_W} AS {b}_l{n}d" for b in ("px_close", "px_avg", "volume") for n in DAY_LAGS] + [f"round({b} / nullif(lag({b}, {n}) {_W}, 0) - 1, 6) AS {b}_pct_{n}d" for b in ("px_close", "px_avg", "volume") for n in DAY_LAGS]) + " FROM {{days}}")
view("day_px", "SELECT id, date, px_close, px_avg, marketcap, volume, px_close_pct_1d AS px_pct_1d, px_close_pct_3d AS px_pct_3d, px_close_pct_5d AS px_pct_5d, px_close_pct_10d AS px_pct_10d, px_avg_pct_1d FROM {{day_returns}} WHERE px_close_pct_1d < 100")
MOM = [f"{_roll('avg', 'px_pct_1d', n)} AS px_momentum_{n}d" for n in (3, 5, 10)] + [f"{_roll('stddev_samp', 'px_pct_1d', n)} AS px_vol_{n}d" for n in (5, 10, 14, 28, 56)]
view("day_mom", f"SELECT *, {', '.join(MOM)}, lead(px_pct_1d) {_W} AS next_return FROM {{{{day_px}}}}")
view("month_returns", "SELECT ticker, date, px_close, px_close_avg, volume, " + ", ".join([f"round(px_close / nullif(lag(px_close, {n}) {_M}, 0) - 1, 6) AS px_pct_{n}m" for n in MONTH_LAGS] + [f"round(px_close_avg / nullif(lag(px_close_avg, {n}) {_M}, 0) - 1, 6) AS px_avg_pct_{n}m" for n in (1, 3, 6, 12, 18)]) + " FROM {{months}}")


def day_returns(spark: SparkSession, d: str) -> DataFrame:
    return ft.returns(days(spark, d), "id", "date", dict.fromkeys(("px_close", "px_avg", "volume"), DAY_LAGS), "d")


def day_px(spark: SparkSession, d: str) -> DataFrame:
    r = ft.drop_outliers(day_returns(spark, d), "px_close_pct_1d")
    return r.select("id", "date", "px_close", "px_avg", "marketcap", "volume", *[F.col(f"px_close_pct_{n}d").alias(f"px_pct_{n}d") for n in (1, 3, 5, 10)], "px_avg_pct_1d")


def day_mom(spark: SparkSession, d: str) -> DataFrame:
    return ft.momentum(day_px(spark, d), "id", "date", "px_pct_1d", [3, 5, 10], [5, 10, 14, 28, 56], "d")


def month_returns(spark: SparkSession, d: str) -> DataFrame:
    m = months(spark, d).select("ticker", "date", "px_close", "px_close_avg", "volume")
    specs = [ft.Feature(f"px_pct_{n}m", "pct", "px_close", n, digits=6) for n in MONTH_LAGS] + [ft.Feature(f"px_avg_pct_{n}m", "pct", "px_close_avg", n, digits=6) for n in (1, 3, 6, 12, 18)]
    return ft.with_features(m, "ticker", "date", specs)


@query("SELECT * FROM {{day_returns}}")
def returns_lags(spark: SparkSession, d: str) -> DataFrame:
    return day_returns(spark, d)


@query("SELECT * FROM {{month_returns}}")
def returns_monthly(spark: SparkSession, d: str) -> DataFrame:
    return month_returns(spark, d)


HOUR_LAGS = [24, 48, 72, 120]
_H = "OVER (PARTITION BY id ORDER BY ts)"


@query("SELECT id, ts, round(px, 6) AS px, " + ", ".join([f"round(px / nullif(lag(px, {n}) {_H}, 0) - 1, 5) AS px_pct_{n}h" for n in HOUR_LAGS] + [f"round({_roll('avg', 'px', n, 'id', 'ts')}, 5) AS px_mean_{n}h" for n in (24, 72)] + [f"round(lead(px, {n}) {_H}, 6) AS next_{n}h" for n in (1, 24)]) + " FROM {{hours}}")
def returns_hourly(spark: SparkSession, d: str) -> DataFrame:
    from barline.plans.bars import hours

    specs = [ft.Feature(f"px_pct_{n}h", "pct", "px", n, digits=5) for n in HOUR_LAGS] + [ft.Feature(f"px_mean_{n}h", "mean", "px", n, digits=5) for n in (24, 72)] + [ft.Feature(f"next_{n}h", "lead", "px", n, digits=6) for n in (1, 24)]
    return ft.with_features(hours(spark, d).select("id", "ts", "px"), "id", "ts", specs).withColumn("px", stable_round("px", 6))


@query(", ".join(["SELECT id, date", *[f"round({_roll('avg', 'px_close', n)}, 5) AS px_close_avg_{n}d" for n in (3, 5, 10)]]) + " FROM {{days}}")
def rolling_mean_partial(spark: SparkSession, d: str) -> DataFrame:
    return ft.with_features(days(spark, d).select("id", "date", "px_close"), "id", "date", [ft.Feature(f"px_close_avg_{n}d", "mean", "px_close", n, digits=5) for n in (3, 5, 10)]).drop("px_close")


MEANS = (3, 5, 10, 20, 28)


@query(", ".join(["SELECT id, date", *[f"CASE WHEN row_number() {_W} > {n - 1} THEN round({_roll('avg', 'px_close', n)}, 5) END AS px_close_avg_{n}d" for n in MEANS]]) + " FROM {{days}}")
def rolling_mean_min_hist(spark: SparkSession, d: str) -> DataFrame:
    return ft.with_features(days(spark, d).select("id", "date", "px_close"), "id", "date", [ft.Feature(f"px_close_avg_{n}d", "mean", "px_close", n, full=True, digits=5) for n in MEANS]).drop("px_close")


@query(", ".join(["SELECT ticker, date", *[f"round({_roll('stddev_samp', 'px_pct_1m', n, 'ticker')}, 6) AS px_vol_{n}m" for n in (3, 6, 9, 12, 18)]]) + " FROM {{month_returns}}")
def rolling_vol(spark: SparkSession, d: str) -> DataFrame:
    return ft.with_features(month_returns(spark, d).select("ticker", "date", "px_pct_1m"), "ticker", "date", [ft.Feature(f"px_vol_{n}m", "vol", "px_pct_1m", n, digits=6) for n in (3, 6, 9, 12, 18)]).drop("px_pct_1m")


DIFFS = [f"px_momentum_{n}d" for n in (3, 5, 10)]


@query("SELECT id, date, px_pct_1d, next_return, " + ", ".join([f"round({c}, 6) AS {c}" for c in [*DIFFS, *[f"px_vol_{n}d" for n in (5, 10, 14, 28, 56)]]] + [f"round({c} - lag({c}, 3) {_W}, 6) AS {c}_d3" for c in DIFFS]) + " FROM {{day_mom}}")
def momentum_stack(spark: SparkSession, d: str) -> DataFrame:
    out = ft.change_of(day_mom(spark, d), "id", "date", DIFFS, 3, "_d3")
    return rounded(out.select("id", "date", "px_pct_1d", "next_return", *DIFFS, *[f"px_vol_{n}d" for n in (5, 10, 14, 28, 56)], *[f"{c}_d3" for c in DIFFS]))


VOL_ADJ = {"px_pct_3d_x_vol_14d": ("px_pct_3d", "px_vol_14d"), "px_pct_5d_x_vol_14d": ("px_pct_5d", "px_vol_14d"), "px_pct_10d_x_vol_28d": ("px_pct_10d", "px_vol_28d"), "px_momentum_3d_x_vol_28d": ("px_momentum_3d", "px_vol_28d"), "px_momentum_5d_x_vol_28d": ("px_momentum_5d", "px_vol_28d"), "px_momentum_10d_x_vol_56d": ("px_momentum_10d", "px_vol_56d")}


@query("SELECT id, date, " + ", ".join(f"round({a} / nullif({b}, 0), 5) AS {n}" for n, (a, b) in VOL_ADJ.items()) + " FROM {{day_mom}}")
def vol_adjusted(spark: SparkSession, d: str) -> DataFrame:
    return ft.ratios(day_mom(spark, d), VOL_ADJ, 5).select("id", "date", *VOL_ADJ)


@query(f"""WITH r AS (SELECT *, {_roll('stddev_samp', 'px_pct_1m', 12, 'ticker')} AS vol_12, {_roll('avg', 'px_pct_1m', 3, 'ticker')} AS mom_3, {_roll('avg', 'px_pct_1m', 6, 'ticker')} AS mom_6 FROM {{{{month_returns}}}})
    SELECT ticker, date, round(px_pct_3m / nullif(vol_12, 0), 5) AS px_pct_3m_x_vol, round(px_pct_6m / nullif(vol_12, 0), 5) AS px_pct_6m_x_vol, round(mom_3 / nullif(vol_12, 0), 5) AS px_momentum_3m_x_vol, round(mom_6 / nullif(vol_12, 0), 5) AS px_momentum_6m_x_vol, lead(px_pct_1m) {_M} AS next_month_return FROM r""")
def vol_adjusted_monthly(spark: SparkSession, d: str) -> DataFrame:
    specs = [ft.Feature("vol", "vol", "px_pct_1m", 12), ft.Feature("m3", "mean", "px_pct_1m", 3), ft.Feature("m6", "mean", "px_pct_1m", 6), ft.Feature("next_month_return", "lead", "px_pct_1m", 1)]
    r = ft.with_features(month_returns(spark, d), "ticker", "date", specs)
    made = {"px_pct_3m_x_vol": ("px_pct_3m", "vol"), "px_pct_6m_x_vol": ("px_pct_6m", "vol"), "px_momentum_3m_x_vol": ("m3", "vol"), "px_momentum_6m_x_vol": ("m6", "vol")}
    return ft.ratios(r, made, 5).select("ticker", "date", *made, "next_month_return")


NS = (7, 14, 28)
_DAY = "SELECT *, CASE WHEN px_pct_1d > 0 THEN px_pct_1d END AS up, CASE WHEN px_pct_1d < 0 THEN abs(px_pct_1d) END AS down FROM {{day_px}}"


@query(f"WITH u AS ({_DAY}) SELECT id, date, " + ", ".join(f"CASE WHEN row_number() {_W} > {n - 1} THEN round({_roll('avg', 'up', n)} / {_roll('avg', 'down', n)}, 5) END AS rsi_{n}d" for n in NS) + " FROM u")
def rsi_ratio(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ft.rs_ratio(day_px(spark, d), "id", "date", "px_pct_1d", list(NS)).select("id", "date", *[f"rsi_{n}d" for n in NS]), 5)


view("day_means", "SELECT id, date, px_close, px_avg, px_avg_pct_1d, " + ", ".join(f"CASE WHEN row_number() {_W} > {n - 1} THEN round({_roll('avg', 'px_close', n)}, 5) END AS avg_{n}d" for n in (3, 5, 10, 28)) + " FROM {{day_px}}")
GAPS = {"px_5d": ("px_close", "avg_5d"), "px_10d": ("px_close", "avg_10d"), "3d_28d": ("avg_3d", "avg_28d")}


def day_means(spark: SparkSession, d: str) -> DataFrame:
    return ft.with_features(day_px(spark, d), "id", "date", [ft.Feature(f"avg_{n}d", "mean", "px_close", n, full=True, digits=5) for n in (3, 5, 10, 28)])


@query("SELECT id, date, " + ", ".join([f"round({a} - {b}, 4) AS gap_{n}" for n, (a, b) in GAPS.items()] + [f"round(CASE WHEN {a} - {b} > 0 THEN -1 * ({a} - {b}) ELSE -999 END, 4) AS cross_{n}" for n, (a, b) in GAPS.items()]) + " FROM {{day_means}}")
def mean_gap_crossover(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ft.gaps_and_crossovers(day_means(spark, d), GAPS).select("id", "date", *[f"gap_{n}" for n in GAPS], *[f"cross_{n}" for n in GAPS]), 4)


TREND = {f"trend_{n}d": ("px_avg_pct_1d", f"avg_{n}d") for n in (3, 5, 10, 28)} | {f"reversion_{n}d": (f"avg_{n}d", "px_avg_pct_1d") for n in (3, 5, 10, 28)}


@query("SELECT id, date, " + ", ".join(f"round({a} / nullif({b}, 0) - 1, 4) AS {n}" for n, (a, b) in TREND.items()) + " FROM {{day_means}}")
def trend_meanrev(spark: SparkSession, d: str) -> DataFrame:
    r = ft.ratios(day_means(spark, d), TREND)
    return r.select("id", "date", *[stable_round(F.col(n) - 1, 4).alias(n) for n in TREND])


def _long(kind: str, body: str, ns: list[int]) -> str:
    parts = " UNION ALL ".join(f"SELECT ticker, date_start, date_end, 'closeadj_close_{kind}_{n}w' AS field, {body.format(n=n, p=n - 1)} AS value FROM {{{{weekly_close}}}}" for n in ns)
    return parts.replace("closeadj_close_l_", "closeadj_close_l")


_L = "OVER (PARTITION BY ticker ORDER BY date_start)"


def _weekly_long(kind: str, ns: list[int], digits: int):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return ft.long_change(period_close(src.prices(spark, d), "closeadj"), "closeadj_close", ns, "w", kind).withColumn("value", stable_round("value", digits))

    return run


for _kind, _body, _ns, _dig in (
    ("pct", f"round((value / nullif(lag(value, {{n}}) {_L}, 0) - 1) * 100, 5)", [1, 4, 12, 24, 36, 52], 5),
    ("l", f"round(lag(value, {{n}}) {_L}, 6)", [12], 6),
    ("diff", f"round(value - lag(value, {{n}}) {_L}, 5)", [4, 12], 5),
    ("mean", f"CASE WHEN row_number() {_L} >= {{n}} THEN round(avg(value) OVER (PARTITION BY ticker ORDER BY date_start ROWS {{p}} PRECEDING), 5) END", [4, 12, 24], 5),
    ("vol", f"CASE WHEN row_number() {_L} >= {{n}} THEN round(stddev_samp(value) OVER (PARTITION BY ticker ORDER BY date_start ROWS {{p}} PRECEDING), 4) END", [12, 24], 4),
):
    query(_long(_kind, _body, _ns), f"eav_{dict(pct='pct_change', l='lags', diff='diff', mean='rolling_mean', vol='rolling_vol')[_kind]}")(_weekly_long(_kind, _ns, _dig))


@query("SELECT a.ticker, a.date_start, a.date_end, 'close_x_volume' AS field, round(a.value / nullif(b.value, 0), 6) AS value FROM {{weekly_close}} a JOIN {{weekly_avg}} b USING (ticker, date_start)")
def eav_ratio(spark: SparkSession, d: str) -> DataFrame:
    return ft.long_ratio(weekly(spark, d), "closeadj_close", "volume_avg", "close_x_volume").withColumn("value", stable_round("value", 6))


@query("""WITH w AS (SELECT id, date, list(px_pct_1d) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS x, count(px_pct_1d) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS n,
      px_pct_1d AS label, row_number() OVER (PARTITION BY id ORDER BY date) AS rn, count(*) OVER (PARTITION BY id) AS total FROM {{day_px}})
    SELECT id, date, round(list_sum(x), 5) AS window_sum, CAST(len(x) AS BIGINT) AS window_size, label, rn <= 0.8 * total AS is_train FROM w WHERE n = 5 AND len(x) = 5 AND label IS NOT NULL""")
def tensor_windows(spark: SparkSession, d: str) -> DataFrame:
    t = ft.tensor_windows(day_px(spark, d), "id", "date", "px_pct_1d", 5, "px_pct_1d")
    total = F.aggregate("window", F.lit(0.0), lambda a, x: a + x)
    return t.select("id", "date", stable_round(total, 5).alias("window_sum"), F.size("window").cast("long").alias("window_size"), "label", "is_train")
