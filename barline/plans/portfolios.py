"""Queries: ranks, portfolios, performance, orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.functions.columns import stable_round
from barline.functions import ranks as rk
from barline.operators import fundamentals as fd
from barline.operators import portfolio as pf
from barline.operators import relational as rel
from barline.operators import sweep as sw
from barline.plans.features import _M, day_mom, month_returns, rounded
from barline.plans.joins import valuation_months
from barline.plans.registry import query, view
from barline.sources import canonical as src
from barline.sources.readers import read_table

RANKED = ["px_pct_1m", "px_pct_3m", "px_pct_6m", "pe", "pb", "ps", "marketcap"]
N, COST = 8, 0.01

view("panel", f"SELECT r.ticker, r.date, r.px_close, r.px_pct_1m, r.px_pct_2m, r.px_pct_3m, r.px_pct_6m, r.volume, v.marketcap, v.pe, v.pb, v.ps, round(lead(r.px_pct_1m) OVER (PARTITION BY r.ticker ORDER BY r.date) / 20, 8) AS next_month_return FROM {{{{month_returns}}}} r LEFT JOIN {{{{valuation_months}}}} v USING (ticker, date)")


def panel(spark: SparkSession, d: str) -> DataFrame:
    r = month_returns(spark, d).select("ticker", "date", "px_close", "px_pct_1m", "px_pct_2m", "px_pct_3m", "px_pct_6m", "volume")
    v = valuation_months(spark, d).select("ticker", "date", "marketcap", "pe", "pb", "ps")
    # the stand-in prices jump several-fold within a month; a twentieth of that keeps indices in a readable range
    return r.join(v, ["ticker", "date"], "left").withColumn("next_month_return", stable_round(F.lead("px_pct_1m").over(Window.partitionBy("ticker").orderBy("date")) / 20, 8))


def _avg_rank(c: str, by: str = "date") -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (PARTITION BY {by} ORDER BY {c} DESC NULLS LAST) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2 END"


@query("SELECT ticker, date, " + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (PARTITION BY date ORDER BY {c} DESC NULLS LAST) END AS {c}_rank" for c in RANKED) + " FROM {{panel}}")
def rank_null_guard(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).select("ticker", "date", *[rk.guarded_rank(c, ["date"]).cast("long").alias(f"{c}_rank") for c in RANKED])


@query("SELECT ticker, date, round(percent_rank() OVER (PARTITION BY date ORDER BY marketcap DESC NULLS LAST), 9) AS mcap_pct_rank, round(percent_rank() OVER (PARTITION BY date ORDER BY volume DESC NULLS LAST), 9) AS volume_pct_rank FROM {{panel}}")
def pct_rank_mcap(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).select("ticker", "date", *[stable_round(rk.sql_percent_rank(c, ["date"]), 9).alias(n) for c, n in (("marketcap", "mcap_pct_rank"), ("volume", "volume_pct_rank"))])


@query("SELECT ticker, date, ntile(5) OVER (PARTITION BY date ORDER BY px_pct_1m, ticker) AS quintile FROM {{panel}} WHERE px_pct_1m IS NOT NULL")
def quintile(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).where("px_pct_1m is not null").select("ticker", "date", F.ntile(5).over(Window.partitionBy("date").orderBy("px_pct_1m", "ticker")).cast("long").alias("quintile"))


@query("SELECT ticker, date, round((rank() OVER (PARTITION BY date ORDER BY px_pct_1m NULLS LAST) + (count(*) OVER (PARTITION BY date, px_pct_1m) - 1) / 2) / count(px_pct_1m) OVER (PARTITION BY date), 9) AS pct FROM {{panel}} WHERE px_pct_1m IS NOT NULL")
def pandas_pct_rank(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).where("px_pct_1m is not null").select("ticker", "date", stable_round(rk.pct_rank("px_pct_1m", ["date"]), 9).alias("pct"))


@query(f"SELECT ticker, date, {_avg_rank('pe')} AS pe_rank, {_avg_rank('px_pct_3m')} AS mom_rank FROM {{{{panel}}}}")
def avg_rank(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).select("ticker", "date", rk.average_rank("pe", ["date"]).alias("pe_rank"), rk.average_rank("px_pct_3m", ["date"]).alias("mom_rank"))


HORIZONS = {"next_month_return": ("px_pct_1m", 1), "next_2m_return": ("px_pct_2m", 2), "next_3m_return": ("px_pct_3m", 3), "next_6m_return": ("px_pct_6m", 6)}
_FWD = ", ".join(f"lead({c}, {n}) {_M} AS {h}" for h, (c, n) in HORIZONS.items())


@query(f"WITH f AS (SELECT ticker, date, {_FWD} FROM {{{{month_returns}}}}) SELECT ticker, date, " + ", ".join(f"CASE WHEN {h} IS NOT NULL AND dense_rank() OVER (PARTITION BY date ORDER BY {h} DESC NULLS LAST) <= {n} THEN 1 ELSE 0 END::BIGINT AS is_top_{n}_{h}" for h in HORIZONS for n in (5, 10)) + " FROM f")
def labels_topn(spark: SparkSession, d: str) -> DataFrame:
    f = fd.forward_returns(month_returns(spark, d), HORIZONS)
    return fd.labels(f, dict.fromkeys(HORIZONS, [5, 10])).select("ticker", "date", *[f"is_top_{n}_{h}" for h in HORIZONS for n in (5, 10)])


@query("""WITH e AS (SELECT date, list_distinct(quantile_cont(px_pct_1m, [0, .2, .4, .6, .8, 1])) AS e FROM {{panel}} WHERE px_pct_1m IS NOT NULL GROUP BY date)
    SELECT p.ticker, p.date, p.px_pct_1m, CASE WHEN len(e) > 1 THEN 1 + len(list_filter(list_sort(e)[2:len(e) - 1], lambda x: x < px_pct_1m)) END AS bin FROM {{panel}} p JOIN e USING (date) WHERE px_pct_1m IS NOT NULL""")
def qcut_bins(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).where("px_pct_1m is not null").select("ticker", "date", "px_pct_1m", rk.quantile_bin("px_pct_1m", ["date"]).alias("bin"))


_COMBO = [("px_pct_3m", "r1"), ("pe", "r2"), ("marketcap", "r3")]
view("combo", "SELECT ticker, date, next_month_return, (r1 + r2 + r3) / 3 AS combo_rank, CASE WHEN (r1 IS NOT NULL)::INT + (r2 IS NOT NULL)::INT + (r3 IS NOT NULL)::INT > 0 THEN (coalesce(r1, 0) + coalesce(r2, 0) + coalesce(r3, 0)) / ((r1 IS NOT NULL)::INT + (r2 IS NOT NULL)::INT + (r3 IS NOT NULL)::INT) END AS combo_rank_any FROM (SELECT ticker, date, next_month_return, " + ", ".join(f"{_avg_rank(c)} AS {n}" for c, n in _COMBO) + " FROM {{panel}})")


def combo(spark: SparkSession, d: str) -> DataFrame:
    r = panel(spark, d).select("ticker", "date", "next_month_return", *[rk.average_rank(c, ["date"]).alias(n) for c, n in _COMBO])
    r = pf.combo_rank(pf.combo_rank(r, ["r1", "r2", "r3"]), ["r1", "r2", "r3"], True, "combo_rank_any")
    return r.select("ticker", "date", "next_month_return", "combo_rank", "combo_rank_any")


@query("SELECT ticker, date, round(combo_rank, 6) AS combo_rank, round(combo_rank_any, 6) AS combo_rank_any FROM {{combo}}")
def combo_rank(spark: SparkSession, d: str) -> DataFrame:
    return rounded(combo(spark, d).drop("next_month_return"))


view("ptf", f"SELECT ticker, date, next_month_return, combo_rank, ptf_rank FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY combo_rank, ticker) AS ptf_rank FROM {{{{combo}}}} WHERE combo_rank IS NOT NULL) WHERE ptf_rank <= {N}")


def ptf(spark: SparkSession, d: str) -> DataFrame:
    return pf.top_n(combo(spark, d), "combo_rank", N, ["date"], "ticker").select("ticker", "date", "next_month_return", "combo_rank", "ptf_rank")


@query("SELECT ticker, date, next_month_return, round(combo_rank, 6) AS combo_rank, ptf_rank FROM {{ptf}}")
def combo_topn(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ptf(spark, d), 6, "next_month_return")


@query("""SELECT ticker, date, round(percentile_rank, 9) AS percentile_rank, ptf_count FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY percentile_rank, ticker) AS ptf_count FROM
    (SELECT ticker, date, percent_rank() OVER (PARTITION BY date ORDER BY combo_rank) AS percentile_rank FROM {{combo}} WHERE combo_rank IS NOT NULL) WHERE percentile_rank <= .4) WHERE ptf_count <= 7""")
def combo_percentile(spark: SparkSession, d: str) -> DataFrame:
    return pf.top_percentile(combo(spark, d), "combo_rank", 0.4, 7, ["date"], "ticker").select("ticker", "date", stable_round("percentile_rank", 9).alias("percentile_rank"), "ptf_count")


_SLEEVES = "SELECT date, ticker, 'momentum' AS strategy, px_pct_3m AS pred FROM {{panel}} WHERE px_pct_3m IS NOT NULL UNION ALL SELECT date, ticker, 'value' AS strategy, px_pct_1m AS pred FROM {{panel}} WHERE px_pct_1m IS NOT NULL"


@query(f"""WITH s AS ({_SLEEVES}), r AS (SELECT *, dense_rank() OVER (PARTITION BY date ORDER BY pred DESC) AS rank, row_number() OVER (PARTITION BY date, strategy ORDER BY pred DESC, ticker) AS strat_rank FROM s),
    k AS (SELECT * EXCLUDE (rank), dense_rank() OVER (PARTITION BY date ORDER BY pred DESC) AS rank FROM r WHERE NOT (rank < 20 AND strategy = 'value' AND strat_rank > 4))
    SELECT date, ticker, strategy, pred, strat_rank, rank FROM k WHERE rank <= 20""")
def sleeve_merge(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d)
    part = lambda c, n: p.where(F.col(c).isNotNull()).select("date", "ticker", F.lit(n).alias("strategy"), F.col(c).alias("pred"))
    return pf.merge_sleeves(part("px_pct_3m", "momentum").unionByName(part("px_pct_1m", "value")), "value", most=4, cap=20)


def _returns(src_: str, by: str = "", n: int = 50) -> str:
    """SQL of the period returns of a portfolio view, with the key columns ``by`` in front."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    same = f"AND p.{by} = b.{by}" if by else ""
    return f"""m AS (SELECT {keys}date, coalesce(avg(next_month_return), 0) AS r FROM {src_} GROUP BY ALL),
    x AS (SELECT *, lag(date) OVER ({part}ORDER BY date) AS prev, lead(date) OVER ({part}ORDER BY date) AS nxt, row_number() OVER ({part}ORDER BY date) AS rn FROM m),
    t AS (SELECT {'p.' + by + ', ' if by else ''}x.prev AS date, count(*) AS turnover FROM {src_} p JOIN x ON p.date = x.date {'AND p.' + by + ' = x.' + by if by else ''} WHERE x.prev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {src_} b WHERE b.date = x.prev AND b.ticker = p.ticker {same}) GROUP BY ALL),
    c AS (SELECT x.*, CASE WHEN nxt IS NOT NULL THEN coalesce(turnover, 0) END AS turnover FROM x LEFT JOIN t ON x.date = t.date {'AND x.' + by + ' = t.' + by if by else ''}),
    y AS (SELECT *, turnover / {n} * {COST} AS trade_costs, r - turnover / {n} * {COST} AS total_return FROM c),
    z AS (SELECT *, CASE WHEN rn = 1 OR total_return IS NOT NULL THEN 100 * product(CASE WHEN rn = 1 THEN 1 ELSE 1 + total_return END) OVER ({part}ORDER BY date ROWS UNBOUNDED PRECEDING) END AS total_return_idx FROM y)"""


@query(f"WITH {_returns('{{ptf}}')} SELECT date, round(r, 6) AS next_month_return, turnover, round(trade_costs, 6) AS trade_costs, round(total_return, 6) AS total_return, round(total_return_idx, 4) AS total_return_idx FROM z".replace("{{ptf}}", "pp").replace("WITH m AS", "WITH pp AS (SELECT * FROM {{ptf}}), m AS", 1))
def monthly_return(spark: SparkSession, d: str) -> DataFrame:
    r = pf.period_returns(ptf(spark, d), COST)
    return r.select("date", *[stable_round(c, 6).alias(c) for c in ("next_month_return",)], "turnover", *[stable_round(c, 6).alias(c) for c in ("trade_costs", "total_return")], stable_round("total_return_idx", 4).alias("total_return_idx"))


_Z = f"WITH pp AS (SELECT * FROM {{{{ptf}}}}), {_returns('pp')}, q AS (SELECT *, rn - 1 AS i, count(*) OVER () - 2 AS e FROM z), w AS (SELECT *, total_return_idx / max(total_return_idx) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM q WHERE i <= e)"


def _stats(p: str, cond: str) -> str:
    f = f"FILTER ({cond})"
    return f"""round(arg_max(total_return_idx, i) {f} / arg_min(total_return_idx, i) {f} - 1, 5) AS return_{p}, round(stddev_samp(total_return) {f} * sqrt(12), 5) AS std_{p}, round(avg(total_return) {f} * 12 / nullif(stddev_samp(total_return) {f} * sqrt(12), 0), 5) AS sharpe_{p},
    round(min(total_return) {f}, 5) AS drawdown_{p}, arg_min(date, (total_return, i)) {f} AS drawdown_date_{p}, round(min(dd) {f}, 5) AS peak_to_trough_{p}"""


@query(f"{_Z} SELECT {_stats('period', 'i >= 20')}, {_stats('all', 'true')} FROM w")
def perf_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pf.performance(pf.period_returns(ptf(spark, d), COST), start=20), 5)


@query(f"{_Z} " + " UNION ALL ".join(f"SELECT CAST({y} AS DOUBLE) AS lookback, round(arg_max(total_return_idx, i) FILTER (i >= e - {int(12 * y)}) / arg_min(total_return_idx, i) FILTER (i >= e - {int(12 * y)}) - 1, 5) AS total_return, round(stddev_samp(total_return) FILTER (i >= e - {int(12 * y)}) * sqrt(12), 5) AS std, round(avg(total_return) FILTER (i >= e - {int(12 * y)}) * 12 / (stddev_samp(total_return) * sqrt(12)), 5) AS sharpe, round(min(total_return) FILTER (i >= e - {int(12 * y)}), 5) AS drawdown FROM w" for y in (1, 3, 1.5)))
def perf_stats_v2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pf.performance_v2(pf.period_returns(ptf(spark, d), COST), [1, 3, 1.5]), 5)


SWEPT = ["px_pct_1m", "px_pct_3m", "px_pct_6m", "pe", "marketcap"]
view("swept_ranks", " UNION ALL ".join(f"SELECT date, ticker, next_month_return, '{v}' AS variable, {_avg_rank(v)} AS rank FROM {{{{panel}}}} WHERE {v} IS NOT NULL" for v in SWEPT))
_SORTED = sorted(SWEPT)
_TRIPLES = [(a, b, c) for i, a in enumerate(_SORTED) for j, b in enumerate(_SORTED[i + 1 :], i + 1) for c in _SORTED[j + 1 :]]
view("swept", f"""SELECT model_id, date, ticker, next_month_return FROM (SELECT *, row_number() OVER (PARTITION BY model_id, date ORDER BY combo_rank, ticker) AS n FROM (
    SELECT model_id, date, ticker, count(rank) AS k, avg(rank) AS combo_rank, any_value(next_month_return) AS next_month_return FROM {{{{swept_ranks}}}} JOIN (VALUES {', '.join(f"('{a}-{b}-{c}', '{x}')" for a, b, c in _TRIPLES for x in (a, b, c))}) m(model_id, variable) USING (variable) GROUP BY ALL HAVING count(rank) = 3)) WHERE n <= {N}""".replace("next_month_return FROM {{swept_ranks}}", "next_month_return FROM {{swept_ranks}}").replace("GROUP BY ALL HAVING", "GROUP BY model_id, date, ticker HAVING"))


def swept_returns(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([(v,) for v in SWEPT], "variable string")
    return sw.combo_sweep(panel(spark, d), SWEPT, rel.combos(names, 3), N, COST)


_S = f"WITH pp AS (SELECT * FROM {{{{swept}}}}), {_returns('pp', 'model_id')}"


@query(f"{_S} SELECT model_id, date, round(r, 6) AS next_month_return, turnover, round(total_return, 6) AS total_return, round(total_return_idx, 4) AS total_return_idx FROM z")
def combo_sweep(spark: SparkSession, d: str) -> DataFrame:
    return swept_returns(spark, d).select("model_id", "date", stable_round("next_month_return", 6).alias("next_month_return"), "turnover", stable_round("total_return", 6).alias("total_return"), stable_round("total_return_idx", 4).alias("total_return_idx"))


@query(f"{_S}, l AS (SELECT *, round(lag(total_return_idx, 1) OVER w / nullif(lag(total_return_idx, 6) OVER w, 0) - 1, 9) AS lookback_return FROM z WINDOW w AS (PARTITION BY model_id ORDER BY date)) SELECT model_id, date, round(lookback_return, 6) AS lookback_return, round(total_return, 6) AS total_return FROM l WHERE lookback_return IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date ORDER BY lookback_return DESC, model_id) = 1")
def meta_best_model(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pf.best_trailing(swept_returns(spark, d), 6).select("model_id", "date", "lookback_return", "total_return"))


@query(f"{_S}, f AS (SELECT model_id, round(arg_max(total_return_idx, date) FILTER (total_return_idx IS NOT NULL), 4) AS final FROM z GROUP BY 1) SELECT model_id, final FROM f ORDER BY final DESC, model_id LIMIT 5")
def top_models(spark: SparkSession, d: str) -> DataFrame:
    f = swept_returns(spark, d).where("total_return_idx is not null").groupBy("model_id").agg(stable_round(F.max_by("total_return_idx", "date"), 4).alias("final"))
    return f.orderBy(F.desc("final"), "model_id").limit(5)


@query("SELECT id, date, px_pct_1d, round(product(1 + px_pct_1d) OVER (PARTITION BY id ORDER BY date ROWS UNBOUNDED PRECEDING) * 100, 4) AS idx FROM {{day_mom}}")
def cumulative_product(spark: SparkSession, d: str) -> DataFrame:
    from barline.operators.features import Feature, with_features

    return with_features(day_mom(spark, d).select("id", "date", "px_pct_1d"), "id", "date", [Feature("idx", "cumprod", "px_pct_1d", scale=100.0, digits=4)])


@query("SELECT upper(id) AS symbol, date, floor(1 / nullif(round(px_vol_28d, 8) * 3, 0)) AS max_leverage, round(px_vol_28d * 3, 6) AS est_drawdown FROM {{day_mom}} WHERE px_vol_28d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY upper(id) ORDER BY date DESC) = 1")
def max_leverage(spark: SparkSession, d: str) -> DataFrame:
    last = rel.first_of(day_mom(spark, d).where("px_vol_28d is not null").withColumn("symbol", F.upper("id")), ["symbol"], F.desc("date"))
    return last.select("symbol", "date", F.floor(F.try_divide(F.lit(1.0), stable_round("px_vol_28d", 8) * 3)).cast("double").alias("max_leverage"), stable_round(F.col("px_vol_28d") * 3, 6).alias("est_drawdown"))


_HELD = "SELECT n_name AS ticker, count(*) AS qty FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE date_trunc('month', o_orderdate) = {m} GROUP BY 1"


def _holdings(spark: SparkSession, d: str, month: str) -> DataFrame:
    o, c, n = read_table(spark, d, "orders", ["o_custkey", "o_orderdate"]), read_table(spark, d, "customer", ["c_custkey", "c_nationkey"]), read_table(spark, d, "nation", ["n_nationkey", "n_name"])
    rows = o.where((F.col("o_orderdate") >= F.lit(month).cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit(month).cast("timestamp_ntz") + F.expr("INTERVAL 1 MONTH")))
    return rows.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("ticker")).agg(F.count("*").alias("qty"))


@query("SELECT *, CASE WHEN trade > 0 THEN 'buy' WHEN trade < 0 THEN 'sell' ELSE 'hold' END AS side FROM (SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.qty, 0) AS new, coalesce(b.qty, 0) AS old, coalesce(a.qty, 0) - coalesce(b.qty, 0) AS trade FROM (" + _HELD.format(m="DATE '1996-02-01'") + ") a FULL JOIN (" + _HELD.format(m="DATE '1996-01-01'") + ") b ON a.ticker = b.ticker)")
def order_diff(spark: SparkSession, d: str) -> DataFrame:
    return pf.order_diff(_holdings(spark, d, "1996-02-01"), _holdings(spark, d, "1996-01-01"))


@query("SELECT ticker, date, px_close, CAST(2000 AS DOUBLE) AS target, round(2000 / nullif(px_close, 0), 0) AS qty, round(px_close * .85, 4) AS stop_px, round(px_close * 1.2, 4) AS take_px FROM {{months}} QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1")
def sizing(spark: SparkSession, d: str) -> DataFrame:
    from barline.plans.bars import months

    last = rel.first_of(months(spark, d).select("ticker", "date", F.col("px_close").alias("px")), ["ticker"], F.desc("date"))
    return pf.sizing(last, 100_000).withColumnRenamed("px", "px_close")


@query("""WITH h AS (SELECT ticker, date, volume AS position, closeadj AS avg_cost FROM {{prices}} WHERE day(date) <= 3), l AS (SELECT ticker, strftime(date, '%Y-%m') AS m, arg_max(closeadj, date) AS px FROM {{prices}} GROUP BY 1, 2)
    SELECT strftime(h.date, '%Y-%m') AS month, count(*) AS n, round(sum(position * avg_cost), 2) AS cost, round(sum(position * px), 2) AS mktval, round(sum(position * px) / nullif(sum(position * avg_cost), 0) - 1, 6) AS mtd FROM h JOIN l ON h.ticker = l.ticker AND strftime(h.date, '%Y-%m') = l.m GROUP BY 1""")
def mtd_pnl(spark: SparkSession, d: str) -> DataFrame:
    p = src.prices(spark, d).withColumn("month", F.date_format("date", "yyyy-MM"))
    held = p.where(F.day("date") <= 3).select("ticker", "month", F.col("volume").alias("position"), F.col("closeadj").alias("avg_cost"))
    last = p.groupBy("ticker", "month").agg(F.max_by("closeadj", "date").alias("px"))
    j = held.join(last, ["ticker", "month"])
    cost, value = F.sum(F.col("position") * F.col("avg_cost")), F.sum(F.col("position") * F.col("px"))
    return j.groupBy("month").agg(F.count("*").alias("n"), stable_round(cost, 2).alias("cost"), stable_round(value, 2).alias("mktval"), stable_round(F.try_divide(value, cost) - 1, 6).alias("mtd"))


@query(f"SELECT date, sector, count(*) AS n, count(*) / {N} * 100 AS share FROM {{{{ptf}}}} JOIN {{{{metadata}}}} USING (ticker) GROUP BY ALL")
def sector_share(spark: SparkSession, d: str) -> DataFrame:
    return ptf(spark, d).join(src.metadata(spark, d).select("ticker", "sector"), "ticker").groupBy("date", "sector").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / N * 100)


@query("""SELECT p.ticker, p.date, p.px_close FROM (SELECT *, percent_rank() OVER (PARTITION BY date ORDER BY marketcap DESC NULLS LAST) AS mr, percent_rank() OVER (PARTITION BY date ORDER BY volume DESC NULLS LAST) AS vr FROM {{panel}}) p
    JOIN (SELECT ticker, min(date) AS f, max(date) AS l FROM {{prices}} GROUP BY 1) x USING (ticker) JOIN {{metadata}} m USING (ticker) WHERE mr <= .6 AND vr < .8 AND p.date > f + 90 AND p.date <= l AND m.famaindustry NOT IN ('ECONOMY ANODIZED STEEL') AND ticker IN (SELECT ticker FROM {{fundamentals}} GROUP BY 1 HAVING count(*) > 3)""")
def universe_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = panel(spark, d).withColumns({"mcap_pct_rank": rk.sql_percent_rank("marketcap", ["date"]), "volume_pct_rank": rk.sql_percent_rank("volume", ["date"])})
    dates = src.prices(spark, d).groupBy("ticker").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return fd.universe(rows, src.metadata(spark, d), dates, src.fundamentals(spark, d), exclude=["ECONOMY ANODIZED STEEL"]).select("ticker", "date", "px_close")


@query("""WITH s AS (SELECT s_suppkey AS k, s_acctbal AS bal, count(l_orderkey) AS qty FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_returnflag = 'R' GROUP BY ALL)
    SELECT k, CASE WHEN bal > 0 AND qty = 0 THEN 'open' WHEN bal <= 0 AND qty > 0 THEN 'close' WHEN bal > 0 AND qty < 150 THEN 'add' WHEN bal > 0 AND qty > 150 THEN 'cut' ELSE 'none' END AS action FROM s""")
def position_actions(spark: SparkSession, d: str) -> DataFrame:
    n = read_table(spark, d, "lineitem", ["l_suppkey", "l_returnflag"]).where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("qty"))
    s = read_table(spark, d, "supplier", ["s_suppkey", "s_acctbal"]).select(F.col("s_suppkey").alias("k"), F.when(F.col("s_acctbal") > 0, 1).otherwise(0).alias("signal"))
    return pf.position_action(s.join(n, "k", "left").fillna(0, ["qty"]).withColumn("target", F.lit(150))).select("k", "action")


def _held(d: DataFrame) -> DataFrame:
    return d.select("model_id", "date", "ticker", stable_round("pred", 6).alias("pred"), "held")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).where("px_pct_3m is not null").select(F.lit("m").alias("model_id"), "date", "ticker", F.col("px_pct_3m").alias("pred"))


def _in_turn(listed: str, first: int, keep: int) -> str:
    """SQL of portfolios that hold on to names: a date after the other, lists in the order of predictions."""
    return f"""SELECT * FROM (WITH RECURSIVE c AS (SELECT date, ticker, pred, row_number() OVER (PARTITION BY date ORDER BY pred DESC, ticker) AS n FROM (SELECT date, ticker, px_pct_3m AS pred FROM {{{{panel}}}} WHERE px_pct_3m IS NOT NULL)),
        l AS (SELECT date, list(ticker ORDER BY n) AS names, row_number() OVER (ORDER BY date) AS k FROM ({listed}) GROUP BY date),
        s AS (SELECT k, date, names[1:{first}] AS now, names[1:0] AS old FROM l WHERE k = 1 UNION ALL
          SELECT l.k, l.date, list_concat(list_filter(l.names, lambda x: list_contains(s.now, x)), list_filter(l.names, lambda x: NOT list_contains(s.now, x)))[1:{keep}], s.now FROM s JOIN l ON l.k = s.k + 1),
        u AS (SELECT date, unnest(now) AS ticker, old FROM s)
        SELECT 'm' AS model_id, u.date, u.ticker, round(c.pred, 6) AS pred, list_contains(u.old, u.ticker) AS held FROM u JOIN c ON c.date = u.date AND c.ticker = u.ticker)"""


# sizes that bind on 25 tickers; as with 50 and 51 names, the first date has one less than those after it
@query(_in_turn("SELECT c.* FROM c JOIN (SELECT date, least(.05, min(pred) FILTER (n <= 7)) AS floor FROM c GROUP BY date) f USING (date) WHERE pred >= floor", 6, 7))
def sticky_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _held(pf.sticky(_candidates(spark, d), 7, threshold=0.05, first=6))


@query(_in_turn("SELECT * FROM c WHERE n <= 13", 6, 7))
def sticky_top101(spark: SparkSession, d: str) -> DataFrame:
    return _held(pf.sticky(_candidates(spark, d), 7, 13, first=6))


@query(_in_turn("SELECT * FROM c WHERE n <= 12", 6, 6))
def low_turnover(spark: SparkSession, d: str) -> DataFrame:
    return _held(pf.low_turnover(_candidates(spark, d), 6, 12))


FIXED, FREE = ["px_pct_1m", "pe", "marketcap"], ["pb", "ps", "px_pct_3m", "px_pct_6m"]
view("five_ranks", " UNION ALL ".join(f"SELECT date, ticker, next_month_return, '{v}' AS variable, {_avg_rank(v)} AS rank FROM {{{{panel}}}} WHERE {v} IS NOT NULL" for v in FIXED + FREE))
_FIVES = ", ".join(f"('{a}-{b}', '{x}')" for i, a in enumerate(FREE) for b in FREE[i + 1 :] for x in (a, b, *FIXED))
view("five", f"""SELECT model_id, date, ticker, next_month_return FROM (SELECT *, row_number() OVER (PARTITION BY model_id, date ORDER BY combo_rank, ticker) AS n FROM (
    SELECT model_id, date, ticker, avg(rank) AS combo_rank, any_value(next_month_return) AS next_month_return FROM {{{{five_ranks}}}} JOIN (VALUES {_FIVES}) m(model_id, variable) USING (variable) GROUP BY model_id, date, ticker HAVING count(rank) = 5)) WHERE n <= {N}""")


@query(f"WITH pp AS (SELECT * FROM {{{{five}}}}), {_returns('pp', 'model_id')} SELECT model_id, date, round(r, 6) AS next_month_return, turnover, round(total_return_idx, 4) AS total_return_idx FROM z")
def combo_sweep_five(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of free variables with three fixed ones."""
    names = spark.createDataFrame([(v,) for v in FREE], "variable string")
    out = sw.combo_sweep(panel(spark, d), FIXED + FREE, rel.combos(names, 2, FIXED), N, COST)
    return out.select("model_id", "date", stable_round("next_month_return", 6).alias("next_month_return"), "turnover", stable_round("total_return_idx", 4).alias("total_return_idx"))


WIDE = ["px_close", "px_pct_1m", "px_pct_2m", "px_pct_3m", "px_pct_6m", "volume", "marketcap", "pe", "pb", "ps", "pe_pb", "cap_volume"]
_WIDE = "SELECT *, round(pe / nullif(pb, 0), 6) AS pe_pb, round(marketcap / nullif(volume, 0), 4) AS cap_volume FROM {{panel}}"
view("wide", _WIDE)
view("wide_ranks", " UNION ALL ".join(f"SELECT date, ticker, next_month_return, '{v}' AS variable, {_avg_rank(v)} AS rank FROM {{{{wide}}}} WHERE {v} IS NOT NULL" for v in WIDE))
view("wide_models", "WITH v AS (SELECT DISTINCT variable FROM {{wide_ranks}}) SELECT a.variable || '-' || b.variable || '-' || c.variable AS model_id, unnest([a.variable, b.variable, c.variable]) AS variable FROM v a JOIN v b ON a.variable < b.variable JOIN v c ON b.variable < c.variable")
view("wide_ptf", f"""SELECT model_id, date, ticker, next_month_return FROM (SELECT *, row_number() OVER (PARTITION BY model_id, date ORDER BY combo_rank, ticker) AS n FROM (
    SELECT model_id, date, ticker, avg(rank) AS combo_rank, any_value(next_month_return) AS next_month_return FROM {{{{wide_ranks}}}} JOIN {{{{wide_models}}}} USING (variable) GROUP BY model_id, date, ticker HAVING count(rank) >= 2)) WHERE n <= {N}""")


@query(f"WITH pp AS (SELECT * FROM {{{{wide_ptf}}}}), {_returns('pp', 'model_id')}, f AS (SELECT model_id, count(*) AS dates, CAST(sum(turnover) AS BIGINT) AS turnover, round(avg(r), 6) AS mean_return, round(arg_max(total_return_idx, date) FILTER (total_return_idx IS NOT NULL), 3) AS final FROM z GROUP BY 1) SELECT * FROM f")
def combo_sweep_wide(spark: SparkSession, d: str) -> DataFrame:
    """All triples of twelve variables; a name takes part with one of three ranks missing."""
    p = panel(spark, d).withColumns({"pe_pb": stable_round(F.try_divide("pe", "pb"), 6), "cap_volume": stable_round(F.try_divide("marketcap", "volume"), 4)})
    names = spark.createDataFrame([(v,) for v in WIDE], "variable string")
    out = sw.combo_sweep(p, WIDE, rel.combos(names, 3), N, COST, most_missing=1)
    return out.groupBy("model_id").agg(F.count("*").alias("dates"), F.sum("turnover").alias("turnover"), stable_round(F.avg("next_month_return"), 6).alias("mean_return"), stable_round(F.max_by("total_return_idx", F.when(F.col("total_return_idx").isNotNull(), F.col("date"))), 3).alias("final"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of every three-factor combination: prices to monthly bars, returns, ranks, portfolios, indices."""
    return rounded(pf.performance(swept_returns(spark, d), start=12, by=["model_id"]), 5)


@query(f"{_S}, q AS (SELECT *, rn - 1 AS i, count(*) OVER (PARTITION BY model_id) - 2 AS e FROM z), w AS (SELECT *, total_return_idx / max(total_return_idx) OVER (PARTITION BY model_id ORDER BY i ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM q WHERE i <= e) SELECT model_id, {_stats('period', 'i >= 12')}, {_stats('all', 'true')} FROM w GROUP BY model_id")
def sweep_statistics(spark: SparkSession, d: str) -> DataFrame:
    return flagship(spark, d)
