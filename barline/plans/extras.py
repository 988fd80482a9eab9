"""Queries: scalar functions, calendar slots, shortlists, model scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.functions import columns as fc
from barline.functions.columns import stable_round
from barline.operators import models
from barline.operators import portfolio as pf
from barline.operators import relational as rel
from barline.operators.features import Feature, with_features
from barline.plans.features import day_px, rounded
from barline.plans.portfolios import _S, _stats, panel, swept_returns
from barline.plans.registry import query
from barline.sources import canonical as src
from barline.sources.readers import read_table


@query("""SELECT c_custkey, CASE WHEN c_acctbal / 1000 > -0.1 THEN c_acctbal / 1000 END AS clipped, nullif(c_nationkey, 0) AS nation, CASE WHEN isfinite(x) THEN x END AS finite, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0) AS filled
    FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN 'nan'::DOUBLE WHEN c_custkey % 3 = 1 THEN '-inf'::DOUBLE ELSE c_acctbal END AS x FROM customer)""")
def scalar_cleanup(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer", ["c_custkey", "c_acctbal", "c_nationkey"])
    x = F.when(F.col("c_custkey") % 3 == 0, float("nan")).when(F.col("c_custkey") % 3 == 1, float("-inf")).otherwise(F.col("c_acctbal"))
    return c.select(
        "c_custkey", fc.clip_below(F.col("c_acctbal") / 1000, -0.1).alias("clipped"), fc.zero_to_null("c_nationkey").alias("nation"), fc.inf_to_null(x).alias("finite"),
        F.coalesce(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")), F.lit(0.0)).alias("filled"),
    )


@query("SELECT event_id, date_trunc('minute', ts + INTERVAL 30 SECOND) AS minute, epoch_us(ts) // 1000 AS ms, last_day(CAST(ts AS DATE)) AS month_end, last_day(CAST(ts AS DATE) - INTERVAL 2 MONTH) AS two_back, CAST(isodow(ts) > 5 AS BOOLEAN) AS weekend FROM events WHERE minute(ts) % 5 = 0 AND hour(ts) % 4 = 0")
def calendar_slots(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events", ["event_id", "ts"]).where((F.minute("ts") % 5 == 0) & (F.hour("ts") % 4 == 0))
    day = F.col("ts").cast("date")
    return e.select("event_id", fc.nearest_minute("ts").alias("minute"), fc.epoch_ms("ts").alias("ms"), fc.month_end(day).alias("month_end"), fc.month_end(day, -2).alias("two_back"), (F.weekday("ts") > 4).alias("weekend"))


@query("SELECT p_partkey, upper(p_brand) AS brand, p_brand || '|' || p_type AS joined, CAST(len(string_split(p_type, ' ')) AS BIGINT) AS n_parts, string_split(p_type, ' ')[1] AS first_part, CAST(instr(p_brand, '#') AS BIGINT) AS hash_at, regexp_extract(p_brand, '#([0-9]+)', 1) AS digits, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS size_class, greatest(p_size, 10) AS at_least_10 FROM part")
def string_ops(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part", ["p_partkey", "p_brand", "p_type", "p_size"])
    parts = F.split("p_type", " ")
    return p.select(
        "p_partkey", F.upper("p_brand").alias("brand"), F.concat_ws("|", "p_brand", "p_type").alias("joined"), F.size(parts).cast("long").alias("n_parts"), parts[0].alias("first_part"), F.instr("p_brand", "#").cast("long").alias("hash_at"),
        F.regexp_extract("p_brand", "#([0-9]+)", 1).alias("digits"), F.when(F.col("p_size") > 25, "big").otherwise("small").alias("size_class"), F.greatest("p_size", F.lit(10)).alias("at_least_10"),
    )


@query("SELECT ticker, date, -next_month_return AS next_month_return FROM {{panel}} WHERE next_month_return IS NOT NULL")
def short_side(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).where("next_month_return is not null").select("ticker", "date", (-F.col("next_month_return")).alias("next_month_return"))


@query("SELECT id, date, CASE WHEN count(px_pct_1d) OVER w = 12 THEN round(avg(px_pct_1d) OVER w, 6) END AS score_12 FROM {{day_px}} WINDOW w AS (PARTITION BY id ORDER BY date ROWS 11 PRECEDING)")
def rolling_score(spark: SparkSession, d: str) -> DataFrame:
    return with_features(day_px(spark, d).select("id", "date", "px_pct_1d"), "id", "date", [Feature("score_12", "mean", "px_pct_1d", 12, full=True, digits=6)]).drop("px_pct_1d")


_PER_MODEL = f"{_S}, q AS (SELECT *, rn - 1 AS i, count(*) OVER (PARTITION BY model_id) - 2 AS e FROM z), w AS (SELECT *, total_return_idx AS dd FROM q WHERE i <= e), st AS (SELECT model_id, {_stats('period', 'i >= 12')} FROM w GROUP BY model_id)"


@query(f"{_PER_MODEL} (SELECT model_id FROM st ORDER BY sharpe_period DESC, model_id LIMIT 3) UNION (SELECT model_id FROM st ORDER BY return_period DESC, model_id LIMIT 3) UNION (SELECT model_id FROM st ORDER BY drawdown_period DESC, model_id LIMIT 3)")
def model_shortlist(spark: SparkSession, d: str) -> DataFrame:
    st = rounded(pf.performance(swept_returns(spark, d), start=12, by=["model_id"]), 5)
    top = lambda c: st.orderBy(F.desc(c), "model_id").limit(3).select("model_id")
    return rel.union_distinct(top("sharpe_period"), top("return_period"), top("drawdown_period"))


@query(f"""{_S}, l AS (SELECT *, round(lag(total_return_idx, 1) OVER w / nullif(lag(total_return_idx, 6) OVER w, 0) - 1, 9) AS lb FROM z WINDOW w AS (PARTITION BY model_id ORDER BY date)), b AS (SELECT date, model_id, total_return FROM l WHERE lb IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date ORDER BY lb DESC, model_id) = 1)
    SELECT date, model_id, round(100 * product(CASE WHEN n = 1 THEN 1 ELSE 1 + total_return END) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 4) AS idx FROM (SELECT *, row_number() OVER (ORDER BY date) AS n FROM b WHERE total_return IS NOT NULL)""")
def meta_index(spark: SparkSession, d: str) -> DataFrame:
    best = pf.best_trailing(swept_returns(spark, d), 6).where("total_return is not null")
    return pf.chained_index(best, [], "total_return", "idx").select("date", "model_id", stable_round("idx", 4).alias("idx"))


@query("""WITH s AS (SELECT date, next_month_return > .01 AS y, px_pct_1m < 0 AS p FROM {{panel}} WHERE next_month_return IS NOT NULL AND px_pct_1m IS NOT NULL), c AS (SELECT date, count(*) FILTER (p AND y) AS tp, count(*) FILTER (p AND NOT y) AS fp, count(*) FILTER (NOT p AND y) AS fn FROM s GROUP BY 1)
    SELECT date, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""")
def f1_by_date(spark: SparkSession, d: str) -> DataFrame:
    s = panel(spark, d).where("next_month_return is not null and px_pct_1m is not null")
    s = s.select("date", (F.col("next_month_return") > 0.01).cast("int").alias("y"), (F.col("px_pct_1m") < 0).cast("int").alias("prediction"))
    return rounded(models.f1_by_date(s, "y"))


@query("SELECT p_type AS variable, round(avg(p_retailprice), 6) AS importance FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def mean_importance(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part", ["p_type", "p_retailprice"])
    return p.groupBy(F.col("p_type").alias("variable")).agg(stable_round(F.avg("p_retailprice"), 6).alias("importance")).orderBy(F.desc("importance"), "variable").limit(3)


@query("""WITH c AS (SELECT v1.a AS var_1, v2.a AS var_2, abs(length(v1.a) - length(v2.a)) / 5 AS corr FROM (SELECT DISTINCT p_type AS a FROM part) v1 JOIN (SELECT DISTINCT p_type AS a FROM part) v2 ON v1.a < v2.a), i AS (SELECT p_type AS variable, max(p_size) + 0.0::DOUBLE AS importance FROM part GROUP BY 1),
    g AS (SELECT DISTINCT CASE WHEN a.importance > b.importance OR (a.importance = b.importance AND var_1 < var_2) THEN var_2 ELSE var_1 END AS variable FROM c JOIN i a ON a.variable = var_1 JOIN i b ON b.variable = var_2 WHERE corr >= .9) SELECT variable, importance FROM i WHERE variable NOT IN (SELECT variable FROM g)""")
def correlation_pruning(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part", ["p_type", "p_size"])
    names = p.select(F.col("p_type").alias("variable")).distinct()
    pairs = rel.combos(names, 2).select("var_1", "var_2", (F.abs(F.length("var_1") - F.length("var_2")) / 5).alias("corr"))
    return rel.prune_correlated(pairs, p.groupBy(F.col("p_type").alias("variable")).agg(F.max("p_size").cast("double").alias("importance")))


@query("SELECT ticker, date, closeadj, round(closeadj / nullif(lag(closeadj) OVER (PARTITION BY ticker ORDER BY date), 0) - 1, 6) AS r FROM {{prices}} WHERE ticker IN (SELECT ticker FROM {{actions}} GROUP BY 1 HAVING count(*) > 5) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 20")
def last_rows(spark: SparkSession, d: str) -> DataFrame:
    busy = src.actions(spark, d).groupBy("ticker").agg(F.count("*").alias("n")).where("n > 5")
    rows = rel.only_in(src.prices(spark, d).select("ticker", "date", "closeadj"), busy, ["ticker"])
    rows = with_features(rows, "ticker", "date", [Feature("r", "pct", "closeadj", 1, digits=6)])
    return pf.top_n(rows.withColumn("_age", -F.unix_date("date")), "_age", 20, ["ticker"], "date").drop("_age", "ptf_rank")


@query("SELECT ticker, 'f_' || field AS field, round(value, 4) AS value, 'all' AS period FROM (UNPIVOT (SELECT ticker, avg(pe) AS pe, avg(pb) AS pb FROM {{valuation_months}} GROUP BY 1) ON pe, pb INTO NAME field VALUE value)")
def stats_long(spark: SparkSession, d: str) -> DataFrame:
    from barline.plans.joins import valuation_months

    wide = valuation_months(spark, d).groupBy("ticker").agg(F.avg("pe").alias("pe"), F.avg("pb").alias("pb"))
    out = pf.stats_long(wide, ["ticker"], ["pe", "pb"], "all")
    return out.select("ticker", F.concat(F.lit("f_"), "field").alias("field"), stable_round("value", 4).alias("value"), "period")
