"""Queries: boosted trees of many models in one set of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.functions.columns import stable_round
from barline.operators import boosting as bt
from barline.operators import explain as ex
from barline.operators import portfolio as pf
from barline.plans.features import rounded
from barline.plans.portfolios import panel
from barline.plans.registry import query, view
from barline.plans.research import VARIABLES, _rows
from barline.session import kept

CUTOFF, BINS, STUMP = 60, 8, {"trees": 1, "depth": 1, "eta": 0.3, "gamma": 0.05}

# Gradients of the first tree are halves and quarters, so its sums are exact in any order.
view("labelled", "SELECT *, CASE WHEN dense_rank() OVER (PARTITION BY date ORDER BY next_month_return DESC) <= 8 THEN 1 ELSE 0 END AS y FROM {{panel}} WHERE next_month_return IS NOT NULL")
view("model_dates", f"SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM {{{{labelled}}}})) WHERE k > {CUTOFF}")
view("train_long", " UNION ALL ".join(f"SELECT ticker, date, y, {i} AS v, '{c}' AS variable, CAST({c} AS DOUBLE) AS x FROM {{{{labelled}}}}" for i, c in enumerate(VARIABLES)))
view("cuts", f"""SELECT v, variable, cut, row_number() OVER (PARTITION BY v ORDER BY cut) AS b FROM (
    SELECT v, variable, unnest(list_distinct(quantile_cont(x, {[i / BINS for i in range(1, BINS)]}))) AS cut FROM {{{{train_long}}}} WHERE date < (SELECT min(date) FROM {{{{model_dates}}}}) GROUP BY v, variable)
    UNION ALL SELECT v, variable, CAST('Infinity' AS DOUBLE), {BINS + 1} FROM (SELECT DISTINCT v, variable FROM {{{{train_long}}}})""")
view("stump_sums", """SELECT m.date AS model, c.v, c.variable, c.cut, c.b, sum(.5 - y) AS all_g, sum(.25) AS all_h,
    coalesce(sum(.5 - y) FILTER (x <= cut), 0) AS gl, coalesce(sum(.25) FILTER (x <= cut), 0) AS hl, coalesce(sum(.5 - y) FILTER (x IS NULL), 0) AS gm, coalesce(sum(.25) FILTER (x IS NULL), 0) AS hm
    FROM {{model_dates}} m JOIN {{train_long}} t ON t.date < m.date JOIN {{cuts}} c ON c.v = t.v GROUP BY ALL""")
view("stump_options", """SELECT model, v, variable, cut, b, r, CAST(all_g AS DOUBLE) AS all_g, CAST(all_h AS DOUBLE) AS all_h, CAST(CASE WHEN r = 1 THEN gl ELSE gl + gm END AS DOUBLE) AS g1, CAST(CASE WHEN r = 1 THEN hl ELSE hl + hm END AS DOUBLE) AS h1
    FROM {{stump_sums}}, (SELECT unnest([0, 1]) AS r)""")
view("stumps", f"""SELECT model, variable, cut, r = 0 AS missing_left, gain, -g1 / (h1 + 1) * {STUMP['eta']} AS on_left, -(all_g - g1) / (all_h - h1 + 1) * {STUMP['eta']} AS on_right FROM (
    SELECT *, g1 * g1 / (h1 + 1) + (all_g - g1) * (all_g - g1) / (all_h - h1 + 1) - all_g * all_g / (all_h + 1) AS gain FROM {{{{stump_options}}}} WHERE h1 >= 1 AND all_h - h1 >= 1)
    WHERE gain > {STUMP['gamma']} QUALIFY row_number() OVER (PARTITION BY model ORDER BY gain DESC, v, b, r DESC) = 1""")


def _stumps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _rows(spark, d)
    dates = rows.select("date").distinct().orderBy("date").offset(CUTOFF).limit(1)
    cuts = bt.quantile_cuts(rows.join(F.broadcast(dates.toDF("_first")), F.col("date") < F.col("_first")), VARIABLES, BINS, exact=True)  # one row
    return bt.walk_forward_many(rows, "y", VARIABLES, CUTOFF, cuts=cuts, **STUMP)


@query("SELECT CAST(model AS VARCHAR) AS model_id, variable, CASE WHEN isfinite(cut) THEN round(cut, 6) END AS cut, missing_left, round(gain, 6) AS gain, round(on_left, 6) AS on_left, round(on_right, 6) AS on_right FROM {{stumps}}")
def boosted_stumps(spark: SparkSession, d: str) -> DataFrame:
    """The first tree, one cut deep, of the model of every date."""
    _, t = _stumps(spark, d)
    at = lambda n, c: F.max(F.when(F.col("node") == n, F.col(c)))
    one = t.groupBy("model_id").agg(at(1, "variable").alias("variable"), at(1, "cut").alias("cut"), at(1, "missing_left").alias("missing_left"), at(1, "gain").alias("gain"), at(2, "value").alias("on_left"), at(3, "value").alias("on_right"))
    return rounded(one.where("variable is not null"))


@query("""SELECT date, ticker, round(pred, 6) AS pred, ptf_rank, next_month_return FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY pred DESC, ticker) AS ptf_rank FROM (
    SELECT l.date, l.ticker, l.next_month_return, round(1 / (1 + exp(-coalesce(CASE WHEN t.x IS NULL THEN CASE WHEN missing_left THEN on_left ELSE on_right END WHEN t.x <= cut THEN on_left ELSE on_right END,
      -(SELECT CAST(max(all_g) / (max(all_h) + 1) AS DOUBLE) FROM {{stump_sums}} g WHERE g.model = l.date) * .3))), 9) AS pred
    FROM {{labelled}} l JOIN {{model_dates}} m USING (date) LEFT JOIN {{stumps}} s ON s.model = l.date LEFT JOIN {{train_long}} t ON t.date = l.date AND t.ticker = l.ticker AND t.variable = s.variable)) WHERE ptf_rank <= 10""")
def walk_forward_stumps(spark: SparkSession, d: str) -> DataFrame:
    """Each date's ten best predictions by the stump of earlier dates."""
    pred, _ = _stumps(spark, d)
    out = pf.top_n(pred.withColumn("pred", stable_round("pred", 9)), "pred", 10, ["date"], "ticker", descending=True)
    return rounded(out.select("date", "ticker", "pred", "ptf_rank", "next_month_return"), 6, "next_month_return")


@query()
def walk_forward_boosted(spark: SparkSession, d: str) -> DataFrame:
    """Trees of depth three for every date, all dates together."""
    pred, _ = bt.walk_forward_many(_rows(spark, d), "y", VARIABLES, CUTOFF, trees=6, depth=3)
    out = pf.top_n(pred.withColumn("pred", stable_round("pred", 9)), "pred", 10, ["date"], "ticker", descending=True)
    return rounded(out.select("date", "ticker", "pred", "ptf_rank", "next_month_return"), 6, "next_month_return")


@query()
def boosted_importance(spark: SparkSession, d: str) -> DataFrame:
    """Share of each variable in the gains of every date's model."""
    _, models = bt.walk_forward_many(_rows(spark, d), "y", VARIABLES, CUTOFF, trees=2, depth=2)
    return rounded(bt.importance(models))


# The axes of the search in the source material.
SPACE = {"depth": [3, 4, 5], "eta": [0.05, 0.1, 0.15, 0.2, 0.25], "gamma": [10, 20, 30, 40, 50, 60], "columns": [0.1, 0.3, 0.5, 0.7, 1.0], "pos_weight": [5, 7, 10, 15]}


@query()
def boosted_search(spark: SparkSession, d: str) -> DataFrame:
    """A hundred draws of the six-axis space (subsampling has one value, 1) x three folds, 300 models together."""
    return rounded(bt.search_many(_rows(spark, d), "y", VARIABLES, SPACE, draws=100, folds=3, trees=3))


@query("""SELECT date, ticker, variable, round(CASE WHEN on_it THEN on_left ELSE on_right END - (on_left * cover_left + on_right * (all_h - cover_left)) / all_h, 6) AS contribution FROM (
    SELECT l.date, l.ticker, s.variable, s.on_left, s.on_right, o.h1 AS cover_left, o.all_h, CASE WHEN t.x IS NULL THEN s.missing_left ELSE t.x <= s.cut END AS on_it
    FROM {{labelled}} l JOIN {{stumps}} s ON s.model = l.date JOIN {{train_long}} t ON t.date = l.date AND t.ticker = l.ticker AND t.variable = s.variable
    JOIN {{stump_options}} o ON o.model = s.model AND o.variable = s.variable AND o.cut = s.cut AND (o.r = 0) = s.missing_left) WHERE on_left <> on_right""")
def stump_explanations(spark: SparkSession, d: str) -> DataFrame:
    """What the one variable of each date's stump adds to its predictions."""
    pred, table = _stumps(spark, d)
    out = ex.explain(pred.select("date", "ticker", "model_id", *VARIABLES), table, VARIABLES)
    return rounded(ex.contributions(out, VARIABLES, ["date", "ticker"]))


@query()
def forest_explanations(spark: SparkSession, d: str) -> DataFrame:
    """Mean size of every variable's contribution to a forest's predictions, by date."""
    from barline.operators import models

    rows = _rows(spark, d).dropna(subset=VARIABLES)
    forest = models.pipeline("rf_reg", "next_month_return", VARIABLES, numTrees=5, maxDepth=4, seed=1).fit(rows)
    out = ex.explain(rows.select("date", "ticker", F.lit("m").alias("model_id"), *VARIABLES), ex.node_table(forest.stages[-1], VARIABLES), VARIABLES)
    return rounded(ex.contributions(out, VARIABLES, ["date"]).groupBy("date", "variable").agg(F.avg(F.abs("contribution")).alias("mean_size"), F.count("*").alias("n")))


@query()
def swapped_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Changes over a year against changes over three months, variable by variable."""
    from barline.operators import models

    w = Window.partitionBy("ticker").orderBy("date")
    changed = {f"{c}_{name}": F.try_divide(c, F.lag(c, n).over(w)) - 1 for c in ("px_close", "marketcap", "pe") for name, n in (("yoy", 12), ("3mom", 3))}
    rows = _rows(spark, d).withColumns(changed)
    early, late = models.split_by_date(kept(rows, "rows"))
    return rounded(bt.swap_prefixes(early, late, "y", ["px_close_yoy", "marketcap_yoy", "pe_yoy"], {"yoy": "3mom", "dyoy": "d3mom"}, trees=3, depth=3))


REGISTERED = {1: ["px_pct_1m", "pe", "marketcap"], 2: ["px_pct_3m", "pb"]}


@query("""WITH v AS (""" + " UNION ALL ".join(f"SELECT {m} AS model_id, '{c}' AS name, round(abs(corr({c}, next_month_return)), 6) AS value FROM {{{{panel}}}}" for m, cs in REGISTERED.items() for c in cs) + """)
    SELECT CAST(model_id AS BIGINT) AS model_id, 'variable' AS kind, name, CAST(NULL AS VARCHAR) AS text, value FROM v
    UNION ALL SELECT m, 'parameter', p, CASE p WHEN 'depth' THEN '3' ELSE CAST(m * 10 AS VARCHAR) END, NULL FROM (SELECT unnest([1, 2]) AS m), (SELECT unnest(['depth', 'trees']) AS p)""")
def model_registry(spark: SparkSession, d: str) -> DataFrame:
    """Parameters and variables of two models, appended to the registry under the next free id."""
    from barline.operators import models
    from barline.session import shared_folder

    base, p = shared_folder(spark, "registry"), panel(spark, d)
    spark.createDataFrame([], "parameter string, value string, model_id long").write.parquet(f"{base}/parameters")
    for cs in REGISTERED.values():
        one = p.agg(*[F.abs(F.corr(c, "next_month_return")).alias(c) for c in cs])
        number = models.next_id(spark.read.parquet(f"{base}/parameters"))
        parameters, variables = models.registry_rows(number, {"depth": 3, "trees": number * 10}, one.unpivot([], cs, "variable", "importance"), spark)
        parameters.write.mode("append").parquet(f"{base}/parameters")
        variables.write.mode("append").parquet(f"{base}/variables")
    a = spark.read.parquet(f"{base}/variables").select("model_id", F.lit("variable").alias("kind"), F.col("variable").alias("name"), F.lit(None).cast("string").alias("text"), stable_round("importance", 6).alias("value"))
    b = spark.read.parquet(f"{base}/parameters").select("model_id", F.lit("parameter").alias("kind"), F.col("parameter").alias("name"), F.col("value").alias("text"), F.lit(None).cast("double").alias("value"))
    return a.unionByName(b)
