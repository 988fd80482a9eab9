"""Queries: ratios of long tables, pivots, grids, null handling, sinks, further models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.functions.columns import stable_round
from barline.operators import features as ft
from barline.operators import models
from barline.operators import relational as rel
from barline.operators import signals as sg
from barline.operators.bars import period_close, whole_bar
from barline.plans.features import rounded
from barline.plans.joins import BRANDS, months
from barline.plans.portfolios import RANKED, panel
from barline.plans.registry import query, view
from barline.plans.research import VARIABLES, _rows
from barline.plans.signals import LONG, SHORT, color, px
from barline.session import kept, shared_folder
from barline.sources import canonical as src
from barline.sources.readers import append_log, create_as, dated_name, insert_into, read_csv, read_files, read_table, truncate, write_snapshot, write_table

PAIRS = [("closeadj_close_mean_4w", "closeadj_close_mean_12w"), ("closeadj_close_mean_4w", "closeadj_close_mean_24w"), ("closeadj_close_mean_12w", "closeadj_close_mean_24w"), ("closeadj_close_vol_12w", "closeadj_close_vol_24w")]
_NAMED = [(a, b, f"{a}_by_{b.rsplit('_', 1)[1]}") for a, b in PAIRS]
_ROLL = {"mean": ("avg", [4, 12, 24], 5), "vol": ("stddev_samp", [12, 24], 4)}
_FIELDS = " UNION ALL ".join(
    f"SELECT ticker, date_start, date_end, 'closeadj_close_{k}_{n}w' AS field, CASE WHEN row_number() OVER (PARTITION BY ticker ORDER BY date_start) >= {n} THEN round({f}(value) OVER (PARTITION BY ticker ORDER BY date_start ROWS {n - 1} PRECEDING), {digits}) END AS value FROM {{{{weekly_close}}}}"
    for k, (f, ns, digits) in _ROLL.items()
    for n in ns
)


@query(f"WITH f AS (SELECT * FROM ({_FIELDS}) WHERE value IS NOT NULL) " + " UNION ALL ".join(f"SELECT a.ticker, a.date_start, a.date_end, '{n}' AS field, round(a.value / nullif(b.value, 0), 5) AS value FROM f a JOIN f b USING (ticker, date_start) WHERE a.field = '{x}' AND b.field = '{y}'" for x, y, n in _NAMED))
def eav_ratio_pairs(spark: SparkSession, d: str) -> DataFrame:
    close = period_close(src.prices(spark, d), "closeadj")
    parts = [ft.long_change(close, "closeadj_close", ns, "w", k).withColumn("value", stable_round("value", digits)) for k, (_, ns, digits) in _ROLL.items()]
    long = parts[0].unionByName(parts[1]).where("value is not null")
    return ft.long_ratios(long, _NAMED).withColumn("value", stable_round("value", 5))


@query("SELECT date, " + ", ".join(f"max(px_close) FILTER (ticker = '{b}') AS \"{b}\"" for b in BRANDS) + " FROM {{months}} GROUP BY date")
def pivot_first(spark: SparkSession, d: str) -> DataFrame:
    long = months(spark, d).select("date", F.col("ticker").alias("field"), F.col("px_close").alias("value"))
    return rel.pivot_long(long, ["date"], BRANDS)


@query("SELECT t.ticker, d.date, m.px_close FROM (SELECT DISTINCT ticker FROM {{months}}) t CROSS JOIN (SELECT DISTINCT date FROM {{months}}) d LEFT JOIN {{months}} m ON m.ticker = t.ticker AND m.date = d.date")
def full_reindex(spark: SparkSession, d: str) -> DataFrame:
    return rel.reindex(months(spark, d).select("ticker", "date", "px_close"), "ticker", "date")


@query("SELECT draw, variable FROM (SELECT draw, variable, row_number() OVER (PARTITION BY draw ORDER BY md5(draw || '-' || variable || '-1'), variable) AS n FROM (SELECT unnest(range(0, 2000)) AS draw), (SELECT DISTINCT p_type AS variable FROM part)) WHERE n <= 3")
def variable_draws(spark: SparkSession, d: str) -> DataFrame:
    """Two thousand draws of three names out of those in a table."""
    return rel.sample_draws(read_table(spark, d, "part", ["p_type"]).select(F.col("p_type").alias("variable")).distinct(), 2000, 3)


@query("SELECT CAST(coalesce(max(p_partkey), 0) + 1 AS BIGINT) AS model_id FROM part")
def next_model_id(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(models.next_id(read_table(spark, d, "part", ["p_partkey"]), "p_partkey"),)], "model_id long")


_ALL = ["pe", "pb", "px_pct_3m", "px_pct_6m"]


@query("SELECT how, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS how FROM {{{{panel}}}} WHERE {w}" for k, w in (("any", " AND ".join(f"{c} IS NOT NULL" for c in _ALL)), ("all", " OR ".join(f"{c} IS NOT NULL" for c in _ALL[2:])), ("subset", "px_pct_6m IS NOT NULL"))) + ") GROUP BY how")
def null_row_filters(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d).select("ticker", "date", *_ALL)
    kinds = (("any", rel.drop_null_rows(p)), ("all", rel.drop_null_rows(p, "all", _ALL[2:])), ("subset", rel.drop_null_rows(p, "any", ["px_pct_6m"])))
    tell = lambda k, x: x.groupBy(F.lit(k).alias("how")).agg(F.count("*").alias("n"))
    return tell(*kinds[0]).unionByName(tell(*kinds[1])).unionByName(tell(*kinds[2]))


@query("SELECT ticker, date, pe, ps FROM {{panel}}")
def guarded_projection(spark: SparkSession, d: str) -> DataFrame:
    return rel.project_unless(panel(spark, d), ["ticker", "date", "pe", "pb", "ps", "absent"], ["pb"])


@query("SELECT ticker, date, last_value(px_pct_6m IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS 3 PRECEDING) AS px_pct_6m FROM (SELECT ticker, date, CASE WHEN month(date) NOT IN (2, 3, 4, 5, 6) THEN px_pct_6m END AS px_pct_6m FROM {{panel}})")
def limited_fill(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d).select("ticker", "date", F.when(~F.month("date").isin(2, 3, 4, 5, 6), F.col("px_pct_6m")).alias("px_pct_6m"))
    return ft.limited_ffill(p, "ticker", "date", "px_pct_6m", 3)


_KNOWN = "SELECT ticker, date, x, y, m, lag(m) OVER w AS b0, lag(m, 2) OVER w AS a0, lead(m) OVER w AS d0, row_number() OVER w AS i, count(*) OVER (PARTITION BY ticker) AS n FROM (SELECT *, (lead(y) OVER v - y) / (lead(x) OVER v - x) AS m FROM t WHERE y IS NOT NULL WINDOW v AS (PARTITION BY ticker ORDER BY x)) WINDOW w AS (PARTITION BY ticker ORDER BY x)"


@query(f"""WITH t AS (SELECT ticker, date, date_diff('day', DATE '1970-01-01', date) AS x, CASE WHEN month(date) NOT IN (3, 4, 7, 8, 9) THEN px_pct_6m END AS y FROM {{{{panel}}}}), k AS ({_KNOWN}),
    e AS (SELECT ticker, max(m) FILTER (i = 1) AS f, coalesce(max(m) FILTER (i = 2), max(m) FILTER (i = 1)) AS g, max(m) FILTER (i = n - 1) AS p, coalesce(max(m) FILTER (i = n - 2), max(m) FILTER (i = n - 1)) AS q FROM k GROUP BY ticker),
    s AS (SELECT ticker, x, y, m, i, n, coalesce(a0, CASE i WHEN 1 THEN 3 * f - 2 * g ELSE 2 * f - g END) AS a, coalesce(b0, 2 * f - g) AS b, coalesce(m, 2 * p - q) AS c, coalesce(d0, CASE i WHEN n THEN 3 * p - 2 * q ELSE 2 * p - q END) AS d FROM k JOIN e USING (ticker)),
    u AS (SELECT *, CASE WHEN abs(d - c) + abs(b - a) > 1e-9 * max(abs(d - c) + abs(b - a)) OVER (PARTITION BY ticker) THEN (abs(d - c) * b + abs(b - a) * c) / (abs(d - c) + abs(b - a)) ELSE (a + d) / 2 END AS g FROM s),
    r AS (SELECT ticker, x AS x0, y AS y0, m, g AS g0, lead(g) OVER w AS g1, lead(x) OVER w AS x1 FROM u WINDOW w AS (PARTITION BY ticker ORDER BY x))
    SELECT t.ticker, t.date, round(CASE WHEN y IS NOT NULL THEN y ELSE y0 + g0 * (x - x0) + (3 * m - 2 * g0 - g1) / (x1 - x0) * (x - x0) * (x - x0) + (g0 + g1 - 2 * m) / ((x1 - x0) * (x1 - x0)) * (x - x0) * (x - x0) * (x - x0) END, 6) AS px_pct_6m FROM t LEFT JOIN r ON r.ticker = t.ticker AND t.x > r.x0 AND t.x < r.x1""")
def akima_fill(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d).select("ticker", "date", F.when(~F.month("date").isin(3, 4, 7, 8, 9), F.col("px_pct_6m")).alias("px_pct_6m"))
    return rounded(ft.akima_fill(p, "ticker", "date", "px_pct_6m"))


_QUIET = "CASE WHEN ticker IN ('Brand#12', 'Brand#34') AND date > DATE '1997-06-30' THEN NULL ELSE px_close END"


@query(f"WITH m AS (SELECT ticker, date, {_QUIET} AS px_close FROM {{{{months}}}}) SELECT * FROM m WHERE ticker IN (SELECT ticker FROM m WHERE px_close IS NOT NULL GROUP BY ticker HAVING max(date) >= (SELECT max(date) FROM m) - 180)")
def recent_series(spark: SparkSession, d: str) -> DataFrame:
    return rel.recent_series(months(spark, d).select("ticker", "date", F.expr(_QUIET).alias("px_close")), "ticker", "date", "px_close", 180)


@query("SELECT symbol, time_close, round(ao, 6) AS ao, CAST(ao_color AS BIGINT) AS ao_color, CAST(long_signal AS BIGINT) AS long_signal, CAST(short_signal AS BIGINT) AS short_signal FROM {{ao_signal}} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time_close DESC) = 1")
def live_candle(spark: SparkSession, d: str) -> DataFrame:
    """Bars kept so far, and the last hour's two half-hour bars as one candle appended; signals anew, the last of each symbol."""
    bars, last = px(spark, d), Window.partitionBy("symbol")
    marked = bars.withColumn("_last", F.max("time_open").over(last))
    history = marked.where("time_open < _last").drop("_last")
    halves = marked.where("time_open = _last").select("symbol", F.explode(F.expr("array(named_struct('t', time_open, 'c', low, 'h', high, 'l', low), named_struct('t', time_open + INTERVAL 30 MINUTES, 'c', close, 'h', high, 'l', low))")).alias("b"))
    live = whole_bar(halves.select("symbol", F.col("b.t").alias("time_open"), F.col("b.c").alias("close"), F.col("b.h").alias("high"), F.col("b.l").alias("low")), ["symbol"])
    both = history.unionByName(live.withColumn("time_close", F.col("time_open") + F.expr("INTERVAL 1 HOUR")))
    out = rel.last_of(sg.color_signals(color(sg.awesome_oscillator(both, SHORT, LONG))), "symbol", "time_close")
    return rounded(out.select("symbol", "time_close", "ao", *[F.col(c).cast("long") for c in ("ao_color", "long_signal", "short_signal")]))


@query("SELECT run_date, ticker, count(*) AS n, round(sum(px_close), 4) AS px FROM (SELECT DATE '2000-01-31' AS run_date, * FROM {{months}} WHERE date < DATE '1996-01-01' UNION ALL SELECT DATE '2000-02-29', * FROM {{months}}) GROUP BY ALL")
def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """A table written anew for each run date, appended as a partition of its own; a run date written twice replaces itself alone."""
    path, rows = f"{shared_folder(spark, 'snapshots')}/table", months(spark, d).select("ticker", "date", "px_close")
    for day, part in (("2000-01-31", rows.limit(3)), ("2000-01-31", rows.where("date < '1996-01-01'")), ("2000-02-29", rows)):
        write_snapshot(part, path, day)
    return spark.read.parquet(path).groupBy("run_date", "ticker").agg(F.count("*").alias("n"), stable_round(F.sum("px_close"), 4).alias("px"))


@query("SELECT ticker, date, px_close FROM {{months}} WHERE date IS NOT NULL")
def files_scan(spark: SparkSession, d: str) -> DataFrame:
    """Several files as one table: one that can't be read, rows that miss a key."""
    base, rows = shared_folder(spark, "files"), months(spark, d).select("ticker", "date", "px_close")
    for k, part in (("early", rows.where("date < '1995-01-01'")), ("late", rows.where("date >= '1995-01-01'")), ("keyless", rows.withColumn("date", F.lit(None).cast("date")))):
        write_table(part, f"{base}/{k}")
    spark.createDataFrame([("no Parquet",)], "value string").coalesce(1).write.text(f"{base}/broken")
    return read_files(spark, [f"{base}/{k}" for k in ("early", "late", "keyless")] + [f"{base}/broken/*.txt"], ["date"], schema=rows.schema)


@query("""SELECT 'overwrite' AS step, ticker, count(*) AS n FROM {{months}} GROUP BY ticker UNION ALL SELECT 'append', ticker, 2 * count(*) FROM {{months}} GROUP BY ticker
    UNION ALL SELECT 'insert', ticker, count(*) + count(*) FILTER (px_close > 20) FROM {{months}} GROUP BY ticker UNION ALL SELECT 'csv', ticker, count(*) FROM {{months}} GROUP BY ticker UNION ALL SELECT 'log', 'run', 2""")
def sinks(spark: SparkSession, d: str) -> DataFrame:
    """Tables written and read back: overwritten, appended to, created and inserted into by SQL, as CSV, emptied, and a log of runs."""
    base, rows = shared_folder(spark, "sinks"), months(spark, d).select("ticker", "date", "px_close")
    write_table(rows.limit(1), f"{base}/overwrite")
    write_table(rows, f"{base}/overwrite")
    for _ in range(2):
        write_table(rows, f"{base}/append", "append")
    rows.createOrReplaceTempView("sink_rows")
    write_table(rows, f"{base}/insert")
    write_table(spark.sql("SELECT * FROM sink_rows WHERE px_close > 20"), f"{base}/insert", "append")
    write_table(rows, f"{base}/csv", form="csv")
    write_table(rows, f"{base}/gone")
    truncate(spark, f"{base}/gone")
    for status in ("ok", "failed"):
        append_log(spark, f"{base}/log", "run", status, "months")
    count = lambda step, df: df.groupBy("ticker").agg(F.count("*").alias("n")).select(F.lit(step).alias("step"), "ticker", "n")
    parts = [count(k, spark.read.parquet(f"{base}/{k}")) for k in ("overwrite", "append", "insert", "gone")]
    parts.append(count("csv", read_csv(spark, f"{base}/csv", "ticker string, date date, px_close double")))
    parts.append(spark.read.parquet(f"{base}/log").groupBy(F.col("kind").alias("ticker")).agg(F.count("*").alias("n")).select(F.lit("log").alias("step"), "ticker", "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""SELECT 'created' AS step, strftime(date, '%Y%m') AS suffix, count(*) AS n FROM {{months}} WHERE px_close > 20 GROUP BY ALL UNION ALL SELECT 'inserted', strftime(date, '%Y%m'), count(*) FROM {{months}} GROUP BY ALL
    UNION ALL SELECT 'dated', '199512', count(*) FROM {{months}} WHERE date <= DATE '1995-12-31' UNION ALL SELECT 'dated', '199612', count(*) FROM {{months}} WHERE date <= DATE '1996-12-31'""")
def catalog_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables of the catalogue: created as a SELECT, inserted into by one, and with the month as a suffix of their name."""
    rows, base = months(spark, d).select("ticker", "date", "px_close"), shared_folder(spark, "catalog")
    name = f"months_{base.rsplit('-', 1)[1]}"
    create_as(rows.where("px_close > 20"), f"{name}_created", f"{base}/created")
    create_as(rows.where("px_close > 20"), f"{name}_inserted", f"{base}/inserted")
    insert_into(rows.where("px_close <= 20 or px_close is null"), f"{name}_inserted")
    for day in ("1995-12-31", "1996-12-31"):
        create_as(rows.where(F.col("date") <= F.lit(day).cast("date")), dated_name(name, day), f"{base}/{day}")
    suffix = F.date_format("date", "yyyyMM").alias("suffix")
    parts = [spark.table(f"{name}_{k}").groupBy(suffix).agg(F.count("*").alias("n")).select(F.lit(k).alias("step"), "suffix", "n") for k in ("created", "inserted")]
    parts += [spark.table(f"{name}_{s}").agg(F.count("*").alias("n")).select(F.lit("dated").alias("step"), F.lit(s).alias("suffix"), "n") for s in ("199512", "199612")]
    return reduce(DataFrame.unionByName, parts)


@query()
def walk_forward_regressor(spark: SparkSession, d: str) -> DataFrame:
    out = models.walk_forward(_rows(spark, d), "next_month_return", VARIABLES, cutoff=60, algorithm="gbt_reg", n=10, maxIter=3, maxDepth=3, seed=1)
    return rounded(out.select("date", "ticker", "pred", "ptf_rank", "next_month_return"))


@query()
def walk_forward_variants(spark: SparkSession, d: str) -> DataFrame:
    """Rows with few variables away, with a threshold and without; training on tickers with history; out of the larger half; held names.

    Fitted once for each choice of rows; the predictions are written and chosen from.
    """
    rows, base = _rows(spark, d), shared_folder(spark, "predictions")
    rows = rows.withColumn("mcap_pct_rank", F.percent_rank().over(Window.partitionBy("date").orderBy(F.desc("marketcap"))))
    fits = {"all": {}, "sparse": {"drop_sparse": True}, "history": {"min_train_rows": 3}}
    for name, options in fits.items():
        write_table(models.walk_forward_predictions(rows, "y", VARIABLES, cutoff=60, maxIter=2, maxDepth=2, seed=1, **options), f"{base}/{name}")
    source = {"sparse": "sparse", "sparse_threshold": "sparse", "history": "history"}
    parts = [models.predicted_portfolio(spark.read.parquet(f"{base}/{source.get(n, 'all')}"), 6, **o).select(F.lit(n).alias("variant"), "date", "ticker", "pred") for n, o in CHOSEN.items()]
    return rounded(reduce(DataFrame.unionByName, parts))


#: Variants of a portfolio of predictions; at most six names on the first date and seven after it, where names are held.
CHOSEN = {
    "plain": {}, "sparse": {}, "sparse_threshold": {"threshold": 0.3}, "threshold": {"threshold": 0.3}, "history": {},
    "half": {"mcap_half": True}, "half_threshold": {"mcap_half": True, "threshold": 0.3}, "held": {"held_pool": 13},
}
GIVEN = {k: CHOSEN[k] for k in ("plain", "threshold", "half", "half_threshold", "held")}
# a score in place of a fit: deterministic, with ties, and with dates on which few pass the threshold
view("given", "SELECT date, ticker, round(abs(sin(date_diff('day', DATE '1970-01-01', date) * 7 + CAST(substr(ticker, 7) AS INTEGER) * 13)) * (.25 + (month(date) % 4) * .25), 2) AS pred, percent_rank() OVER (PARTITION BY date ORDER BY marketcap DESC NULLS LAST) AS mcap FROM {{panel}}")


def _variant(name: str, o: dict) -> str:
    """SQL of a variant over given predictions; held names a date after the other."""
    some = f"SELECT date, ticker, pred, row_number() OVER (PARTITION BY date ORDER BY pred DESC, ticker) AS n FROM {{{{given}}}} {'WHERE mcap <= .5' if o.get('mcap_half') else ''}"
    if "threshold" not in o and "held_pool" not in o:
        return f"SELECT '{name}' AS variant, date, ticker, pred FROM ({some}) WHERE n <= 6"
    pool = o.get("held_pool", 7)
    listed = f"SELECT * FROM c WHERE n <= {pool}" if "threshold" not in o else f"SELECT c.* FROM c JOIN (SELECT date, least({o['threshold']}, min(pred) FILTER (n <= {pool})) AS floor FROM c GROUP BY date) f USING (date) WHERE pred >= floor"
    return f"""SELECT * FROM (WITH RECURSIVE c AS ({some}), l AS (SELECT date, list(ticker ORDER BY n) AS names, row_number() OVER (ORDER BY date) AS k FROM ({listed}) GROUP BY date),
        s AS (SELECT k, date, names[1:6] AS now FROM l WHERE k = 1 UNION ALL
          SELECT l.k, l.date, list_concat(list_filter(l.names, lambda x: list_contains(s.now, x)), list_filter(l.names, lambda x: NOT list_contains(s.now, x)))[1:7] FROM s JOIN l ON l.k = s.k + 1)
        SELECT '{name}' AS variant, u.date, u.ticker, c.pred FROM (SELECT date, unnest(now) AS ticker FROM s) u JOIN c ON c.date = u.date AND c.ticker = u.ticker)"""


@query(" UNION ALL ".join(f"({_variant(k, o)})" for k, o in GIVEN.items()))
def portfolio_variants(spark: SparkSession, d: str) -> DataFrame:
    """The variants over given predictions, so that what they hold can be told exactly."""
    p = panel(spark, d)
    score = F.abs(F.sin(F.unix_date("date") * 7 + F.substring("ticker", 7, 9).cast("int") * 13)) * (0.25 + (F.month("date") % 4) * 0.25)
    given = p.select("date", "ticker", stable_round(score, 2).alias("pred"), F.percent_rank().over(Window.partitionBy("date").orderBy(F.desc_nulls_last("marketcap"))).alias("mcap_pct_rank"))
    parts = [models.predicted_portfolio(given, 6, **o).select(F.lit(k).alias("variant"), "date", "ticker", "pred") for k, o in GIVEN.items()]
    return reduce(DataFrame.unionByName, parts)


@query()
def swapped_variables(spark: SparkSession, d: str) -> DataFrame:
    """Two variables, and all others as candidates in their places."""
    early, late = models.split_by_date(kept(_rows(spark, d), "rows"))
    chosen, score = models.swap_test(early, late, "y", VARIABLES[:2], VARIABLES[2:], maxIter=2, maxDepth=2, seed=1)
    return spark.createDataFrame([(i, v, float(score)) for i, v in enumerate(chosen)], "place int, variable string, f1 double")
