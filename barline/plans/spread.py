"""Queries: ranks, correlations, windows and grids whose work spreads over all tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.functions.columns import stable_round
from barline.operators import bars
from barline.operators import spread as sp
from barline.plans.bars import hours
from barline.plans.features import day_px, rounded
from barline.plans.portfolios import panel
from barline.plans.registry import query, view
from barline.sources.readers import read_table

_PRICE = "CASE WHEN l_quantity > 3 THEN l_extendedprice END"
_BY = "PARTITION BY l_returnflag"


@query(f"""SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN p IS NOT NULL THEN rank() OVER ({_BY} ORDER BY p DESC NULLS LAST) END AS rank, CASE WHEN p IS NOT NULL THEN dense_rank() OVER ({_BY} ORDER BY p DESC NULLS LAST) END AS dense_rank,
    round(CASE WHEN p IS NOT NULL THEN rank() OVER ({_BY} ORDER BY p DESC NULLS LAST) + (count(*) OVER (PARTITION BY l_returnflag, p) - 1) / 2 END, 1) AS average_rank,
    round(CASE WHEN p IS NOT NULL THEN (rank() OVER ({_BY} ORDER BY p DESC NULLS LAST) + (count(*) OVER (PARTITION BY l_returnflag, p) - 1) / 2) / count(p) OVER ({_BY}) END, 9) AS pct_rank,
    round(percent_rank() OVER ({_BY} ORDER BY p DESC NULLS LAST), 9) AS percent_rank FROM (SELECT *, {_PRICE} AS p FROM lineitem)""")
def spread_ranks(spark: SparkSession, d: str) -> DataFrame:
    """All ranks of all line items within three groups: none of them in one task."""
    rows = read_table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice"])
    out = sp.spread_ranks(rows.select("l_orderkey", "l_linenumber", "l_returnflag", F.expr(_PRICE).alias("p")), "p", ["l_returnflag"])
    return out.select("l_orderkey", "l_linenumber", "l_returnflag", "rank", "dense_rank", stable_round("average_rank", 1).alias("average_rank"), *[stable_round(c, 9).alias(c) for c in ("pct_rank", "percent_rank")])


NUMBERS = ["px_close", "px_pct_1m", "px_pct_2m", "px_pct_3m", "px_pct_6m", "volume", "marketcap", "pe", "pb", "ps"]
LAGGED = [*NUMBERS, *[f"{c}_l{k}" for c in NUMBERS for k in (1, 2)]]
view("lagged", "SELECT *, " + ", ".join(f"lag({c}, {k}) OVER (PARTITION BY ticker ORDER BY date) AS {c}_l{k}" for c in NUMBERS for k in (1, 2)) + " FROM {{panel}}")


@query(" UNION ALL ".join(f"SELECT '{a}' AS var_1, '{b}' AS var_2, round(corr({a}, {b}), 6) AS corr FROM {{{{lagged}}}}" for i, a in enumerate(LAGGED) for b in LAGGED[i + 1 :]))
def corr_gram(spark: SparkSession, d: str) -> DataFrame:
    """The 435 pairs of thirty variables, from block sums."""
    w = Window.partitionBy("ticker").orderBy("date")
    p = panel(spark, d).select("*", *[F.lag(c, k).over(w).alias(f"{c}_l{k}") for c in NUMBERS for k in (1, 2)])
    return rounded(sp.gram_correlations(p, LAGGED))


@query("""WITH w AS (SELECT id, date, list(px_pct_1d) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS x, count(px_pct_1d) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS n,
      px_pct_1d AS label, row_number() OVER (PARTITION BY id ORDER BY date) AS rn, count(*) OVER (PARTITION BY id) AS total FROM {{day_px}})
    SELECT id, date, round(list_sum(x), 5) AS window_sum, CAST(len(x) AS BIGINT) AS window_size, label, rn <= 0.8 * total AS is_train FROM w WHERE n = 5 AND len(x) = 5 AND label IS NOT NULL""")
def tensor_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The windows of ``tensor_windows``, read from chunks that share their values."""
    t = sp.chunk_windows(sp.tensor_chunks(day_px(spark, d), "id", "date", "px_pct_1d", 5, "px_pct_1d", size=8), "id", 5)
    total = F.aggregate("window", F.lit(0.0), lambda a, x: a + x)
    return t.select("id", F.col("t").alias("date"), stable_round(total, 5).alias("window_sum"), F.size("window").cast("long").alias("window_size"), "label", "is_train")


@query("""SELECT g.id, g.ts, round(h.px, 6) AS px, round(coalesce(h.marketcap, 0), 6) AS marketcap, round(coalesce(h.volume, 0), 6) AS volume FROM (
      SELECT a.id, b.ts FROM (SELECT id, min(ts) AS first_ts FROM {{hours}} GROUP BY id) a LEFT JOIN (SELECT DISTINCT ts FROM {{hours}}) b ON b.ts >= a.first_ts) g
    LEFT JOIN {{hours}} h ON g.id = h.id AND g.ts = h.ts""")
def key_grid_spread(spark: SparkSession, d: str) -> DataFrame:
    """The dense key grid by an interval join whose bins are split where they are hot."""
    h = hours(spark, d)
    out = bars.filled_grid(sp.spread_key_grid(h, h, most=2), h)
    return out.select("id", "ts", *[stable_round(c, 6).alias(c) for c in ("px", "marketcap", "volume")])


@query("SELECT o_orderkey, l_orderkey, l_linenumber FROM orders JOIN lineitem ON l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 1 DAY WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AND l_returnflag = 'R' AND l_quantity >= 49")
def interval_matches(spark: SparkSession, d: str) -> DataFrame:
    """Large returned items shipped within a day after an urgent order, whosever: intervals and points without a common key."""
    o = read_table(spark, d, "orders", ["o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus"]).where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
    i = read_table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_quantity"]).where("l_returnflag = 'R' and l_quantity >= 49")
    spans = o.select("o_orderkey", "o_orderdate", (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("_until"))
    return sp.interval_join(spans, i.select("l_orderkey", "l_linenumber", "l_shipdate"), "o_orderkey", "o_orderdate", "_until", "l_shipdate", 86_400, most=50).select("o_orderkey", "l_orderkey", "l_linenumber")
