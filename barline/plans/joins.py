"""Queries: joins, set operations, pivots, upserts, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.functions.columns import stable_round, truncated
from barline.operators import relational as rel
from barline.operators.bars import month_bars, period_close
from barline.plans.bars import months, weekly
from barline.plans.features import rounded
from barline.plans.registry import query, view
from barline.sources import canonical as src
from barline.sources.readers import candles_from_json, read_table, unnest_price_arrays

view("valuation_months", "SELECT ticker, last_day(max(date)) AS date, round(avg(ev), 2) AS ev, round(avg(evebit), 2) AS evebit, round(avg(marketcap), 2) AS marketcap, round(avg(pb), 4) AS pb, round(avg(pe), 4) AS pe, round(avg(ps), 4) AS ps FROM {{valuations}} GROUP BY ticker, year(date), month(date)")
FUND = ["revenue", "assets", "debt", "cashneq", "ebit", "intexp", "capex", "equity"]


def valuation_months(spark: SparkSession, d: str) -> DataFrame:
    v = src.valuations(spark, d)
    digits = {"ev": 2, "evebit": 2, "marketcap": 2, "pb": 4, "pe": 4, "ps": 4}
    return v.groupBy("ticker", F.trunc("date", "month").alias("_m")).agg(F.last_day(F.max("date")).alias("date"), *[stable_round(F.avg(c), n).alias(c) for c, n in digits.items()]).drop("_m")


@query("SELECT o_orderkey, o_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def inner_equi(spark: SparkSession, d: str) -> DataFrame:
    o, c = read_table(spark, d, "orders", ["o_orderkey", "o_custkey"]), read_table(spark, d, "customer", ["c_custkey", "c_mktsegment"])
    return o.join(c, o.o_custkey == c.c_custkey).where("c_mktsegment = 'BUILDING'").drop("c_custkey")


@query("SELECT m.ticker, m.date, m.px_close, v.marketcap, a.last_date, f.first_date FROM {{months}} m LEFT JOIN {{valuation_months}} v ON m.ticker = v.ticker AND m.date = v.date LEFT JOIN (SELECT ticker, max(date) AS last_date FROM {{actions}} GROUP BY 1) a ON m.ticker = a.ticker LEFT JOIN (SELECT ticker, min(date) AS first_date FROM {{prices}} GROUP BY 1) f ON m.ticker = f.ticker WHERE v.marketcap > 0")
def left_join_chain(spark: SparkSession, d: str) -> DataFrame:
    m = months(spark, d).select("ticker", "date", "px_close")
    gone = src.actions(spark, d).groupBy("ticker").agg(F.max("date").alias("last_date"))
    firsts = src.prices(spark, d).groupBy("ticker").agg(F.min("date").alias("first_date"))
    v = valuation_months(spark, d).select("ticker", "date", "marketcap")
    return m.join(v, ["ticker", "date"], "left").join(gone, "ticker", "left").join(firsts, "ticker", "left").where("marketcap > 0")


@query("SELECT h.ts, h.n_ids, count(e.event_id) AS n_events FROM (SELECT ts, count(*) AS n_ids FROM {{hours}} GROUP BY 1) h LEFT JOIN events e ON h.ts = date_trunc('hour', e.ts) GROUP BY ALL")
def derived_key_join(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events", ["event_id", "event_type", "ts"]).withColumn("hour", truncated("hour", "ts"))
    h = e.groupBy("hour").agg(F.countDistinct("event_type").alias("n_ids"))
    n = e.groupBy("hour").agg(F.count("event_id").alias("n_events"))
    return h.join(n, "hour", "left").select(F.col("hour").alias("ts"), "n_ids", "n_events")


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_new_ids(spark: SparkSession, d: str) -> DataFrame:
    orders = read_table(spark, d, "orders", ["o_custkey"]).withColumnRenamed("o_custkey", "c_custkey")
    return rel.not_in(read_table(spark, d, "customer", ["c_custkey"]), orders, ["c_custkey"]).distinct()


@query("SELECT ticker, date, closeadj FROM {{prices}} WHERE ticker IN (SELECT ticker FROM {{metadata}} WHERE sector IN ('S1', 'S2')) AND (ticker, date) IN (SELECT ticker, date FROM {{actions}})")
def semi_universe(spark: SparkSession, d: str) -> DataFrame:
    meta = src.metadata(spark, d).where(F.col("sector").isin("S1", "S2"))
    rows = rel.only_in(src.prices(spark, d).select("ticker", "date", "closeadj"), meta, ["ticker"])
    return rel.only_in(rows, src.actions(spark, d), ["ticker", "date"])


@query("SELECT ticker, date, closeadj FROM {{prices}} p WHERE NOT EXISTS (SELECT 1 FROM {{actions}} a WHERE a.ticker = p.ticker AND a.date = p.date)")
def anti_tuple(spark: SparkSession, d: str) -> DataFrame:
    return rel.not_in(src.prices(spark, d).select("ticker", "date", "closeadj"), src.actions(spark, d), ["ticker", "date"])


@query("""SELECT coalesce(a.k, b.k) AS custkey, a.n_orders, b.acctbal FROM (SELECT o_custkey AS k, count(*) AS n_orders FROM orders GROUP BY 1) a
    FULL JOIN (SELECT c_custkey AS k, c_acctbal AS acctbal FROM customer WHERE c_acctbal > 5000) b ON a.k = b.k""")
def full_outer_coalesce(spark: SparkSession, d: str) -> DataFrame:
    a = read_table(spark, d, "orders", ["o_custkey"]).groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias("n_orders"))
    b = read_table(spark, d, "customer", ["c_custkey", "c_acctbal"]).where("c_acctbal > 5000").select(F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("acctbal"))
    return a.join(b, "custkey", "full")


@query("SELECT p.ticker, p.date, m.px_close_avg FROM {{prices}} p JOIN {{months}} m ON p.ticker = m.ticker AND strftime(p.date, '%Y-%m') = strftime(m.date, '%Y-%m') WHERE p.volume > 40")
def month_bucket_join(spark: SparkSession, d: str) -> DataFrame:
    p = src.prices(spark, d).where("volume > 40").select("ticker", "date", F.trunc("date", "month").alias("m"))
    m = months(spark, d).select("ticker", F.trunc("date", "month").alias("m"), "px_close_avg")
    return p.join(m, ["ticker", "m"]).drop("m")


@query("SELECT w.ticker, w.date_start, w.value, p.closeadj FROM {{weekly_close}} w JOIN {{prices}} p ON w.ticker = p.ticker AND w.date_start - 3 = p.date")
def offset_date_join(spark: SparkSession, d: str) -> DataFrame:
    w = period_close(src.prices(spark, d), "closeadj").select("ticker", "date_start", "value", F.date_sub("date_start", 3).alias("date"))
    return w.join(src.prices(spark, d).select("ticker", "date", "closeadj"), ["ticker", "date"]).drop("date")


@query("SELECT w.ticker, w.date_start, w.value FROM {{weekly_close}} w JOIN (SELECT ticker, min(date) AS f FROM {{prices}} GROUP BY 1) a ON w.ticker = a.ticker AND w.date_start >= a.f + 90")
def equi_range_join(spark: SparkSession, d: str) -> DataFrame:
    p = src.prices(spark, d)
    firsts = p.groupBy("ticker").agg(F.min("date").alias("first_date"))
    return rel.after_ipo(period_close(p, "closeadj").select("ticker", "date_start", "value"), firsts, "ticker", "date_start")


_ASOF = ", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY v.ticker ORDER BY v.date ROWS UNBOUNDED PRECEDING) AS {c}" for c in ("revenue", "debt"))


@query(f"SELECT v.ticker, v.date, v.marketcap, {_ASOF} FROM {{{{valuation_months}}}} v LEFT JOIN (SELECT ticker, last_day(datekey) AS date, revenue, debt FROM {{{{fundamentals}}}}) f ON f.ticker = v.ticker AND f.date = v.date")
def asof_fill(spark: SparkSession, d: str) -> DataFrame:
    f = src.fundamentals(spark, d).select("ticker", F.last_day("datekey").alias("date"), "revenue", "debt")
    return rel.as_of_fill(f, valuation_months(spark, d).select("ticker", "date", "marketcap"), "ticker", "date")


@query("SELECT ticker, datekey, last_value(debt IGNORE NULLS) OVER w AS debt, last_value(ebit IGNORE NULLS) OVER w AS ebit FROM (SELECT ticker, datekey, debt, CASE WHEN ebit > 0 THEN ebit END AS ebit FROM {{fundamentals}}) WINDOW w AS (PARTITION BY ticker ORDER BY datekey ROWS UNBOUNDED PRECEDING)")
def group_ffill(spark: SparkSession, d: str) -> DataFrame:
    f = src.fundamentals(spark, d).select("ticker", "datekey", "debt", F.when(F.col("ebit") > 0, F.col("ebit")).alias("ebit"))
    return rel.group_ffill(f, "ticker", "datekey", ["debt", "ebit"])


@query("""SELECT w.ticker, w.date_start, w.value, p.closeadj, round(abs(w.value - p.closeadj), 6) AS diff FROM {{weekly_close}} w LEFT JOIN {{prices}} p ON w.ticker = p.ticker AND w.date_end = p.date""")
def reconcile_weekly_close(spark: SparkSession, d: str) -> DataFrame:
    w = period_close(src.prices(spark, d), "closeadj").select("ticker", "date_start", F.col("date_end").alias("date"), "value")
    return w.join(src.prices(spark, d).select("ticker", "date", "closeadj"), ["ticker", "date"], "left").select("ticker", "date_start", "value", "closeadj", stable_round(F.abs(F.col("value") - F.col("closeadj")), 6).alias("diff"))


@query("SELECT ticker, date_start, date_end, max(value) FILTER (field = 'closeadj_close') AS closeadj_close, max(value) FILTER (field = 'volume_avg') AS volume_avg FROM (SELECT * FROM {{weekly_close}} UNION ALL SELECT * FROM {{weekly_avg}}) GROUP BY ALL")
def eav_pivot(spark: SparkSession, d: str) -> DataFrame:
    return rel.pivot_long(weekly(spark, d), ["ticker", "date_start", "date_end"], ["closeadj_close", "volume_avg"])


BRANDS = [f"Brand#{i}{j}" for i in range(1, 6) for j in range(1, 6)]


@query("SELECT date, " + ", ".join(f"round(avg(px_close) FILTER (ticker = '{b}'), 6) AS \"{b}\"" for b in BRANDS) + " FROM {{months}} GROUP BY date")
def pivot_mean(spark: SparkSession, d: str) -> DataFrame:
    long = months(spark, d).select("date", F.col("ticker").alias("field"), F.col("px_close").alias("value"))
    return rounded(rel.pivot_long(long, ["date"], BRANDS, "avg"))


@query("UNPIVOT (SELECT ticker, datekey, " + ", ".join(FUND) + " FROM {{fundamentals}}) ON " + ", ".join(FUND) + " INTO NAME field VALUE value")
def eav_melt(spark: SparkSession, d: str) -> DataFrame:
    return rel.melt(src.fundamentals(spark, d), ["ticker", "datekey"], FUND).where("value is not null")


_NULLS = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in ["ticker", "dimension", "datekey", *FUND])


@query(f"SELECT ticker, datekey FROM {{{{fundamentals}}}} WHERE {_NULLS} <= 0")
def sparse_rows(spark: SparkSession, d: str) -> DataFrame:
    return rel.sparse_rows_out(src.fundamentals(spark, d), ["debt"]).select("ticker", "datekey")


def _profile(c: str) -> str:
    return f"SELECT '{c}' AS \"column\", count({c}) AS num, count(*) FILTER ({c} = 0) AS zeros, count(*) FILTER ({c} < 0) AS negatives, count(*) - count({c}) AS missing, count(*) FILTER ({c} = 0) / count(*) AS pct_zero, count(*) FILTER ({c} < 0) / count(*) AS pct_neg, (count(*) - count({c})) / count(*) AS pct_na, count(*) FILTER ({c} < 0) / count(*) > 0.01 AS has_neg FROM {{{{fundamentals}}}}"


@query(" UNION ALL ".join(_profile(c) for c in FUND))
def dq_columns(spark: SparkSession, d: str) -> DataFrame:
    return rel.column_profile(src.fundamentals(spark, d), FUND)


@query(" UNION ALL ".join(f"SELECT ticker, '{c}' AS \"column\", count(datekey) AS num, count(*) FILTER ({c} = 0) AS count_zero, count(*) FILTER ({c} < 0) AS count_neg, count(*) - count({c}) AS count_na FROM {{{{fundamentals}}}} GROUP BY 1" for c in FUND))
def dq_by_ticker(spark: SparkSession, d: str) -> DataFrame:
    return rel.profile_by_key(src.fundamentals(spark, d), "ticker", FUND, "datekey")


VAL = ["ev", "evebit", "pb", "pe", "ps"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS var_1, '{b}' AS var_2, round(corr({a}, {b}), 6) AS corr FROM {{{{valuation_months}}}}" for i, a in enumerate(VAL) for b in VAL[i + 1 :]))
def corr_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rel.correlation_pairs(valuation_months(spark, d), VAL))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT o_orderkey, round(o_totalprice * 1.1, 2) FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT -o_orderkey, round(o_totalprice * 1.1, 2) FROM orders WHERE o_orderkey % 100 = 0 AND o_orderkey > 0")
def upsert_replace(spark: SparkSession, d: str) -> DataFrame:
    base, new = _updates(spark, d)
    return rel.upsert(base, new, ["o_orderkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT -o_orderkey, round(o_totalprice * 1.1, 2) FROM orders WHERE o_orderkey % 100 = 0 AND o_orderkey > 0")
def upsert_insert_only(spark: SparkSession, d: str) -> DataFrame:
    base, new = _updates(spark, d)
    return rel.insert_new(base, new, ["o_orderkey"])


def _updates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    base = read_table(spark, d, "orders", ["o_orderkey", "o_totalprice"])
    dearer = stable_round(F.col("o_totalprice") * 1.1, 2).alias("o_totalprice")
    return base, base.where("o_orderkey % 10 = 0").select("o_orderkey", dearer).unionByName(base.where("o_orderkey % 100 = 0 and o_orderkey > 0").select((-F.col("o_orderkey")).alias("o_orderkey"), dearer))


@query("SELECT event_id, ts, value FROM events WHERE ts < (SELECT date_trunc('day', max(ts)) FROM events) UNION ALL SELECT event_id, ts, value * 2 FROM events WHERE ts >= (SELECT date_trunc('day', max(ts)) FROM events)")
def delete_range_insert(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events", ["event_id", "ts", "value"])
    start = e.agg(F.date_trunc("day", F.max("ts")).alias("t")).first().t
    fresh = e.where(F.col("ts") >= F.lit(start)).withColumn("value", F.col("value") * 2)
    return rel.replace_from(e, fresh, "ts", F.lit(start))


@query("(SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50) UNION (SELECT p_partkey FROM part ORDER BY p_size DESC, p_partkey LIMIT 50) UNION (SELECT p_partkey FROM part ORDER BY p_retailprice, p_partkey LIMIT 50)")
def union_shortlist(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part", ["p_partkey", "p_retailprice", "p_size"])
    top = lambda c: p.orderBy(c, "p_partkey").limit(50).select("p_partkey")
    return rel.union_distinct(top(F.desc("p_retailprice")), top(F.desc("p_size")), top(F.asc("p_retailprice")))


@query("WITH v AS (SELECT DISTINCT p_brand AS b FROM part) SELECT a.b || '-' || b.b || '-' || c.b AS model_id, a.b AS var_1, b.b AS var_2, c.b AS var_3 FROM v a JOIN v b ON a.b < b.b JOIN v c ON b.b < c.b")
def combos3(spark: SparkSession, d: str) -> DataFrame:
    return rel.combos(read_table(spark, d, "part", ["p_brand"]).distinct(), 3, column="p_brand")


@query("SELECT symbol, s.range AS short, l.range AS long FROM (SELECT DISTINCT event_type AS symbol FROM events) CROSS JOIN range(5, 30) s CROSS JOIN range(30, 60) l")
def grid_cross(spark: SparkSession, d: str) -> DataFrame:
    """Every symbol with every pair of periods."""
    symbols = read_table(spark, d, "events", ["event_type"]).select(F.col("event_type").alias("symbol")).distinct()
    return symbols.crossJoin(rel.grid(spark, short=(5, 29), long=(30, 59)))


@query("SELECT p_brand, p_type, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) = 1")
def qualify_first(spark: SparkSession, d: str) -> DataFrame:
    return rel.first_of(read_table(spark, d, "part", ["p_brand", "p_type", "p_partkey", "p_retailprice"]), ["p_brand", "p_type"], F.desc("p_retailprice"), F.asc("p_partkey"))


@query("SELECT ticker, count(*) AS num_records FROM {{fundamentals}} WHERE debt IS NOT NULL GROUP BY 1 HAVING count(*) > 3")
def having_count(spark: SparkSession, d: str) -> DataFrame:
    return src.fundamentals(spark, d).where("debt is not null").groupBy("ticker").agg(F.count("*").alias("num_records")).where("num_records > 3")


@query("SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
def distinct_rows(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders", ["o_orderpriority", "o_orderstatus"]).distinct()


@query("""SELECT t.symbol, t.time_open, date_trunc('minute', t.time_open + INTERVAL 59 MINUTE + INTERVAL 29 SECOND + INTERVAL 30 SECOND) AS time_close, t.open, t.close, t.high, t.low, t.volume, t.num FROM {{ohlc}} t""")
def candles_json(spark: SparkSession, d: str) -> DataFrame:
    from barline.operators.bars import ohlc_bars

    b = ohlc_bars(src.ticks(spark, d))
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    one = F.create_map(F.lit("t"), ms(F.col("time_open")).cast("string"), F.lit("T"), ms(F.col("time_open") + F.expr("INTERVAL 59 MINUTES 29 SECONDS")).cast("string"), F.lit("s"), F.col("symbol"), F.lit("i"), F.lit("1h"), *[x for k, c in (("o", "open"), ("c", "close"), ("h", "high"), ("l", "low"), ("v", "volume"), ("n", "num")) for x in (F.lit(k), F.col(c).cast("string"))])
    raw = b.groupBy("symbol").agg(F.to_json(F.collect_list(one)).alias("value")).select("value")
    out = candles_from_json(raw).drop("interval")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("time_open", "time_close")})


@query("SELECT id, ts AS timestamp, round(px, 6) AS prices, CASE WHEN hour(ts) % 2 = 0 THEN round(marketcap, 4) END AS market_caps, round(volume, 6) AS total_volumes FROM {{hours}}")
def nested_price_arrays(spark: SparkSession, d: str) -> DataFrame:
    from barline.plans.bars import hours

    h = hours(spark, d).withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")).cast("double"))
    pair = lambda c, n, keep=F.lit(True): F.collect_list(F.when(keep, F.array("ms", stable_round(c, n))))
    doc = F.struct(pair("px", 6).alias("prices"), pair("marketcap", 4, F.hour("ts") % 2 == 0).alias("market_caps"), pair("volume", 6).alias("total_volumes"))
    raw = h.groupBy("id").agg(F.to_json(doc).alias("value"))
    return unnest_price_arrays(raw).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("SELECT ticker, date, px_close FROM {{months}} WHERE date BETWEEN DATE '1995-01-31' AND DATE '1996-12-31' AND px_close IS NOT NULL")
def range_filter(spark: SparkSession, d: str) -> DataFrame:
    return month_bars(src.prices(spark, d)).where(F.col("date").between("1995-01-31", "1996-12-31") & F.col("px_close").isNotNull()).select("ticker", "date", "px_close")


@query("SELECT * EXCLUDE (o_comment, o_orderpriority) REPLACE (-o_totalprice AS o_totalprice) FROM (SELECT *, 'x' AS o_comment FROM orders)")
def star_except_reverse(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders").withColumn("o_comment", F.lit("x"))
    return o.drop("o_comment", "o_orderpriority").withColumn("o_totalprice", -F.col("o_totalprice"))
