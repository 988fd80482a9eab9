"""Queries: fundamentals, models, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.functions.columns import stable_round
from barline.operators import fundamentals as fd
from barline.operators import models
from barline.plans.features import rounded
from barline.plans.joins import FUND, valuation_months
from barline.plans.portfolios import panel
from barline.plans.registry import query, view
from barline.sources import canonical as src

CLEANED = ["revenue", "assets", "debt", "ebit", "intexp"]
#: Harsher than the data: so that rare negatives and few zeros occur.
_HARSH = "SELECT ticker, datekey, revenue, assets, CASE WHEN datekey > DATE '1998-06-01' AND ticker IN ('Brand#11', 'Brand#23') THEN 0 ELSE debt END AS debt, CASE WHEN ticker = 'Brand#13' AND datekey < DATE '1992-07-01' THEN -ebit ELSE abs(ebit) END AS ebit, intexp FROM {{fundamentals}}"
view("harsh", _HARSH)


def harsh(spark: SparkSession, d: str) -> DataFrame:
    f = src.fundamentals(spark, d)
    debt = F.when((F.col("datekey") > "1998-06-01") & F.col("ticker").isin("Brand#11", "Brand#23"), 0.0).otherwise(F.col("debt"))
    ebit = F.when((F.col("ticker") == "Brand#13") & (F.col("datekey") < "1992-07-01"), -F.col("ebit")).otherwise(F.abs("ebit"))
    return f.select("ticker", "datekey", "revenue", "assets", debt.alias("debt"), ebit.alias("ebit"), "intexp")


_P = ", ".join(f"count(*) FILTER ({c} = 0) / count(*) AS z_{c}, count(*) FILTER ({c} < 0) / count(*) AS n_{c}" for c in CLEANED)
_O = ", ".join(f"count(*) FILTER ({c} = 0) / count(*) AS o_{c}" for c in CLEANED)
_BAD = " OR ".join(f"(z_{c} < .01 AND {c} = 0) OR (n_{c} < .01 AND {c} < 0)" for c in CLEANED)


@query(f"""WITH p AS (SELECT {_P} FROM {{{{harsh}}}}), o AS (SELECT ticker, {_O} FROM {{{{harsh}}}} GROUP BY 1), f AS (SELECT * REPLACE (CASE WHEN revenue < 0 THEN 10 ELSE revenue END AS revenue) FROM {{{{harsh}}}}),
    b AS (SELECT DISTINCT ticker FROM f, p WHERE {_BAD}) SELECT f.ticker, f.datekey, {', '.join(f"CASE WHEN o_{c} > 0 AND o_{c} < .2 THEN nullif({c}, 0) ELSE {c} END AS {c}" for c in CLEANED)} FROM f JOIN o USING (ticker) WHERE f.ticker NOT IN (SELECT ticker FROM b)""")
def fund_clean(spark: SparkSession, d: str) -> DataFrame:
    return fd.clean(harsh(spark, d), CLEANED, rare=0.01, few=0.2)


KINDS = {"yoy": ["revenue", "ebit"], "dyoy": ["ebitmargin"], "3mom": ["pe"], "d3mom": ["debt_ebit"]}
_FILL = ", ".join(f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in FUND)
view("fund_monthly", f"""WITH f AS (SELECT ticker, datekey, last_day(datekey) AS date, {_FILL} FROM {{{{fundamentals}}}} WINDOW w AS (PARTITION BY ticker ORDER BY datekey ROWS UNBOUNDED PRECEDING)),
    g AS (SELECT * REPLACE (CASE WHEN intexp > -.1 THEN intexp END AS intexp) FROM f QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY datekey DESC) = 1),
    h AS (SELECT v.ticker, v.date, v.pe, v.ps, {', '.join(f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in FUND)} FROM {{{{valuation_months}}}} v LEFT JOIN g ON v.ticker = g.ticker AND v.date = g.date WINDOW w AS (PARTITION BY v.ticker ORDER BY v.date ROWS UNBOUNDED PRECEDING)),
    r AS (SELECT *, debt - cashneq AS netdebt FROM h),
    q AS (SELECT *, round(ebit / nullif(revenue, 0), 3) AS ebitmargin, round(debt / nullif(ebit, 0), 3) AS debt_ebit, round(netdebt / nullif(ebit, 0), 3) AS netdebt_ebit, round(coalesce(intexp, 0) / nullif(ebit, 0), 3) AS interest_ebit, round(capex / nullif(assets, 0), 3) AS capex_asset, round(equity / nullif(assets, 0), 3) AS equity_asset FROM r)
    SELECT ticker, date, pe, ps, round(netdebt, 2) AS netdebt, ebitmargin, debt_ebit, netdebt_ebit, interest_ebit, capex_asset, equity_asset, round(revenue / nullif(lag(revenue, 12) OVER w, 0) - 1, 5) AS revenue_yoy, round(ebit / nullif(lag(ebit, 12) OVER w, 0) - 1, 5) AS ebit_yoy,
      round(ebitmargin - lag(ebitmargin, 12) OVER w, 5) AS ebitmargin_dyoy, round(pe / nullif(lag(pe, 3) OVER w, 0) - 1, 5) AS pe_3mom, round(debt_ebit - lag(debt_ebit, 3) OVER w, 4) AS debt_ebit_d3mom, round(pe / nullif((revenue / nullif(lag(revenue, 12) OVER w, 0) - 1) * 100, 0), 4) AS peg, round(ps / nullif((revenue / nullif(lag(revenue, 12) OVER w, 0) - 1) * 100, 0), 4) AS psg FROM q WINDOW w AS (PARTITION BY ticker ORDER BY date)""")


@query("SELECT * FROM {{fund_monthly}}")
def fund_monthly(spark: SparkSession, d: str) -> DataFrame:
    m = fd.monthly(src.fundamentals(spark, d), valuation_months(spark, d), FUND, negatives=["intexp"])
    out = fd.lagged(fd.ratios(m), KINDS)
    digits = {"netdebt": 2, "revenue_yoy": 5, "ebit_yoy": 5, "ebitmargin_dyoy": 5, "pe_3mom": 5, "debt_ebit_d3mom": 4, "peg": 4, "psg": 4}
    keep = ["ebitmargin", "debt_ebit", "netdebt_ebit", "interest_ebit", "capex_asset", "equity_asset"]
    return out.select("ticker", "date", "pe", "ps", *keep, *[stable_round(c, n).alias(c) for c, n in digits.items()])


@query("WITH d AS (SELECT DISTINCT date FROM {{panel}}), c AS (SELECT make_date(CAST(floor(quantile_cont(date_diff('day', DATE '1970-01-01', date), .8)) AS INTEGER)) AS c FROM d) SELECT date <= c AS is_train, count(*) AS n, count(DISTINCT date) AS dates FROM {{panel}}, c GROUP BY 1")
def split_by_date(spark: SparkSession, d: str) -> DataFrame:
    a, b = models.split_by_date(panel(spark, d))
    tell = lambda x, flag: x.agg(F.lit(flag).alias("is_train"), F.count("*").alias("n"), F.countDistinct("date").alias("dates"))
    return tell(a, True).unionByName(tell(b, False))


VARIABLES = ["px_pct_1m", "px_pct_3m", "px_pct_6m", "pe", "marketcap"]


def _rows(spark: SparkSession, d: str) -> DataFrame:
    rows = fd.labels(panel(spark, d), {"next_month_return": [8]}).where("next_month_return is not null")
    return rows.withColumn("y", F.col("is_top_8_next_month_return").cast("double"))


@query()
def walk_forward_gbt(spark: SparkSession, d: str) -> DataFrame:
    out = models.walk_forward(_rows(spark, d), "y", VARIABLES, cutoff=60, n=10, maxIter=5, maxDepth=3, seed=1)
    return rounded(out.select("date", "ticker", "pred", "ptf_rank", "next_month_return"))


@query()
def forest_importance(spark: SparkSession, d: str) -> DataFrame:
    model = models.pipeline("rf_reg", "next_month_return", VARIABLES, numTrees=10, maxDepth=4, seed=1).fit(_rows(spark, d))
    return rounded(models.importances(model, VARIABLES, spark))


@query()
def random_search(spark: SparkSession, d: str) -> DataFrame:
    return rounded(models.search(_rows(spark, d), "y", VARIABLES, "gbt", {"maxDepth": [2, 3], "maxIter": [2, 4], "stepSize": [0.1, 0.3]}, folds=3, draws=4))
