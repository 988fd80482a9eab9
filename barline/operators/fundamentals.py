"""Fundamentals: cleaning by profile, monthly filling onto valuations, ratios and their lags; universes and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.columns import clip_below, month_end, pct_change, safe_div, stable_round, zero_to_null
from barline.functions.ranks import dense_rank_desc
from barline.operators.relational import as_of_fill, column_profile, first_of, group_ffill

#: name: (numerator, denominator), rounded to 3 digits.
RATIOS = {
    "ebitmargin": ("ebit", "revenue"), "opmargin": ("opinc", "revenue"), "fcfmargin": ("fcf", "revenue"), "debt_ebit": ("debt", "ebit"), "debt_ebitda": ("debt", "ebitda"),
    "netdebt_ebit": ("netdebt", "ebit"), "netdebt_ebitda": ("netdebt", "ebitda"), "interest_ebit": ("intexp", "ebit"), "capex_asset": ("capex", "assets"), "equity_asset": ("equity", "assets"), "retearn_asset": ("retearn", "assets"),
}


def clean(raw: DataFrame, columns: list[str], rare: float = 0.0002, few: float = 0.04, revenue_floor: float = 10.0, key: str = "ticker") -> DataFrame:
    """Rows of tickers whose rare zeros and negatives are no errors; a ticker's few zeros become NULL.

    A negative revenue becomes ``revenue_floor``. A column whose share of zeros
    (negatives) over all rows is under ``rare`` should have none: tickers with
    one go. Where a ticker's own share of zeros in a column is positive and
    under ``few``, its zeros become NULL. Shares come from the raw rows. The
    profile is one aggregate and stays in the plan as a one-row broadcast.
    """
    fixed = raw.withColumn("revenue", F.when(F.col("revenue") < 0, revenue_floor).otherwise(F.col("revenue"))) if "revenue" in columns else raw
    share = lambda c, bad: F.count(F.when(bad(F.col(c)), 1)) / F.greatest(F.count("*"), F.lit(1))
    tests = {"z": lambda x: x == 0, "n": lambda x: x < 0}
    profile = raw.agg(*[share(c, f).alias(f"_{t}_{c}") for c in columns for t, f in tests.items()])
    own = raw.groupBy(key).agg(*[share(c, tests["z"]).alias(f"_o_{c}") for c in columns])
    flagged = fixed.join(F.broadcast(profile))  # one row
    bad = F.lit(False)
    for c in columns:
        for t, f in tests.items():
            bad = bad | ((F.col(f"_{t}_{c}") < rare) & F.coalesce(f(F.col(c)), F.lit(False)))
    out = flagged.withColumn("_bad", F.max(bad.cast("int")).over(Window.partitionBy(key))).where("_bad = 0").select(*raw.columns)
    joined = out.join(own, key)
    return joined.withColumns({c: F.when((F.col(f"_o_{c}") > 0) & (F.col(f"_o_{c}") < few), zero_to_null(c)).otherwise(F.col(c)) for c in columns}).select(*raw.columns)


def monthly(filings: DataFrame, valuations: DataFrame, columns: list[str], negatives: list[str] | None = None, zeros: list[str] | None = None) -> DataFrame:
    """Filings filled forward onto month ends, the last one of a month, joined to every monthly valuation and filled forward.

    ``negatives``: columns whose values at or below -0.1 become NULL after the
    first filling; ``zeros``: columns whose zeros do.
    """
    rows = group_ffill(filings.withColumn("date", month_end("datekey")), "ticker", "datekey", columns)
    last = first_of(rows, ["ticker", "date"], F.desc("datekey"))
    last = last.withColumns({c: clip_below(c, -0.1) for c in negatives or []}).withColumns({c: zero_to_null(c) for c in zeros or []})
    return as_of_fill(last.select("ticker", "date", "datekey", *columns), valuations, "ticker", "date")


def ratios(df: DataFrame) -> DataFrame:
    """The ratios whose inputs are there, ``netdebt`` first; missing interest counts as 0."""
    if {"debt", "cashneq"} <= set(df.columns):
        df = df.withColumn("netdebt", F.col("debt") - F.col("cashneq"))
    made = {}
    for n, (a, b) in RATIOS.items():
        if {a, b} <= set(df.columns):
            top = F.coalesce(F.col(a), F.lit(0.0)) if a == "intexp" else F.col(a)
            made[n] = stable_round(safe_div(top, b), 3)
    return df.withColumns(made)


def lagged(df: DataFrame, kinds: dict[str, list[str]]) -> DataFrame:
    """``_yoy``/``_3mom`` changes and ``_dyoy``/``_d3mom`` differences of the columns listed under those names; peg and psg if they can be had."""
    w = Window.partitionBy("ticker").orderBy("date")
    made: dict[str, Column] = {}
    for kind, cols in kinds.items():
        n = 12 if kind.endswith("yoy") else 3
        for c in cols:
            old = F.lag(c, n).over(w)
            made[f"{c}_{kind}"] = F.col(c) - old if kind.startswith("d") else pct_change(c, old, None)
    out = df.select("*", *[v.alias(k) for k, v in made.items()])
    if "revenue_yoy" in made:
        out = out.withColumns({n: safe_div(c, F.col("revenue_yoy") * 100) for n, c in (("peg", "pe"), ("psg", "ps")) if c in out.columns})
    return out


def thresholds(profile: DataFrame, share: str, low: float = 0.0002, high: float = 0.01) -> list[str]:
    """Columns whose share lies strictly between the bounds (a row a column reaches the driver)."""
    return [r.column for r in profile.where((F.col(share) > low) & (F.col(share) < high)).select("column").collect()]


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    return column_profile(df, columns)


def universe(monthly_rows: DataFrame, meta: DataFrame, dates: DataFrame, filings: DataFrame | None = None, mcap: float = 0.6, volume: float = 0.8, ipo_days: int = 90, include: list[str] | None = None, exclude: list[str] | None = None, min_filings: int = 3) -> DataFrame:
    """Rows of the tradeable universe: large and liquid by percent rank, listed long enough and not delisted, of the industries wanted, with more than ``min_filings`` filings."""
    rows = monthly_rows.where((F.col("mcap_pct_rank") <= mcap) & (F.col("volume_pct_rank") < volume))
    rows = rows.join(dates, "ticker").where((F.col("date") > F.date_add("first_date", ipo_days)) & (F.col("date") <= F.col("last_date")))
    if include or exclude:
        m = meta.select("ticker", "famaindustry")
        m = m.where(F.col("famaindustry").isin(include)) if include else m.where(~F.col("famaindustry").isin(exclude))
        rows = rows.join(m.select("ticker"), "ticker", "left_semi")
    if filings is not None:
        rows = rows.join(filings.groupBy("ticker").agg(F.count("*").alias("n")).where(F.col("n") > min_filings), "ticker", "left_semi")
    return rows


def labels(df: DataFrame, horizons: dict[str, list[int]]) -> DataFrame:
    """``is_top_{n}_{horizon}``: 1 where the dense rank of the ``{horizon}`` return in its date is at most n; 0 otherwise, NULLs too."""
    made = {}
    for h, ns in horizons.items():
        rank = dense_rank_desc(h, ["date"])
        for n in ns:
            made[f"is_top_{n}_{h}"] = F.coalesce((rank <= n).cast("long"), F.lit(0).cast("long"))
    return df.select("*", *[v.alias(k) for k, v in made.items()])


def forward_returns(df: DataFrame, columns: dict[str, tuple[str, int]]) -> DataFrame:
    """``name = lead(column, n)`` by ticker: a return over n months seen from its start."""
    w = Window.partitionBy("ticker").orderBy("date")
    return df.select("*", *[F.lead(c, n).over(w).alias(name) for name, (c, n) in columns.items()])
