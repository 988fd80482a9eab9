"""Joins, pivots, profiles, upserts and combinatorics over any tables."""

from __future__ import annotations

from itertools import combinations as _combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.functions.columns import null_count


def only_in(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key tuple occurs in ``keys``."""
    return df.join(keys.select(*on), on, "left_semi")


def last_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of every key, whole."""
    row = F.struct(*df.columns)
    return df.groupBy(key).agg(F.max_by(row, order).alias("_r")).select("_r.*")


def recent_series(df: DataFrame, key: str, date: str, value: str, days: int) -> DataFrame:
    """The keys that have a value within ``days`` of the table's last date, with all their rows."""
    end = df.agg(F.date_sub(F.max(date), days).alias("_from"))  # one row
    seen = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.max(date).alias("_seen"))
    return df.join(seen.join(F.broadcast(end), F.col("_seen") >= F.col("_from")), key, "left_semi")


def not_in(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key tuple does not occur in ``keys``."""
    return df.join(keys.select(*on), on, "left_anti")


def after_ipo(df: DataFrame, firsts: DataFrame, key: str, date: str, days: int = 90) -> DataFrame:
    """Rows at least ``days`` after the key's first date: an equality join with a residual condition."""
    f = firsts.select(F.col(key).alias("_k"), F.col("first_date").alias("_f"))
    return df.join(f, (F.col(key) == F.col("_k")) & (F.col(date) >= F.date_add("_f", days))).drop("_k", "_f")


def as_of_fill(left: DataFrame, right: DataFrame, key: str, date: str) -> DataFrame:
    """Every row of ``right``; columns of ``left`` from the row of the same date, else the last one before that matched a date."""
    w = Window.partitionBy(key).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    cols = [c for c in left.columns if c not in (key, date)]
    joined = left.join(right, [key, date], "right")
    return joined.select(key, date, *[c for c in right.columns if c not in (key, date)], *[F.last(c, True).over(w).alias(c) for c in cols])


def group_ffill(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, True).over(w) for c in columns})


def first_of(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first in the order given."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def pivot_long(long: DataFrame, keys: list[str], fields: list[str], how: str = "max") -> DataFrame:
    """One column for each field; the list saves the pass that would find them."""
    return long.groupBy(*keys).pivot("field", fields).agg(F.expr(f"{how}(value)"))


def melt(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.unpivot(keys, columns, "field", "value")


def sparse_rows_out(df: DataFrame, considered: list[str], share: float = 0.5, counted: list[str] | None = None) -> DataFrame:
    """Rows with at most ``round(share * len(considered))`` NULLs; NULLs are counted over all columns unless told otherwise."""
    return df.where(null_count(counted or df.columns) <= round(share * len(considered)))


def column_profile(df: DataFrame, columns: list[str], negative_share: float = 0.01) -> DataFrame:
    """(column, num, zeros, negatives, missing, pct_zero, pct_neg, pct_na, has_neg), all columns in one pass."""
    n = len(columns)
    aggs = [F.count("*").alias("_rows")]
    for i, c in enumerate(columns):
        aggs += [F.count(c).alias(f"_n{i}"), F.count(F.when(F.col(c) == 0, 1)).alias(f"_z{i}"), F.count(F.when(F.col(c) < 0, 1)).alias(f"_m{i}")]
    one = df.agg(*aggs)
    each = F.explode(F.array(*[F.struct(F.lit(columns[i]).alias("column"), F.col(f"_n{i}").alias("num"), F.col(f"_z{i}").alias("zeros"), F.col(f"_m{i}").alias("negatives"), (F.col("_rows") - F.col(f"_n{i}")).alias("missing")) for i in range(n)])).alias("s")
    out = one.select("_rows", each).select("_rows", "s.*")
    share = lambda c: F.try_divide(F.col(c), F.col("_rows"))
    return out.withColumns({"pct_zero": share("zeros"), "pct_neg": share("negatives"), "pct_na": share("missing")}).withColumn("has_neg", F.col("pct_neg") > negative_share).drop("_rows")


def profile_by_key(df: DataFrame, key: str, columns: list[str], counted: str) -> DataFrame:
    """(key, column, num, count_zero, count_neg, count_na) for each key and column; NULLs are counted as such."""
    rows = df.groupBy(key).agg(F.count(counted).alias("num"), *[f(c).alias(f"{p}_{c}") for c in columns for p, f in (("z", lambda c: F.count(F.when(F.col(c) == 0, 1))), ("n", lambda c: F.count(F.when(F.col(c) < 0, 1))), ("a", lambda c: F.count(F.when(F.col(c).isNull(), 1))))])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"z_{c}").alias("count_zero"), F.col(f"n_{c}").alias("count_neg"), F.col(f"a_{c}").alias("count_na")) for c in columns])).alias("s")
    return rows.select(key, "num", each).select(key, "s.column", "num", "s.count_zero", "s.count_neg", "s.count_na")


def correlation_pairs(df: DataFrame, columns: list[str], at_least: float | None = None) -> DataFrame:
    """(var_1, var_2, corr) of every pair once, over rows that have both; optionally only strong ones."""
    pairs = list(_combinations(columns, 2))
    one = df.agg(*[F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    out = one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("var_1"), F.lit(b).alias("var_2"), F.col(f"_{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])).alias("s")).select("s.*")
    return out if at_least is None else out.where(F.abs("corr") >= at_least)


def prune_correlated(pairs: DataFrame, importance: DataFrame, limit: float = 0.9) -> DataFrame:
    """Variables left when of each strongly correlated pair the less important one goes (of equals, the later name)."""
    i = importance.select("variable", "importance")
    a = i.select(F.col("variable").alias("var_1"), F.col("importance").alias("i1"))
    b = i.select(F.col("variable").alias("var_2"), F.col("importance").alias("i2"))
    strong = pairs.where(F.abs("corr") >= limit).join(a, "var_1").join(b, "var_2")
    gone = strong.select(F.when((F.col("i1") > F.col("i2")) | ((F.col("i1") == F.col("i2")) & (F.col("var_1") < F.col("var_2"))), F.col("var_2")).otherwise(F.col("var_1")).alias("variable")).distinct()
    return i.join(gone, "variable", "left_anti")


def upsert(base: DataFrame, update: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``update`` replace those of equal key and are added otherwise."""
    return base.join(update.select(*keys), keys, "left_anti").unionByName(update)


def insert_new(base: DataFrame, update: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``update`` whose key is new are added; of repeated new keys all."""
    return base.unionByName(update.join(base.select(*keys), keys, "left_anti"))


def replace_from(base: DataFrame, update: DataFrame, column: str, start: Column) -> DataFrame:
    """Everything from ``start`` on is replaced by ``update``."""
    return base.where(F.col(column) < start).unionByName(update)


def union_distinct(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def combos(names: DataFrame, size: int = 3, fixed: list[str] | None = None, column: str = "variable") -> DataFrame:
    """(model_id, var_1 .. var_n): all combinations of ``size`` names, each with the fixed ones appended."""
    out = names.select(F.col(column).alias("var_1")).distinct()
    for i in range(2, size + 1):
        nxt = names.select(F.col(column).alias(f"var_{i}")).distinct()
        out = out.join(nxt, F.col(f"var_{i - 1}") < F.col(f"var_{i}"))
    cols = [f"var_{i}" for i in range(1, size + 1)]
    out = out.withColumn("model_id", F.concat_ws("-", *cols))
    return out.withColumns({f"var_{size + 1 + i}": F.lit(v) for i, v in enumerate(fixed or [])})


def grid(spark: SparkSession, **ranges: tuple[int, int]) -> DataFrame:
    """The Cartesian product of whole-number ranges, both ends included."""
    out = None
    for name, (lo, hi) in ranges.items():
        one = spark.range(lo, hi + 1).select(F.col("id").alias(name))
        out = one if out is None else out.crossJoin(one)
    return out


def sample_draws(pool: DataFrame, draws: int, k: int, seed: int = 1) -> DataFrame:
    """(draw, variable): k different names of the pool, a column ``variable``, for each draw, in the order of a seeded hash."""
    all_ = pool.sparkSession.range(draws).withColumnRenamed("id", "draw").crossJoin(pool.select("variable"))  # draws x names, as the sample is of all names
    n = F.row_number().over(Window.partitionBy("draw").orderBy(F.md5(F.concat_ws("-", "draw", "variable", F.lit(seed)).cast("binary")), "variable"))
    return all_.withColumn("_n", n).where(F.col("_n") <= k).drop("_n")


def reindex(df: DataFrame, key: str, order: str) -> DataFrame:
    """A row for every key and every value of ``order``, NULL where ``df`` has none.

    The values (dates, say) are one array in a one-row broadcast: what grows is
    the result alone.
    """
    values = df.agg(F.array_sort(F.collect_set(order)).alias("_all"))
    full = df.select(key).distinct().join(F.broadcast(values)).select(key, F.explode("_all").alias(order))  # one row
    return full.join(df, [key, order], "left")


def project_unless(df: DataFrame, columns: list[str], present: list[str]) -> DataFrame:
    """Those of ``columns`` that ``df`` has and ``present`` lacks, in their order."""
    return df.select(*[c for c in columns if c in df.columns and c not in present])


def drop_null_rows(df: DataFrame, how: str = "any", subset: list[str] | None = None) -> DataFrame:
    """Rows without a null in any (``how``: in all) of the columns; NaN counts as null."""
    return df.dropna(how, subset=subset)
