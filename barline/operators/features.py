"""Time-series features. Specs are turned into columns of one select, so all of them share one exchange and one sort."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barline.functions.columns import pct_change, safe_div, stable_round


@dataclass(frozen=True)
class Feature:
    """``kind``: lag, lead, pct, diff, mean, vol, min, max, ffill, cumprod. ``n``: rows back (or in the frame).

    ``full``: NULL until the frame holds n rows. ``digits``: rounding. ``scale``: factor.
    """

    name: str
    kind: str
    base: str
    n: int = 1
    full: bool = False
    digits: int | None = None
    scale: float = 1.0

    def column(self, w: WindowSpec) -> Column:
        x = F.col(self.base)
        if self.kind in ("lag", "lead"):
            out = getattr(F, self.kind)(x, self.n).over(w)
        elif self.kind == "pct":
            out = pct_change(x, F.lag(x, self.n).over(w), None)
        elif self.kind == "diff":
            out = x - F.lag(x, self.n).over(w)
        elif self.kind == "ffill":
            out = F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        elif self.kind == "cumprod":
            out = F.product(1 + x).over(w.rowsBetween(Window.unboundedPreceding, 0))
        else:
            frame = w.rowsBetween(-(self.n - 1), 0)
            out = {"mean": F.avg, "vol": F.stddev_samp, "min": F.min, "max": F.max}[self.kind](x).over(frame)
            if self.full:
                out = F.when(F.row_number().over(w) > self.n - 1, out)
        if self.scale != 1.0:
            out = out * self.scale
        return (out if self.digits is None else stable_round(out, self.digits)).alias(self.name)


def limited_ffill(df: DataFrame, key: str, order: str, column: str, limit: int) -> DataFrame:
    """A missing value takes the last one of at most ``limit`` rows before."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-limit, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def akima_fill(df: DataFrame, key: str, date: str, column: str) -> DataFrame:
    """Gaps between two known values take Akima's cubic over the days; leading and trailing ones stay.

    A point's gradient comes from the slopes of two segments on either side,
    those beyond the ends by going on with the last two; two points make a line.
    One exchange by key: known rows are windows within its partitions.
    """
    x = F.unix_date(date)
    known = Window.partitionBy(key, "_known").orderBy(date)
    whole = known.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    slopes = df.repartition(key).withColumn("_known", F.col(column).isNotNull()).withColumn("_h", F.lead(x).over(known) - x)
    slopes = slopes.withColumn("_m", (F.lead(column).over(known) - F.col(column)) / F.col("_h"))
    slopes = slopes.withColumns({"_a": F.lag("_m", 2).over(known), "_b": F.lag("_m").over(known), "_d": F.lead("_m").over(known)})
    at = slopes.withColumns({
        "_f": F.first("_m").over(whole), "_g": F.coalesce(F.nth_value("_m", 2).over(whole), F.first("_m").over(whole)),
        "_p": F.last("_m", True).over(whole), "_q": F.coalesce(F.last(F.when(F.col("_d").isNotNull(), F.col("_m")), True).over(whole), F.last("_m", True).over(whole)),
    })
    before, after = 2 * F.col("_f") - F.col("_g"), 2 * F.col("_p") - F.col("_q")
    ends = at.withColumns({
        "_a": F.coalesce("_a", F.when(F.col("_b").isNull(), 3 * F.col("_f") - 2 * F.col("_g")).otherwise(before)), "_b": F.coalesce("_b", before),
        "_c": F.coalesce("_m", after), "_d": F.coalesce("_d", F.when(F.col("_m").isNull(), 3 * F.col("_p") - 2 * F.col("_q")).otherwise(after)),
    }).withColumns({"_u": F.abs(F.col("_d") - F.col("_c")), "_v": F.abs(F.col("_b") - F.col("_a"))})
    both = F.col("_u") + F.col("_v")
    gradient = F.when(both > 1e-9 * F.max(both).over(whole), (F.col("_u") * F.col("_b") + F.col("_v") * F.col("_c")) / both).otherwise((F.col("_a") + F.col("_d")) / 2)
    bent = ends.withColumn("_t", gradient).withColumn("_n", F.lead("_t").over(known))
    piece = F.when(F.col("_known"), F.struct(x.alias("x"), F.col(column).alias("y"), F.col("_h").alias("h"), F.col("_m").alias("m"), F.col("_t").alias("t"), F.col("_n").alias("n")))
    out = bent.withColumn("_s", F.last(piece, True).over(Window.partitionBy(key).orderBy(date)))
    s, t, m, n, h = x - F.col("_s.x"), F.col("_s.t"), F.col("_s.m"), F.col("_s.n"), F.col("_s.h")
    curve = F.col("_s.y") + t * s + (3 * m - 2 * t - n) / h * s * s + (t + n - 2 * m) / (h * h) * s * s * s
    return out.select(*[F.coalesce(column, curve).alias(column) if c == column else F.col(c) for c in df.columns])


def long_ratios(long: DataFrame, pairs: list[tuple[str, str, str]], keys: tuple[str, ...] = ("ticker", "date_start", "date_end")) -> DataFrame:
    """Ratios (over, under, name) of the fields of a long table, all from one pivot, as long rows; none where a field is missing or NULL."""
    fields = sorted({f for a, b, _ in pairs for f in (a, b)})
    wide = long.groupBy(*keys).pivot("field", fields).agg(F.first("value"))
    made = [F.when(F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull(), F.struct(F.lit(n).alias("field"), F.try_divide(F.col(f"`{a}`"), F.col(f"`{b}`")).alias("value"))) for a, b, n in pairs]
    return wide.select(*keys, F.explode(F.array(*made)).alias("r")).where("r is not null").select(*keys, "r.field", "r.value")


def with_features(df: DataFrame, key: str | list[str], order: str, features: Iterable[Feature]) -> DataFrame:
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(order)
    return df.select("*", *[f.column(w) for f in features])


def returns(df: DataFrame, key: str, order: str, lags: dict[str, list[int]], unit: str, digits: int = 6) -> DataFrame:
    """``{base}_l{n}{unit}`` and ``{base}_pct_{n}{unit}`` for every base column and lag."""
    specs = [Feature(f"{b}_l{n}{unit}", "lag", b, n) for b, ns in lags.items() for n in ns]
    specs += [Feature(f"{b}_pct_{n}{unit}", "pct", b, n, digits=digits) for b, ns in lags.items() for n in ns]
    return with_features(df, key, order, specs)


def drop_outliers(df: DataFrame, column: str = "px_pct_1d", below: float = 100.0) -> DataFrame:
    """Rows under the bound; a NULL goes too."""
    return df.where(F.col(column) < below)


def momentum(df: DataFrame, key: str, order: str, ret: str, means: list[int], vols: list[int], unit: str, prefix: str = "px") -> DataFrame:
    """Mean and volatility of one-period returns, and the return that follows."""
    specs = [Feature(f"{prefix}_momentum_{n}{unit}", "mean", ret, n) for n in means] + [Feature(f"{prefix}_vol_{n}{unit}", "vol", ret, n) for n in vols]
    return with_features(df, key, order, [*specs, Feature("next_return", "lead", ret, 1)])


def change_of(df: DataFrame, key: str, order: str, columns: list[str], n: int, suffix: str) -> DataFrame:
    """``x - lag(x, n)`` of columns that are windows themselves."""
    return with_features(df, key, order, [Feature(f"{c}{suffix}", "diff", c, n) for c in columns])


def ratios(df: DataFrame, pairs: dict[str, tuple[str, str]], digits: int | None = None) -> DataFrame:
    """``name = a / b``, NULL where b is 0."""
    made = {n: safe_div(a, b) for n, (a, b) in pairs.items()}
    return df.withColumns({n: c if digits is None else stable_round(c, digits) for n, c in made.items()})


def gaps_and_crossovers(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """``gap_{name}`` and ``cross_{name}``: minus a positive gap, else -999 (a NULL gap as well)."""
    out = df.withColumns({f"gap_{n}": F.col(a) - F.col(b) for n, (a, b) in pairs.items()})
    return out.withColumns({f"cross_{n}": F.when(F.col(f"gap_{n}") > 0, -F.col(f"gap_{n}")).otherwise(F.lit(-999.0)) for n in pairs})


def rs_ratio(df: DataFrame, key: str, order: str, ret: str, ns: list[int]) -> DataFrame:
    """Mean gain over mean loss of the days with either, over n full rows."""
    w = Window.partitionBy(key).orderBy(order)
    days = df.withColumns({"_up": F.when(F.col(ret) > 0, F.col(ret)), "_down": F.when(F.col(ret) < 0, F.abs(ret))})
    made = {}
    for n in ns:
        frame = w.rowsBetween(-(n - 1), 0)
        made[f"rsi_{n}d"] = F.when(F.row_number().over(w) > n - 1, safe_div(F.avg("_up").over(frame), F.avg("_down").over(frame)))
    return days.select("*", *[c.alias(n) for n, c in made.items()]).drop("_up", "_down")


def long_change(long: DataFrame, field: str, ns: list[int], unit: str, kind: str = "pct") -> DataFrame:
    """Rows of new fields from one field of a long table: ``{field}_{pct|diff|mean|vol|l}_{n}{unit}``.

    One window over the field, then one stack: not a pass for each lag. Means
    and volatilities need n rows of history.
    """
    one = long.where(F.col("field") == field)
    names = {n: f"{field}_l{n}{unit}" if kind == "l" else f"{field}_{kind}_{n}{unit}" for n in ns}
    spec = {"pct": ("pct", False, 100.0), "diff": ("diff", False, 1.0), "l": ("lag", False, 1.0), "mean": ("mean", True, 1.0), "vol": ("vol", True, 1.0)}[kind]
    wide = with_features(one, "ticker", "date_start", [Feature(f"_{n}", spec[0], "value", n, full=spec[1], scale=spec[2]) for n in ns])
    stacked = F.explode(F.array(*[F.struct(F.lit(names[n]).alias("field"), F.col(f"_{n}").alias("value")) for n in ns])).alias("s")
    return wide.select("ticker", "date_start", "date_end", stacked).select("ticker", "date_start", "date_end", "s.field", "s.value")


def long_ratio(long: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Rows of a / b from a long table, by one pivot instead of a self-join; only where both fields have a row."""
    keys = ["ticker", "date_start", "date_end"]
    has = lambda f: F.count(F.when(F.col("field") == f, 1))
    val = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    wide = long.where(F.col("field").isin(a, b)).groupBy(*keys).agg(val(a).alias("_a"), val(b).alias("_b"), has(a).alias("_na"), has(b).alias("_nb")).where("_na > 0 and _nb > 0")
    return wide.select(*keys, F.lit(name).alias("field"), safe_div("_a", "_b").alias("value"))


def tensor_windows(df: DataFrame, key: str, order: str, column: str, n: int, label: str) -> DataFrame:
    """The n values before each row as an array, with the row's label; only full windows without NULL."""
    w = Window.partitionBy(key).orderBy(order)
    out = df.select(key, order, F.collect_list(column).over(w.rowsBetween(-n, -1)).alias("window"), F.col(label).alias("label"), F.row_number().over(w).alias("rn"), F.count("*").over(Window.partitionBy(key)).alias("rows"))
    return out.where((F.size("window") == n) & F.col("label").isNotNull()).withColumn("is_train", F.col("rn") <= 0.8 * F.col("rows")).drop("rn", "rows")
