"""Scalar expressions. Missing values are NULL; NaN and infinities become NULL on the way in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_div(a: ColumnOrName, b: ColumnOrName) -> Column:
    """a / b, NULL where b is 0 (plain division throws under ANSI rules)."""
    return F.try_divide(_c(a), _c(b))


def stable_round(x: ColumnOrName, digits: int = 0) -> Column:
    """round(), nudged by a thousandth of the last digit, so that sums in another order can't tip a tie."""
    return F.round(_c(x) + 10.0 ** -(digits + 3), digits)


def pct_change(new: ColumnOrName, old: ColumnOrName, digits: int | None = 6) -> Column:
    change = safe_div(new, old) - 1
    return change if digits is None else stable_round(change, digits)


def inf_to_null(x: ColumnOrName) -> Column:
    x = _c(x)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def zero_to_null(x: ColumnOrName) -> Column:
    return F.nullif(_c(x), F.lit(0))


def clip_below(x: ColumnOrName, floor: float) -> Column:
    """Values at or below the floor become NULL, others stay."""
    x = _c(x)
    return F.when(x <= floor, None).otherwise(x)


def null_count(cols: list[str]) -> Column:
    """How many of the columns are NULL in a row."""
    return reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in cols], F.lit(0))


def week_start(d: ColumnOrName) -> Column:
    """Monday of the week."""
    return F.date_trunc("week", _c(d)).cast("date")


def week_end(d: ColumnOrName, sunday_based: bool = False) -> Column:
    """Friday of the week: Monday + 4, or counted from Sunday, by which a Sunday has the next Friday."""
    d = _c(d)
    if sunday_based:
        return F.date_add(d.cast("date"), (6 - F.dayofweek(d)).cast("int"))
    return F.date_add(week_start(d), 4)


def month_end(d: ColumnOrName, months: int = 0) -> Column:
    """Last day of the month that is ``months`` away."""
    return F.last_day(F.add_months(_c(d), months))


def truncated(unit: str, ts: ColumnOrName) -> Column:
    """The start of the unit, without a zone (date_trunc alone would give a zoned time)."""
    return F.date_trunc(unit, _c(ts)).cast("timestamp_ntz")


def nearest_minute(ts: ColumnOrName) -> Column:
    return truncated("minute", _c(ts) + F.expr("INTERVAL 30 SECONDS"))


def epoch_ms(ts: ColumnOrName) -> Column:
    return F.unix_millis(_c(ts).cast("timestamp"))


def arr_last(value: ColumnOrName, order: ColumnOrName) -> Column:
    """Aggregate: the value on the row of the greatest order key."""
    return F.max_by(_c(value), _c(order))
