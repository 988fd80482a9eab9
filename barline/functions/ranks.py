"""Cross-sectional ranks, in the SQL and the dataframe-library conventions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def _order(col: str, descending: bool) -> Column:
    return F.desc_nulls_last(col) if descending else F.asc_nulls_last(col)


def guarded_rank(col: str, by: list[str], descending: bool = True) -> Column:
    """rank(), NULL for NULL; the NULLs stand after all values."""
    return F.when(F.col(col).isNotNull(), F.rank().over(Window.partitionBy(*by).orderBy(_order(col, descending))))


def sql_percent_rank(col: str, by: list[str], descending: bool = True) -> Column:
    """(rank - 1) / (rows - 1); NULL rows count and stand last."""
    return F.percent_rank().over(Window.partitionBy(*by).orderBy(_order(col, descending)))


def average_rank(col: str, by: list[str], descending: bool = True) -> Column:
    """Mean rank of equal values, NULL for NULL."""
    ties = F.count("*").over(Window.partitionBy(*by, col))
    return F.when(F.col(col).isNotNull(), F.rank().over(Window.partitionBy(*by).orderBy(_order(col, descending))) + (ties - 1) / 2)


def pct_rank(col: str, by: list[str], descending: bool = False) -> Column:
    """Mean rank of equal values over the count of values, NULL for NULL."""
    return average_rank(col, by, descending) / F.count(col).over(Window.partitionBy(*by))


def dense_rank_desc(col: str, by: list[str]) -> Column:
    return F.when(F.col(col).isNotNull(), F.dense_rank().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last(col))))


def row_rank(by: list[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")


def quantile_bin(col: str, by: list[str], q: int = 5) -> Column:
    """1-based quantile bin: linearly interpolated edges, closed on the right, equal edges merged; NULL for NULL.

    Where all values are equal there is no bin and the result is NULL.
    """
    edges = F.array_distinct(F.percentile(col, [i / q for i in range(q + 1)]).over(Window.partitionBy(*by)))
    below = F.size(F.filter(F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0))), lambda e: e < F.col(col)))
    return F.when(F.col(col).isNotNull() & (F.size(edges) > 1), (below + 1).cast("long"))
