"""Operators whose work spreads over all tasks even where one date, one bin or one series has most of the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.session import shared_folder


def _kept(df: DataFrame, name: str) -> DataFrame:
    """A small table, written: computed once, the same wherever it is used."""
    path = f"{shared_folder(df.sparkSession, name)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_ranks(df: DataFrame, value: str, by: list[str], descending: bool = True, parts: int = 64, prefix: str = "") -> DataFrame:
    """``df`` with rank, dense_rank, average_rank, pct_rank and percent_rank of ``value`` within ``by``, no group in one task.

    Equal values are counted first, so that ties weigh nothing. The distinct
    values of a group are cut into ``parts`` ranges at approximate quantiles;
    ranks within a range are a window over it, and what stands before the range
    is a running sum over ranges, of which a group has ``parts``. NULL has no
    rank; its percent_rank, (rank - 1) / (rows - 1), stands after all values.
    """
    x, sign = F.col("_x"), -1 if descending else 1
    rows = df.withColumn("_x", (sign * F.col(value)).cast("double"))
    counted = rows.groupBy(*by, "_x").agg(F.count("*").alias("_n"))
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    cuts = _kept(counted.where("_x is not null").groupBy(*by).agg(F.array_distinct(F.percentile_approx("_x", shares, F.lit(10 * parts))).alias("_cuts")), "cuts")
    placed = _joined(counted, cuts, by).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < x))).drop("_cuts")
    known = placed.where("_x is not null")
    inside = Window.partitionBy(*by, "_part").orderBy("_x")
    local = known.withColumns({"_before": F.sum("_n").over(inside) - F.col("_n"), "_dense": F.row_number().over(inside).cast("long")})
    sizes = known.groupBy(*by, "_part").agg(F.sum("_n").alias("_size"), F.count("*").alias("_distinct"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_o"), F.coalesce(F.sum("_distinct").over(earlier), F.lit(0)).alias("_od"))
    totals = counted.groupBy(*by).agg(F.sum("_n").alias("_rows"), F.sum(F.when(x.isNotNull(), F.col("_n")).otherwise(0)).alias("_known"))
    ranked = _joined(local, offsets, [*by, "_part"]).select(*by, "_x", "_n", (F.col("_before") + F.col("_o") + 1).alias("_rank"), (F.col("_dense") + F.col("_od")).alias("_dense"))
    out = _joined(_joined(rows, ranked, [*by, "_x"], "left"), totals, by)
    average = F.col("_rank") + (F.col("_n") - 1) / 2
    made = {
        "rank": F.col("_rank"), "dense_rank": F.col("_dense"), "average_rank": average, "pct_rank": average / F.col("_known"),
        "percent_rank": F.when(F.col("_rows") == 1, 0.0).otherwise(F.try_divide(F.coalesce(F.col("_rank") - 1, F.col("_known")), F.col("_rows") - 1)),
    }
    return out.select(*df.columns, *[v.alias(prefix + k) for k, v in made.items()])


def _joined(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on equal keys where NULL equals NULL, with the keys of ``a`` once."""
    right = b.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in b.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return a.join(right, on, how).drop(*[f"_k{i}" for i in range(len(keys))])


def gram_correlations(df: DataFrame, columns: list[str], at_least: float | None = None) -> DataFrame:
    """(var_1, var_2, corr) of every pair once, over rows that have both, for hundreds of columns.

    Each task adds up four matrices over its rows: products, sums and squares
    where the other is present, and counts. What leaves a task is a row for each
    pair, however many rows it read, and pairs meet in one aggregate. Values are
    taken from their columns' means, so that large offsets cost no digits.
    """
    n = len(columns)
    means = df.agg(*[F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    shift = np.array([float(m) for m in means])
    upper = np.triu_indices(n, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((6, n, n))
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns]) - shift
            there = (~np.isnan(x)).astype(float)
            x = np.where(there > 0, x, 0.0)
            s, q = x.T @ there, (x * x).T @ there  # row i, column j: of i where j is there
            sums += np.stack([there.T @ there, s, s.T, q, q.T, x.T @ x])
        cols = [pa.array(m[upper]) for m in sums]
        yield pa.RecordBatch.from_arrays([pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), *cols], names=["i", "j", "n", "x", "y", "xx", "yy", "xy"])

    parts = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)]).mapInArrow(run, "i int, j int, n double, x double, y double, xx double, yy double, xy double")
    total = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    left = lambda c: F.greatest(F.col(c * 2) - F.col(c) * F.col(c) / F.col("n"), F.lit(0.0))
    names = F.array(*map(F.lit, columns))
    corr = F.try_divide(F.col("xy") - F.col("x") * F.col("y") / F.col("n"), F.sqrt(left("x")) * F.sqrt(left("y")))
    out = total.where("n > 0").select(F.element_at(names, F.col("i") + 1).alias("var_1"), F.element_at(names, F.col("j") + 1).alias("var_2"), F.when(F.col("n") > 1, corr).alias("corr"))
    return out if at_least is None else out.where(F.abs("corr") >= at_least)


def tensor_chunks(df: DataFrame, key: str, order: str, column: str, n: int, label: str, size: int = 4096) -> DataFrame:
    """Series cut into chunks that overlap by n values: (key, chunk, times, values, labels, ends, train_until).

    ``ends`` are the 0-based places of a chunk at which a window ends: the n
    values before it are there, and it has a label. So n windows share their
    values, and a table is 1 + n / size times its input. ``train_until`` is the
    last place of the first 80 % of the series, -1 before it. A chunk is a task's
    unit, size + n rows, however long the series.
    """
    size = max(size, n)
    w = Window.partitionBy(key).orderBy(order)
    rn, full = F.row_number().over(w) - 1, F.count(column).over(w.rowsBetween(-n, -1)) == n
    rows = df.select(key, F.col(order).alias("t"), F.col(column).cast("double").alias("v"), F.col(label).cast("double").alias("l"), rn.alias("rn"), full.alias("full"), F.count("*").over(Window.partitionBy(key)).alias("total"))
    own = F.floor(F.col("rn") / size).cast("int")
    twice = rows.withColumn("chunk", F.explode(F.when(F.pmod("rn", F.lit(size)) >= size - n, F.array(own, own + 1)).otherwise(F.array(own))))
    packed = twice.groupBy(key, "chunk").agg(F.sort_array(F.collect_list(F.struct("rn", "t", "v", "l", "full"))).alias("r"), F.first("total").alias("total"))
    first = F.col("r")[0]["rn"]
    ends = F.filter(F.sequence(F.lit(0), F.size("r") - 1), lambda i: F.get("r", i)["full"] & F.get("r", i)["l"].isNotNull() & (F.get("r", i)["rn"] >= F.col("chunk") * size))
    train = F.greatest(F.floor(F.lit(0.8) * F.col("total")) - 1 - first, F.lit(-1)).cast("int")
    return packed.select(key, "chunk", F.col("r.t").alias("times"), F.col("r.v").alias("values"), F.col("r.l").alias("labels"), ends.alias("ends"), train.alias("train_until")).where(F.size("ends") > 0)


def chunk_windows(chunks: DataFrame, key: str, n: int) -> DataFrame:
    """(key, t, window, label, is_train): the windows of ``tensor_chunks``, read by their place."""
    at = chunks.select("*", F.explode("ends").alias("_e"))
    return at.select(key, F.get("times", "_e").alias("t"), F.slice("values", F.col("_e") - n + 1, F.lit(n)).alias("window"), F.get("labels", "_e").alias("label"), (F.col("_e") <= F.col("train_until")).alias("is_train"))


def interval_join(intervals: DataFrame, points: DataFrame, key: str, low: str, high: str, at: str, width: int, most: int = 100_000) -> DataFrame:
    """Every interval with every point in it, both ends included; times as timestamps, ``width`` of a bin in seconds.

    An interval stands in each bin that it touches, a point in one; both meet in
    an equality join on the bin. A bin with more than ``most`` intervals is
    split by the hash of their key, and its points are repeated for each part,
    so that a single bin spreads over many tasks. NULLs match nothing.
    """
    bin_of = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / width)
    pieces = intervals.where(F.col(low) <= F.col(high)).withColumn("_bin", F.explode(F.sequence(bin_of(low), bin_of(high))))
    used = points.where(F.col(at).isNotNull()).withColumn("_bin", bin_of(at))
    splits = pieces.groupBy("_bin").agg(F.ceil(F.count("*") / most).cast("int").alias("_splits"))
    a = pieces.join(splits, "_bin").withColumn("_part", F.pmod(F.xxhash64(key), F.col("_splits")).cast("int")).drop("_splits")
    b = used.join(splits, "_bin").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_splits") - 1))).drop("_splits")
    met = a.join(b, ["_bin", "_part"]).where((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high)))
    return met.drop("_bin", "_part")


def spread_key_grid(keys: DataFrame, times: DataFrame, key: str = "id", time: str = "ts", width: int = 86_400, most: int = 100_000) -> DataFrame:
    """Every observed time for every key from the key's first time on, by an interval join."""
    first = keys.groupBy(key).agg(F.min(time).alias("_first"))
    spans = first.join(F.broadcast(times.agg(F.max(time).alias("_end"))))  # one row
    return interval_join(spans, times.select(time).distinct(), key, "_first", "_end", time, width, most).select(key, time)
