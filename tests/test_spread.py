"""Operators that spread one hot group over all tasks, against plain versions."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barline.functions import ranks as rk
from barline.operators import features as ft
from barline.operators import relational as rel
from barline.operators import spread as sp


@pytest.mark.parametrize(("descending", "parts"), [(True, 64), (False, 5)])
def test_ranks_of_one_hot_group(spark, descending, parts):
    r = random.Random(2)
    rows = [(i, r.choice([None, "hot", "hot", "hot", "b"]), r.choice([None, 0.0, 0.0, round(r.random(), 2), r.random()])) for i in range(3000)] + [(9999, "alone", 1.0), (9998, "none", None)]
    df = spark.createDataFrame(rows, "i int, g string, x double").repartition(4)
    got = sp.spread_ranks(df, "x", ["g"], descending, parts)
    order = Window.partitionBy("g").orderBy(F.desc_nulls_last("x") if descending else F.asc_nulls_last("x"))
    want = df.select(
        "i", rk.guarded_rank("x", ["g"], descending).alias("rank"), F.when(F.col("x").isNotNull(), F.dense_rank().over(order)).alias("dense_rank"), rk.average_rank("x", ["g"], descending).alias("average_rank"),
        rk.pct_rank("x", ["g"], descending).alias("pct_rank"), rk.sql_percent_rank("x", ["g"], descending).alias("percent_rank"),
    )
    cols = ["i", "rank", "dense_rank", "average_rank", "pct_rank", "percent_rank"]
    plain = lambda d: sorted(tuple(None if v is None else round(float(v), 9) for v in t) for t in d.select(*cols).collect())
    assert plain(got) == plain(want)
    assert sp.spread_ranks(df.limit(0), "x", ["g"]).count() == 0


def test_no_task_has_a_whole_group(spark):
    """The windows over values are partitioned by range as well, and ranges are of a like size."""
    df = spark.range(20_000).select(F.lit("one day").alias("g"), F.hash("id").cast("double").alias("x"))
    plan = sp.spread_ranks(df, "x", ["g"], parts=20)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "_x#" in line]
    assert windows and all("_part#" in line for line in windows)
    cuts = df.agg(F.percentile_approx("x", [i / 20 for i in range(1, 20)], 200)).first()[0]
    sizes = np.bincount(np.searchsorted(cuts, np.array([r.x for r in df.collect()])), minlength=20)
    assert sizes.max() < 3 * 20_000 / 20


def test_correlations_of_many_columns(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 200)) + 1e6
    x[:, 1] = x[:, 0] * 2
    x[:, 2] = 5.0
    x[rng.random(x.shape) < 0.1] = np.nan
    names = [f"c{i}" for i in range(200)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"{n} double" for n in names)).repartition(3)
    got = {(r.var_1, r.var_2): r.corr for r in sp.gram_correlations(df, names).collect()}
    assert len(got) == 200 * 199 // 2
    for a, b in ((0, 1), (0, 3), (5, 77), (198, 199)):
        both = ~np.isnan(x[:, a]) & ~np.isnan(x[:, b])
        assert abs(got[f"c{a}", f"c{b}"] - np.corrcoef(x[both, a], x[both, b])[0, 1]) < 1e-8
    assert got["c0", "c2"] is None  # no deviation
    few = [n for n in names[:6] if n != "c2"]  # the plain aggregate fails where nothing deviates
    plain = {(r.var_1, r.var_2): r.corr for r in rel.correlation_pairs(df, few).collect()}
    assert all(plain[k] is None or abs(got[k] - plain[k]) < 1e-6 for k in plain)
    assert sp.gram_correlations(df.limit(0), few).count() == 0


@pytest.mark.parametrize(("n", "size"), [(5, 8), (5, 5), (12, 3), (150, 400)])
def test_chunks_give_the_windows(spark, n, size):
    r = random.Random(n)
    rows = [(k, i, None if r.random() < (0.002 if n == 150 else 0.05) else r.random(), None if r.random() < 0.05 else float(i)) for k, m in (("a", 900), ("b", n), ("c", n + 1), ("d", 1)) for i in range(m)]
    df = spark.createDataFrame(rows, "k string, t int, v double, l double")
    mine = sp.chunk_windows(sp.tensor_chunks(df, "k", "t", "v", n, "l", size), "k", n)
    theirs = ft.tensor_windows(df, "k", "t", "v", n, "l")
    plain = lambda d, t: sorted((x.k, x[t], tuple(x.window), x.label, x.is_train) for x in d.collect())
    assert plain(mine, "t") == plain(theirs, "t")


def test_chunks_are_small(spark, tmp_path):
    df = spark.range(40_000).select((F.col("id") % 2).alias("k"), F.col("id").alias("t"), F.rand(1).alias("v"), F.lit(1.0).alias("l"))
    chunks = sp.tensor_chunks(df, "k", "t", "v", 150, "l")
    assert chunks.agg(F.sum(F.size("values"))).first()[0] < 1.05 * 40_000
    assert chunks.agg(F.sum(F.size("ends"))).first()[0] == 40_000 - 2 * 150


@pytest.mark.parametrize("most", [100_000, 3])
def test_intervals(spark, most):
    r, t0 = random.Random(5), datetime(2024, 1, 1)
    at = lambda: t0 + timedelta(minutes=r.randrange(6 * 1440))
    spans = [(i, a, a + timedelta(hours=r.choice([0, 1, 30, -2]))) for i in range(60) for a in [at()]] + [(100, None, t0), (101, t0, None)]
    points = [(j, at()) for j in range(150)] + [(999, None), (1000, spans[0][1]), (1000, spans[0][1])]
    a = spark.createDataFrame(spans, "i int, low timestamp_ntz, high timestamp_ntz")
    b = spark.createDataFrame(points, "j int, t timestamp_ntz")
    got = sorted((x.i, x.j) for x in sp.interval_join(a, b, "i", "low", "high", "t", 86_400, most).collect())
    assert got == sorted((i, j) for i, lo, hi in spans for j, t in points if lo and hi and t and lo <= t <= hi)


def test_parts_are_not_sent_through_the_driver(spark):
    """Lines meet their parts by a merge, however small the parts are."""
    from barline.sources import canonical
    from tests.compare import DATA

    plan = canonical.prices(spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
