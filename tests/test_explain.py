"""Shapley values of trees against the sum over all subsets of known variables."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from barline.operators import boosting as bt
from barline.operators import explain as ex
from barline.operators import models

NAMES = ["a", "b", "c", "d", "e"]


def frame(spark, n=250, missing=0.15, seed=4):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x = [None if r.random() < missing else round(r.random(), 2) for _ in NAMES]
        y = float((x[0] or 0.3) + (x[1] or 0.9) * (x[2] or 0.1) + (x[3] is None) * 0.2 + r.random() * 0.2 > 0.7)
        rows.append((i, *x, y))
    return spark.createDataFrame(rows, "i int, " + ", ".join(f"{v} double" for v in NAMES) + ", y double")


def known_value(nodes, n, x, known):
    """A tree's expected value where only some variables are known."""
    r = nodes[n]
    if r.variable is None:
        return r.value
    if r.variable in known:
        left = r.missing_left if x[r.variable] is None else x[r.variable] <= (math.inf if r.cut is None else r.cut)
        return known_value(nodes, 2 * n if left else 2 * n + 1, x, known)
    a, b = nodes[2 * n].cover, nodes[2 * n + 1].cover
    return (a * known_value(nodes, 2 * n, x, known) + b * known_value(nodes, 2 * n + 1, x, known)) / (a + b)


def by_subsets(table, x):
    trees = {}
    for r in table:
        trees.setdefault(r.tree, {})[r.node] = r
    value = {s: sum(known_value(t, 1, x, s) for t in trees.values()) for k in range(6) for s in map(frozenset, itertools.combinations(NAMES, k))}
    out = []
    for v in NAMES:
        rest = [u for u in NAMES if u != v]
        out.append(sum(math.factorial(len(s)) * math.factorial(4 - len(s)) / math.factorial(5) * (value[s | {v}] - value[s]) for k in range(5) for s in map(frozenset, itertools.combinations(rest, k))))
    return value[frozenset()], out, value[frozenset(NAMES)]


def check(df, table):
    rows = table.collect()
    for r in ex.explain(df.withColumn("model_id", F.lit("m")), table, NAMES).limit(40).collect():
        expected, parts, margin = by_subsets(rows, {v: r[v] for v in NAMES})
        assert abs(r.expected - expected) < 1e-9 and all(abs(a - b) < 1e-9 for a, b in zip(r.contributions, parts, strict=True))
        assert abs(r.expected + sum(r.contributions) - margin) < 1e-9


@pytest.mark.parametrize("depth", [1, 4])
def test_boosted_trees(spark, depth):
    df = frame(spark)
    check(df, bt.fit_many(df, "y", NAMES, [bt.Spec("m", trees=2, depth=depth, min_child=0.5)], bins=12))


@pytest.mark.parametrize("algorithm", ["rf_reg", "gbt_reg"])
def test_forests_of_the_library(spark, algorithm):
    df = frame(spark, missing=0.0)
    params = {"numTrees": 4} if algorithm == "rf_reg" else {"maxIter": 3}
    fitted = models.pipeline(algorithm, "y", NAMES, maxDepth=4, seed=1, **params).fit(df)
    table = ex.node_table(fitted.stages[-1], NAMES)
    check(df, table)
    sums = {r.i: r.expected + sum(r.contributions) for r in ex.explain(df.withColumn("model_id", F.lit("m")), table, NAMES).collect()}
    assert all(abs(sums[r.i] - r.prediction) < 1e-9 for r in fitted.transform(df).collect())


def test_no_model(spark):
    df = frame(spark, 5).withColumn("model_id", F.lit("other"))
    table = spark.createDataFrame([("m", 0, 1, None, None, None, 0.5, None, 3.0)], bt.TABLE)
    assert [tuple(r[-2:]) for r in ex.explain(df, table, NAMES).collect()] == [(None, None)] * 5
    assert [tuple(r[-2:]) for r in ex.explain(df.limit(1).withColumn("model_id", F.lit("m")), table, NAMES).collect()] == [(0.5, [0.0] * 5)]
