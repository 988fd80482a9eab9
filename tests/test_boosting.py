"""Boosted trees of many models against a plain fit, one model and one cut at a time."""

from __future__ import annotations

import math
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from barline.operators import boosting as bt

VARIABLES = ["a", "b", "c"]


def rows(n=400, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = (r.choice([None, round(r.random(), 2), round(r.random(), 2), round(r.random(), 2)]) for _ in VARIABLES)
        y = None if r.random() < 0.03 else float((a or 0.2) + (b is None) * 0.3 + r.random() * 0.4 > 0.8)
        out.append((date(2024, 1 + i % 12, 1), f"T{i:03d}", a, b, c, y))
    return out


def frame(spark, data, parts=1):
    return spark.createDataFrame(data, "date date, ticker string, a double, b double, c double, y double").repartition(parts)


def plain_fit(data, s, cuts, objective="logistic", base=0.0):
    """Trees as {node: (variable, cut, missing_left) or value}, by trying every cut on lists of rows."""
    x, y = [r[2:5] for r in data], [r[5] for r in data]
    margin, trees = [base] * len(data), []
    unit = lambda v: round(v * 2**30)
    for k in range(s.trees):
        g, h = [], []
        for m, t in zip(margin, y, strict=True):
            p, w = 1 / (1 + math.exp(-m)), s.pos_weight if t == 1 else 1
            g.append(unit((p - t) * w) if objective == "logistic" else unit(m - t))
            h.append(unit(max(p * (1 - p), 1e-16) * w) if objective == "logistic" else unit(1))
        tree, members = {}, {1: list(range(len(data)))}
        for node in range(1, 2**s.depth):
            if node not in members:
                continue
            at = members[node]
            G, H = sum(g[i] for i in at) / 2**30, sum(h[i] for i in at) / 2**30
            score = lambda a, b: a * a / (b + s.reg_lambda)
            best = None
            for v in s.drawn(k, 3):
                values = [*cuts[VARIABLES[v]], math.inf]
                for j, cut in enumerate(values):
                    for right in (1, 0):
                        left = [i for i in at if (x[i][v] is None and not right) or (x[i][v] is not None and x[i][v] <= cut)]
                        gl, hl = sum(g[i] for i in left) / 2**30, sum(h[i] for i in left) / 2**30
                        gain = score(gl, hl) + score(G - gl, H - hl) - score(G, H)
                        if hl >= s.min_child and H - hl >= s.min_child and gain > max(s.gamma, 1e-6) and (best is None or (gain, -v, -j, right) > best[:4]):
                            best = (gain, -v, -j, right, set(left), cut)
            if best:
                v, inside = -best[1], best[4]
                tree[node] = (VARIABLES[v], best[5], not best[3])
                members[2 * node], members[2 * node + 1] = [i for i in at if i in inside], [i for i in at if i not in inside]
        for node, at in members.items():
            if node not in tree:
                tree[node] = -sum(g[i] for i in at) / 2**30 / (sum(h[i] for i in at) / 2**30 + s.reg_lambda) * s.eta
                for i in at:
                    margin[i] += tree[node]
        trees.append(tree)
    return trees, margin


def fitted(table):
    out = {}
    for r in table.collect():
        out.setdefault(r.model_id, {}).setdefault(r.tree, {})[r.node] = r.value if r.variable is None else (r.variable, math.inf if r.cut is None else r.cut, r.missing_left)
    return out


def same(mine, theirs):
    assert sorted(mine) == sorted(theirs)
    for node, t in theirs.items():
        if isinstance(t, tuple):
            assert mine[node][0] == t[0] and mine[node][2] == t[2] and (mine[node][1] == t[1] or abs(mine[node][1] - t[1]) < 1e-12)
        else:
            assert abs(mine[node] - t) < 1e-9


SPECS = [
    bt.Spec("plain", trees=4, depth=3), bt.Spec("deep", trees=2, depth=4, gamma=0.5, reg_lambda=0.5), bt.Spec("until", trees=3, depth=2, until=6), bt.Spec("fold", trees=2, depth=2, fold=1, pos_weight=5.0),
    bt.Spec("drawn", trees=3, depth=2, columns=0.34), bt.Spec("none", trees=2, depth=2, gamma=1e9), bt.Spec("nobody", trees=1, depth=1, until=-1),
]


@pytest.mark.parametrize(("parts", "objective"), [(1, "logistic"), (4, "logistic"), (3, "squared")])
def test_many_models_as_one_by_one(spark, monkeypatch, parts, objective):
    monkeypatch.setattr(bt, "KEPT", 3)
    data = rows()
    df = frame(spark, data, parts).withColumn("o", F.month("date")).withColumn("f", F.substring("ticker", 2, 3).cast("int") % 3)
    cuts = bt.quantile_cuts(df, VARIABLES, 6, exact=True)
    got = fitted(bt.fit_many(df, "y", VARIABLES, SPECS, objective, "o", "f", cuts))
    known = [r for r in data if r[5] is not None]
    for s in SPECS:
        train = [r for r in known if (s.until is None or r[0].month < s.until) and (s.fold is None or int(r[1][1:]) % 3 != s.fold)]
        if not train:
            assert got[s.model_id] == {0: {1: 0.0}}
            continue
        trees, _ = plain_fit(train, s, cuts, objective)
        for k, t in enumerate(trees):
            same(got[s.model_id][k], t)


def test_predictions(spark):
    data = [r for r in rows(200, 5) if r[5] is not None]
    df = frame(spark, data, 3)
    cuts = bt.quantile_cuts(df, VARIABLES, 5, exact=True)
    s = bt.Spec("m", trees=3, depth=3)
    table = bt.fit_many(df, "y", VARIABLES, [s], cuts=cuts)
    _, margin = plain_fit(data, s, cuts)
    got = {r.ticker: r.pred for r in bt.predict(df.withColumn("model_id", F.lit("m")), table, VARIABLES).collect()}
    assert all(abs(got[r[1]] - 1 / (1 + math.exp(-m))) < 1e-9 for r, m in zip(data, margin, strict=True))
    assert bt.predict(df.withColumn("model_id", F.lit("other")), table, VARIABLES).where("pred is not null").count() == 0
    shares = bt.importance(table).collect()
    assert abs(sum(r.importance for r in shares) - 1) < 1e-9 and sum(r.splits for r in shares) == table.where("variable is not null").count()


def test_walk_forward_sees_earlier_rows_only(spark):
    data = rows(360, 7)
    df = frame(spark, data)
    pred, table = bt.walk_forward_many(df, "y", VARIABLES, 9, trees=2, depth=2, cuts=bt.quantile_cuts(df, VARIABLES, 6, exact=True))
    changed = frame(spark, [(*r[:5], 1.0 - r[5] if r[5] is not None and r[0].month >= 11 else r[5]) for r in data])
    again, _ = bt.walk_forward_many(changed, "y", VARIABLES, 9, trees=2, depth=2, cuts=bt.quantile_cuts(df, VARIABLES, 6, exact=True))
    by = lambda p: {(r.date, r.ticker): r.pred for r in p.collect()}
    a, b = by(pred), by(again)
    assert {k[0].month for k in a} == {10, 11, 12} and len(a) == sum(r[0].month >= 10 for r in data)
    assert all(a[k] == b[k] for k in a if k[0].month <= 11)
    assert table.select("model_id").distinct().count() == 3


def test_too_few_dates_and_empty_tables(spark):
    df = frame(spark, rows(50))
    for some, cutoff in ((df, 12), (df, 40), (df.limit(0), 0)):
        pred, table = bt.walk_forward_many(some, "y", VARIABLES, cutoff, min_train_rows=2)
        assert pred.count() == 0 and table.count() == 0
    assert bt.fit_many(df, "y", VARIABLES, []).count() == 0


def test_search(spark):
    data = [r for r in rows(300, 9) if r[5] is not None]
    df = frame(spark, data, 2)
    space = {"depth": [1, 2], "eta": [0.1, 0.5], "pos_weight": [1, 4]}
    got = bt.search_many(df, "y", VARIABLES, space, draws=5, trees=3).collect()
    assert len(got) == 5 and len({tuple(r)[1:4] for r in got}) == 5 and [r.mean_f1 for r in got] == sorted((r.mean_f1 for r in got), reverse=True)
    best = got[0]
    folds = {r.ticker: r.f for r in df.select("ticker", F.pmod(F.xxhash64(F.col("date").cast("string"), F.col("ticker")), F.lit(3)).alias("f")).collect()}
    cuts, scores = bt.quantile_cuts(df, VARIABLES), []
    for f in range(3):
        s = bt.Spec("m", trees=3, depth=int(best.depth), eta=best.eta, pos_weight=best.pos_weight)
        trees, _ = plain_fit([r for r in data if folds[r[1]] != f], s, cuts)
        tp = fp = fn = 0
        for r in data:
            if folds[r[1]] == f:
                said = sum(_value(t, dict(zip(VARIABLES, r[2:5], strict=True))) for t in trees) > 0
                tp, fp, fn = tp + (said and r[5] == 1), fp + (said and r[5] == 0), fn + (not said and r[5] == 1)
        scores.append(2 * tp / (2 * tp + fp + fn) if tp else 0.0)
    assert abs(best.mean_f1 - sum(scores) / 3) < 1e-9


def _value(tree, x):
    node = 1
    while isinstance(tree[node], tuple):
        v, cut, left = tree[node]
        node = 2 * node + (not left if x[v] is None else x[v] > cut)
    return tree[node]


def test_swaps_of_prefixes(spark):
    r = random.Random(3)
    data = []
    for i in range(300):
        a, b, c, d = (round(r.random(), 2) for _ in range(4))
        data.append((i, a, b, c, d, float(b + 0.2 * r.random() > 0.6)))
    df = spark.createDataFrame(data, "i int, x_yoy double, x_3mom double, z_yoy double, z_3mom double, y double")
    got = bt.swap_prefixes(df.where("i < 200"), df.where("i >= 200"), "y", ["x_yoy", "z_yoy", "lone_yoy"][:2], {"yoy": "3mom", "dyoy": "d3mom"}, trees=3, depth=2).orderBy("place").collect()
    assert [(r.variable, r.replacement) for r in got] == [("x_yoy", "x_3mom"), ("z_yoy", "z_3mom")]
    assert got[0].replaced and got[0].f1_replaced > 0.9 > got[0].f1 and got[1].f1 == got[0].f1_replaced
    assert got[1].replaced == (got[1].f1_replaced > got[1].f1)
    assert bt.swap_prefixes(df, df, "y", ["x_3mom"], {"yoy": "3mom"}, trees=1, depth=1).count() == 0
