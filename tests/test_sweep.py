"""Combination sweeps by the threshold rule against the plain join, and against sorting everything."""

from __future__ import annotations

import itertools
import random
from datetime import date

import numpy as np
import pytest

from barline.operators import portfolio as pf
from barline.operators import sweep as sw


def plain(ranks, members, n, most_missing):
    out = []
    for m in members:
        scored = []
        for i, row in enumerate(ranks):
            held = [row[j] for j in m if row[j] >= 0]
            if len(held) >= max(1, len(m) - most_missing):
                scored.append((sum(held) / len(held), i))
        out.append([i for _, i in sorted(scored)[:n]])
    return out


@pytest.mark.parametrize(("names", "n", "most_missing"), [(1, 3, 0), (7, 10, 0), (40, 5, 0), (300, 8, 0), (300, 8, 1), (300, 8, 2), (60, 1, 3)])
def test_best_names(names, n, most_missing, monkeypatch):
    rng = np.random.default_rng(names + n)
    ranks = rng.integers(1, max(3, names // 2), (names, 6)) * 2
    ranks[rng.random(ranks.shape) < 0.2] = -1
    ranks[:, 5] = -1 if names == 40 else ranks[:, 5]  # nobody has it
    members = np.array(list(itertools.combinations(range(6), 3)))
    monkeypatch.setattr(sw, "CELLS", 500)
    score, name = sw.RankLists(ranks).best(members, n, most_missing)
    assert [x[s != sw.NONE].tolist() for s, x in zip(score, name, strict=True)] == plain(ranks, members, n, most_missing)


def test_lists_are_left_early(monkeypatch):
    """Of rank lists that agree, only the first rows are read."""
    lists = sw.RankLists(np.repeat(np.arange(2, 200_002, 2)[:, None], 3, axis=1))
    depths = []
    met = lists._met
    monkeypatch.setattr(lists, "_met", lambda m, depth, *a: depths.append(depth) or met(m, depth, *a))
    _, name = lists.best(np.array([[0, 1, 2]]), 50)
    assert name[0].tolist() == list(range(50)) and depths == [100]


def panel(spark, dates=6, names=40, seed=3):
    r = random.Random(seed)
    value = lambda: r.choice([None, 0.5, 1.0, 1.5, 2.0, r.random()])
    rows = [(date(2024, 1 + d, 1), f"T{i:03d}", *[value() for _ in range(4)], r.choice([None, r.random() / 10])) for d in range(dates) for i in range(names)]
    return spark.createDataFrame(rows, "date date, ticker string, a double, b double, c double, e double, next_month_return double")


@pytest.mark.parametrize(("most_missing", "shard"), [(0, 65_536), (1, 65_536), (0, 7), (1, 7)])
def test_sweep_as_by_join(spark, monkeypatch, most_missing, shard):
    monkeypatch.setattr(sw, "SHARD", shard)
    df, variables = panel(spark), ["a", "b", "c", "e"]
    combos = spark.createDataFrame([("-".join(c), *c) for c in itertools.combinations(variables, 3)], "model_id string, var_1 string, var_2 string, var_3 string")
    mine = sw.combo_sweep(df, variables, combos, 5, 0.01, most_missing=most_missing)
    theirs = pf.joined_sweep(pf.long_ranks(df, variables, "next_month_return"), combos, 5, 0.01, most_missing=most_missing)
    rows = lambda x: sorted((r.model_id, r.date, round(r.next_month_return, 12), r.turnover, None if r.total_return_idx is None else round(r.total_return_idx, 9)) for r in x.collect())
    assert rows(mine) == rows(theirs)


def test_sweep_of_nothing(spark):
    df = panel(spark)
    combos = spark.createDataFrame([("a-b", "a", "b")], "model_id string, var_1 string, var_2 string")
    assert sw.combo_sweep(df.limit(0), ["a", "b"], combos, 3, 0.01).count() == 0
    assert sw.combo_sweep(df, ["a", "b"], combos.limit(0), 3, 0.01).count() == 0


def test_one_exchange_of_the_panel_and_one_of_the_best(spark):
    combos = spark.createDataFrame([("a-b", "a", "b")], "model_id string, var_1 string, var_2 string")
    plan = sw.combo_sweep(panel(spark), ["a", "b", "c"], combos, 3, 0.01)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
