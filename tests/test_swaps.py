"""Greedy swaps of variables: every name is a candidate, and no swap that improves is left."""

from __future__ import annotations

import itertools
import random

import pytest

from barline.operators import models
from tests.compare import DATA

BASE = f"{DATA}/sf0.001"


@pytest.fixture
def given(monkeypatch):
    """Scores by table in place of fits; the sets that were fitted, in order."""
    fitted, scores = [], {}

    class Given:
        def __init__(self, *a, **k):
            pass

        def fit(self, train):
            return self

        def transform(self, valid):
            return self.names

        def evaluate(self, names):
            return scores[names]

    def pipe(algorithm, y, variables, **params):
        out = Given()
        out.names = frozenset(variables)
        fitted.append(out.names)
        return out

    monkeypatch.setattr(models, "pipeline", pipe)
    monkeypatch.setattr(models, "MulticlassClassificationEvaluator", Given)
    return fitted, scores


def swaps(chosen, every):
    return [frozenset([*chosen[:i], o, *chosen[i + 1 :]]) for i in range(len(chosen)) for o in every if o not in chosen]


def test_replaced_names_are_candidates_again(spark, given):
    fitted, scores = given
    scores |= {frozenset("ab"): 0.1, frozenset("cb"): 0.2, frozenset("ca"): 0.3}
    assert models.swap_test(spark.range(1), spark.range(1), "y", ["a", "b"], ["c"]) == (["c", "a"], 0.3)
    assert len(fitted) == len(set(fitted)) == 3


def test_no_swap_that_improves_is_left(spark, given):
    fitted, scores = given
    df, r = spark.range(1), random.Random(5)
    for _ in range(60):
        fitted.clear()
        scores |= {frozenset(s): r.randrange(40) / 40 for s in itertools.combinations("abcdef", 3)}
        chosen, best = models.swap_test(df, df, "y", list("abc"), list("def"))
        assert best == scores[frozenset(chosen)] >= scores[frozenset("abc")] and len(set(chosen)) == 3
        assert all(scores[s] <= best for s in swaps(chosen, "abcdef"))
        assert len(fitted) == len(set(fitted))


def test_query_tries_all_variables(spark, monkeypatch):
    from barline.plans import QUERIES
    from barline.plans.research import VARIABLES, _rows

    tried, real = set(), models.pipeline
    monkeypatch.setattr(models, "pipeline", lambda a, y, vs, **p: (tried.add(frozenset(vs)), real(a, y, vs, **p))[1])
    got = QUERIES["swapped_variables"](spark, BASE).orderBy("place").collect()
    chosen = [r.variable for r in got]
    assert set().union(*tried) == set(VARIABLES) and set(swaps(chosen, VARIABLES)) <= tried
    early, late = (x.cache() for x in models.split_by_date(_rows(spark, BASE)))
    ev = models.MulticlassClassificationEvaluator(labelCol="y", metricName="f1")
    f1 = lambda s: ev.evaluate(real("gbt", "y", [v for v in VARIABLES if v in s], maxIter=2, maxDepth=2, seed=1).fit(early).transform(late))
    assert abs(f1(chosen) - got[0].f1) < 1e-9 and all(f1(s) < got[0].f1 + 1e-9 for s in swaps(chosen, VARIABLES))
