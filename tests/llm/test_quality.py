from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from barline.llm import mixing, quality_gbt, quality_rules
from tests.compare import DATA
from tests.llm.fixtures import no_documents, no_labels, odd_documents


def plain_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_statistics_of_odd_rows(spark):
    docs = odd_documents(spark)
    got = quality_rules.statistics(docs).collect()
    assert len(got) == 16
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_statistics(r.text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)


def test_binomial_tail_is_exact(spark):
    rows = [(n, k) for n in (0, 10, 400, 3000) for k in range(0, 8)]
    got = spark.createDataFrame(rows, "n long, k long").select("n", "k", quality_rules.binomial_tail("n", "k", 0.005).alias("p")).collect()
    for r in got:
        exact = sum(math.comb(r.n, j) * 0.005**j * 0.995 ** (r.n - j) for j in range(r.k + 1)) if r.k <= 0.005 * r.n else 1.0
        assert abs(r.p - exact) < 1e-9


def test_cutoffs_keep_their_promise(spark):
    """Good rows have few symbols, bad ones many: a cutoff is taken between, in the large stratum alone."""
    rng = np.random.default_rng(4)
    rows = [("en", 1, int(rng.integers(0, 3))) for _ in range(3000)] + [("en", 0, int(rng.integers(40, 200))) for _ in range(200)] + [("xx", 1, 0)] * 50 + [("xx", 0, 90)] * 50
    df = spark.createDataFrame(rows, "lang string, quality int, n_symbols long").selectExpr("*", "100L n_words", "450L word_chars", "0L n_dup_lines", "0L n_repeat_words", "false base_failed")
    got = quality_rules.thresholds(df).collect()
    assert [(r.stratum, r.statistic) for r in got] == [("en", "symbol_pm")] and 20 <= got[0].cutoff <= 400
    assert quality_rules.thresholds(df.limit(0)).count() == 0


def test_judge_without_labels_or_rows(spark):
    docs = odd_documents(spark)
    got = quality_rules.judge(docs, no_labels(spark)).collect()
    assert len(got) == 16 and all(r.kept == (not r.base_failed) for r in got)
    assert quality_rules.judge(no_documents(spark), no_labels(spark)).count() == 0
    kept = quality_rules.reject(docs, no_labels(spark))
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got) and {r._row for r in kept.collect()} == {3}


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    model = quality_gbt.fit(x[:2000], y[:2000])
    assert (((model.score(x[2000:]) > 0.5) == y[2000:]).mean()) > 0.9

    def walk(t: int, row: np.ndarray) -> float:
        at = 0
        for _ in range(model.depth):
            at = 2 * at + 1 + int(row[model.feature[t, at]] > model.threshold[t, at])
        return model.value[t, at - (2**model.depth - 1)]

    one = [model.base + sum(walk(t, r) for t in range(len(model.feature))) for r in x[:20]]
    assert np.allclose(one, model.margin(x[:20]))
    for xs, ys in ((x[:0], y[:0]), (x[:9], np.ones(9))):
        s = quality_gbt.fit(xs, ys).score(x)
        assert (s == s[0]).all() and 0 < s[0] < 1


def brute_leaves(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, smooth: float, least: float) -> np.ndarray:
    """Every feature, every value as a cut, node by node; each row's leaf value."""
    worth = lambda m: g[m].sum() ** 2 / (h[m].sum() + smooth)
    best, cut, every = 1e-9, None, np.ones(len(x), bool)
    for j in range(x.shape[1] if depth else 0):
        for c in sorted(set(x[:, j])):
            left = x[:, j] <= c
            if least <= left.sum() <= len(x) - least and (gain := worth(left) + worth(~left) - worth(every)) > best + 1e-12:
                best, cut = gain, left
    if cut is None:
        return np.full(len(x), g.sum() / (h.sum() + smooth))
    out = np.zeros(len(x))
    for m in (cut, ~cut):
        out[m] = brute_leaves(x[m], g[m], h[m], depth - 1, smooth, least)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_trees_by_brute_force(seed):
    """Few values a feature, so that histograms hold every cut: the same trees as from all cuts tried one by one."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, size=(400, 4)).astype(float)
    y = (x[:, 0] + 2 * (x[:, 1] > 5) * (x[:, 2] > 3) * 4 + rng.normal(size=400) * 3 > 9).astype(float)
    model = quality_gbt.fit(x, y, trees=5, depth=3)
    margin = np.full(400, math.log((y.sum() + 1) / (401 - y.sum())))
    for _ in range(5):
        q = 1 / (1 + np.exp(-margin))
        margin = margin + 0.15 * brute_leaves(x, y - q, q * (1 - q), 3, 2.0, 5.0)
    assert np.allclose(margin, model.margin(x), atol=1e-9)


def test_classifier_holds_out(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality_gbt.classify(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    held = [(r.quality, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) > 0.93
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    assert {r.doc_id: r.score for r in quality_gbt.classify(docs, flipped).collect()} == {i: r.score for i, r in got.items()}


def test_classifier_of_odd_rows(spark):
    got = quality_gbt.classify(odd_documents(spark), no_labels(spark)).collect()
    assert len(got) == 16 and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {0}
    assert quality_gbt.classify(no_documents(spark), no_labels(spark)).count() == 0
    both = spark.createDataFrame([(i, q, 0) for i in (1, 2, 3, 8, 9, 11, 12, None) for q in (0, 1)] + [(10, 1, 0), (10, 1, 0), (13, 0, 0), (14, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    told = quality_gbt.classify(odd_documents(spark), both).collect()  # each of two labels counts once
    assert len(told) == 16 and all(0 < r.score < 1 for r in told)
    assert all(np.isfinite(quality_gbt.features(t)).all() for t in (None, "", "a", "a b\n\nc", "é" * 9))


def brute_rates(p: np.ndarray, n: np.ndarray, target: np.ndarray, ridge: float, least: float) -> np.ndarray:
    total, natural, r = n.sum(), n @ p, np.ones(len(n))
    for _ in range(4000):
        g = p @ (((n * r) @ p - target) / natural) + ridge * (r - 1)
        r = np.maximum(least, r - 0.5 * g)
    assert total > 0
    return r


def test_rates_by_brute_force(spark):
    rng = np.random.default_rng(7)
    p = rng.dirichlet([0.4, 0.4, 0.4], 60)
    n = rng.integers(1, 500, 60)
    table = spark.createDataFrame([(i, int(a), b.tolist()) for i, (a, b) in enumerate(zip(n, p, strict=True))], "i int, tokens long, p array<double>").cache()
    target = n.sum() * np.array([0.6, 0.25, 0.15])
    for ridge, least in ((0.05, 0.0), (0.05, 0.8)):
        rate, seen = mixing.fit_rates(table, target.tolist(), ridge=ridge, close=1e-7, least=least)
        got = np.array([r.rate for r in table.select("i", rate.alias("rate")).orderBy("i").collect()])
        assert np.abs(got - brute_rates(p, n, target, ridge, least)).max() < 1e-5 and got.min() >= least
    with pytest.raises(ArithmeticError):
        mixing.fit_rates(table, target.tolist(), rounds=2)
    rate, seen = mixing.fit_rates(table, target.tolist())
    assert np.abs(np.array(seen[-1]) - target).max() < 1e-3 * target.sum()


def test_mix_meets_weights(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    weights = {"en": 0.4, "fr": 0.3, "de": 0.2, "es": 0.1}
    got = mixing.rates(docs, docs.selectExpr("doc_id", "lang AS domain"), weights).collect()
    tokens = Counter()
    for r in got:
        for k, x in zip(sorted(weights), r.posterior, strict=True):
            tokens[k] += r.tokens * r.rate * x
    assert all(abs(tokens[k] / sum(tokens.values()) - w) < 0.01 for k, w in weights.items())
    assert min(r.rate for r in got) >= 1 and all(r.copies in (int(r.rate), int(r.rate) + 1) for r in got)
    right = {r.doc_id: r.domain for r in got}
    assert np.mean([right[r.doc_id] == r.lang for r in docs.where("n_chars > 300").collect()]) > 0.95
    mixed = mixing.mix(docs, docs.selectExpr("doc_id", "lang AS domain"), weights)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)


def test_rates_of_the_query_are_the_minimum(spark):
    """Posteriors by plain Python, and rates that meet the condition of the minimum."""
    from barline.llm.queries import MIX_WEIGHTS, labelled_domains, op7_mixing

    base = f"{DATA}/sf0.01"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in op7_mixing(spark, base).collect()}
    names, model = mixing.classifier(docs, labelled_domains(docs, labels))
    texts = {r.doc_id: r.text for r in docs.collect()}
    some = sorted({w for i in list(texts)[::20] for w in plain_words(texts[i])})
    bucket = dict(spark.createDataFrame([(w,) for w in some], "w string").selectExpr("w", f"pmod(xxhash64(w), {mixing.BUCKETS}) b").collect())
    for i in list(texts)[::20]:
        w = [bucket[x] for x in plain_words(texts[i])]
        logs = np.array([m[-1] + min(1.0, mixing.EVIDENCE / max(len(w), 1)) * sum(m[b] for b in w) for m in model])
        want = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
        assert np.abs(want - got[i].posterior).max() < 1e-9 and got[i].tokens == len(w)
    p, n, r = (np.array([x[c] for x in got.values()], dtype=float) for c in ("posterior", "tokens", "rate"))
    natural, share = n @ p, np.array([MIX_WEIGHTS[k] for k in names])
    target = share / share.sum() * (natural / (share / share.sum())).max()
    steps = ((n * r) @ p - target) / natural / mixing.RIDGE
    assert np.abs(np.maximum(1.0, 1 - p @ steps) - r).max() < 3 * mixing.CLOSE / mixing.RIDGE


def plain_words(text: str | None) -> list[str]:
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]


def test_labels_that_repeat_or_contradict(spark):
    docs = spark.createDataFrame([(1, "a b c d", 5), (2, "e f g h", 6), (3, "a b e", 7)], "doc_id long, text string, ROW int")
    lab = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "y"), (None, "x"), (9, "x"), (3, None)], "doc_id long, domain string")
    names, model = mixing.classifier(docs, lab)
    assert names == ["x", "y"] and abs(math.exp(model[0][-1]) - 3 / 5) < 1e-9
    got = {r.doc_id: r for r in mixing.rates(docs, lab, {"x": 1, "y": 1}).collect()}
    assert got[1].posterior[0] > 0.5 > got[2].posterior[0] and all(r.rate >= 1 for r in got.values())
    assert mixing.mix(docs, lab, {"x": 1, "y": 1}).columns == docs.columns
    clash = docs.selectExpr("*", "1 AS tokens", "2 AS rate", "3 AS copies", "4 AS p", "5 AS b", "6 AS w")
    assert {r.doc_id: r.rate for r in mixing.rates(clash, lab, {"x": 1, "y": 1}).collect()} == {i: r.rate for i, r in got.items()}


def test_mix_of_odd_rows(spark):
    docs = odd_documents(spark)
    lab = docs.selectExpr("doc_id", "lang AS domain")
    assert sorted(r.rate for r in mixing.rates(docs, lab.limit(0), {"en": 1.0}).collect())[-1] == 1.0
    assert mixing.rates(docs, lab, {"zz": 1.0}).select("rate").distinct().collect()[0].rate == 1.0
    out = mixing.mix(docs, lab, {"en": 1.0})
    assert out.columns == docs.columns and out.count() == 16 and {r._row for r in out.collect()} == {3}
    assert mixing.mix(no_documents(spark), lab, {"en": 1.0}).count() == 0
