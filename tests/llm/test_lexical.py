from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from barline.llm import lexical
from tests.llm.fixtures import no_documents, odd_documents


def words(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def brute(docs, items, k):
    held = [(i, Counter(words(t)), len(words(t))) for i, t in docs if words(t)]
    n_docs, total = len(held), sum(n for *_, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in held:
            m = 100 - 25 + (25 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m)) for w in words(text) if w in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, j + 1, x[3], -x[0]) for j, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def corpus(n, seed):
    r = random.Random(seed)
    vocabulary = [f"w{int(r.paretovariate(0.8))}" for _ in range(300)] + ["Éa", "éa", "ÉA", "x9", "the", "THE"]
    return [(i, r.choice([" ", "-", "\n"]).join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 3, 20, 200])))) for i in range(n)]


@pytest.mark.parametrize(("shard", "block", "parts"), [(2_000_000, 1_000_000, 1), (50, 1_000_000, 3), (1, 5, 2)])
def test_search_by_brute_force(spark, shard, block, parts):
    docs = corpus(300, 1) + [(900 + i, "tie tie word") for i in range(30)] + [(950, "tie tie word"), (None, "tie tie word"), (None, None), (3, "w1 again w1"), (3, "w1 again w1")]
    items = corpus(12, 2) + [(50, "tie tie word nothing"), (51, None), (52, "absent words only"), (53, "w1 w1 w1 w2"), (53, "w1"), (None, "word"), (54, "THE the éa")]
    df, asked = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts), spark.createDataFrame(items, "item_id long, text string")
    got = lexical.search(df, asked, k=7, shard=shard, block=block).collect()
    assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got), key=str) == brute(docs, items, 7)


def test_threshold_stops_early_and_only_when_safe():
    """A list of clear winners is left long before its end; ties at the k-th score are read to the smaller id."""
    n = 50_000
    impacts = np.r_[np.arange(n, 0, -1)]
    here = lexical.Shard(np.arange(n), np.ones(n, np.int64), np.zeros(n, np.int64), impacts)
    looked = []
    full = here.scores
    here.scores = lambda docs, times: looked.append(len(docs)) or full(docs, times)
    assert here.search([0], np.array([1]), 5, []) == [(-n + i, i) for i in range(5)]
    assert sum(looked) < 200
    level = lexical.Shard(np.arange(n)[::-1].copy(), np.ones(n, np.int64), np.zeros(n, np.int64), np.full(n, 7))
    assert level.search([0], np.array([2]), 3, []) == [(-14, 0), (-14, 1), (-14, 2)]


def test_odd_tables(spark):
    items = spark.createDataFrame([(1, "the end"), (2, "One two"), (3, "é à"), (4, None)], "item_id long, text string")
    docs = odd_documents(spark)
    got = lexical.search(docs, items).collect()
    assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in items.collect()], 20)
    assert lexical.search(no_documents(spark), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
