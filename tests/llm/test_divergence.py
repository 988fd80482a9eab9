from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from barline.llm import divergence
from tests.llm.fixtures import DOCS, no_documents, odd_documents


def words(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", folded)


def brute(rows, least, top):
    df, count, lang_count = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in ((a or "", b or "", c) for a, b, c in rows):
        w = words(text)
        df[lang].update(set(w))
        count[lang, source].update(w)
        lang_count[lang].update(w)
    gap = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang in df:
        kept = [w for w, n in df[lang].items() if n >= least]
        share = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for w in kept}  # noqa: B023, E731
        q = share(lang_count[lang])
        p = {s: share(count[x, s]) for x, s in count if x == lang}
        for s in p:
            pairs = sorted((-sum(gap(p[s][w], p[o][w]) for w in kept), o) for o in p if o != s)
            terms = sorted((-gap(p[s][w], q[w]), w.encode(), w) for w in kept if count[lang, s][w] and p[s][w] > q[w])[:top]
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, o) in enumerate(pairs)] + [(lang, s, "term", w, -v, i + 1) for i, (v, _, w) in enumerate(terms)]
    return sorted(out)


def corpus(n, seed):
    r = random.Random(seed)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["É", "é", "日本", "The", "the", "THE"]
    text = lambda: r.choice([" ", "-", "9"]).join(r.choice(vocabulary[: r.choice([20, 126])]) for _ in range(r.choice([0, 1, 4, 30])))
    return [(r.choice(["en", "de", "", None]), r.choice(["a", "b", "c", "hot", "hot", "hot", None, ""]), text() if r.random() > 0.05 else None) for _ in range(n)]


def result(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


@pytest.mark.parametrize(("least", "width", "held", "parts"), [(10, None, 200_000, 1), (3, 1 << 16, 5, 4), (1, 1 << 16, 200_000, 3), (1000, None, 200_000, 2)])
def test_audit_by_brute_force(spark, monkeypatch, least, width, held, parts):
    rows = corpus(400, 3) + [("xx", "only", "lonely words here")] * 12 + [("xx2", "none", "")]
    monkeypatch.setattr(divergence, "HELD", held)
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(parts)
    assert result(divergence.audit(df, least=least, top=4, width=width)) == brute(rows, least, 4)


def test_sketch_never_underestimates():
    rng = np.random.default_rng(4)
    hashes = np.unique(rng.integers(0, 2**63, 40_000).astype(np.uint64))
    counts = rng.integers(1, 15, len(hashes))
    sketch = divergence.Sketch(1 << 16, 10)
    for part in np.array_split(np.arange(len(hashes)), 7):
        half = counts[part] // 2  # in two instalments
        sketch.add(hashes[part], half)
        sketch.add(hashes[part], counts[part] - half)
    bits = np.packbits(sketch.cells >= 10)
    ok = divergence.possible(bits, hashes, 1 << 16)
    assert ok[counts >= 10].all()
    few = rng.choice(len(hashes), 2000, replace=False)
    small = divergence.Sketch(1 << 16, 10)
    small.add(hashes[few], counts[few])
    ok = divergence.possible(np.packbits(small.cells >= 10), hashes[few], 1 << 16)
    assert ok[counts[few] >= 10].all()
    assert ok[counts[few] < 10].mean() < 0.05


def test_counts_beyond_64_bit_products(spark):
    """Shares are exact where 10^9 x count passes 64 bits."""
    c, t, v = 7 * 10**14 + 3, 10**15 + 1, 12_345
    got = spark.range(1).select(divergence.share(divergence.F.lit(c), divergence.F.lit(t), divergence.F.lit(v)).alias("p")).first().p
    assert got == 1 + 10**9 * (c + 2) // (t + 2 * v)


def test_odd_tables(spark):
    docs = odd_documents(spark)
    assert result(divergence.audit(docs, least=2)) == brute([(r.lang, r.source, r.text) for r in docs.collect()], 2, 10)
    assert divergence.audit(no_documents(spark)).count() == 0
    one = spark.createDataFrame([(1, "a b", "en", "s", 3)], DOCS).selectExpr("*", "1 AS Term", "2 AS p0", "3 AS value")
    assert divergence.audit(one).count() == 0
