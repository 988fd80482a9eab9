from __future__ import annotations

import random

import numpy as np
import pytest

from barline.llm import licenses, maxscore
from barline.llm.queries import ORACLES, QUERIES
from tests.compare import DATA, connect, difference
from tests.llm.fixtures import no_documents, odd_documents, prose


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    base = f"{DATA}/sf0.001"
    assert difference(connect(base), QUERIES[name](spark, base), ORACLES[name]) is None


def brute_topk(rows, queries, k):
    out = []
    for q, qv in queries:
        best = sorted((-int((qv * v).sum()), i) for i, v in rows if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("shard", "block"), [(65536, 16384), (50, 7)])
def test_topk_by_brute_force_with_ties(spark, shard, block):
    r = random.Random(3)
    data = [(i, [r.choice([-0.5, -0.25, 0.0, 0.25, 0.7]) for _ in range(12)]) for i in range(300)] + [(300 + i, [0.7] * 12) for i in range(5)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    rows = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, v in data]
    got = maxscore.search(df, df.where("vec_id % 10 = 0"), shard=shard, block=block).collect()
    assert sorted(map(tuple, got)) == brute_topk(rows, [x for x in rows if x[0] % 10 == 0], 5)


def test_maxscore_of_one_shard():
    rng = np.random.default_rng(1)
    ids, v = rng.permutation(2000), rng.normal(size=(2000, 16)).round(2)
    v = np.floor(256 * v).astype(np.int64)
    got = [(int(q), i.tolist(), s.tolist()) for q, i, s in maxscore.shard_topk(ids, v, ids[:40], v[:40], 5)]
    rows = list(zip(ids.tolist(), v, strict=True))
    want = brute_topk(rows, rows[:40], 5)
    assert sorted((q, n + 1, i, s) for q, a, b in got for n, (i, s) in enumerate(zip(a, b, strict=True))) == want


def test_topk_of_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [9.0, 9.0]), (5, [1.0]), (6, [1.0, 2.0]), (6, [1.0, 2.0]), (50, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, RANK int")
    got = sorted(map(tuple, maxscore.search(df, df.where("vec_id % 50 = 0")).collect()))
    five = 256 * 256 * 5  # both vectors of id 6 are candidates
    assert got == [(0, 1, 6, five), (0, 2, 6, five), (0, 3, 5, 256 * 256), (0, 4, 50, 0), (50, 1, 0, 0), (50, 2, 5, 0), (50, 3, 6, 0), (50, 4, 6, 0)]
    assert maxscore.search(df.limit(0), df.limit(0)).count() == 0


def test_topk_of_large_vectors(spark):
    """Exact whole numbers where sums pass what doubles or 64 bits hold; an error where a score does."""
    rows = [(0, [1e6, 1e8, -1e8]), (1, [1e6, 0.0, 3.0]), (2, [-1e7, 1.0, 1.0]), (3, [1.0, 1e9, 1e9]), (4, [0.25, 2e6, 1e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = [(i, [int(np.floor(256 * x)) for x in e]) for i, e in rows]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    want = [(0, n + 1, i, -s) for n, (s, i) in enumerate(sorted((-dot(v[0][1], w), i) for i, w in v[1:]))]
    assert sorted(map(tuple, maxscore.search(df, df.where("vec_id = 0")).collect())) == want
    for bad in (1e12, 1e300):
        worse = spark.createDataFrame([*rows, (5, [bad, bad, bad])], df.schema)
        with pytest.raises(Exception, match="beyond"):
            maxscore.search(worse, worse.where("vec_id = 5")).collect()


def brute_places(text: str, templates: dict[str, list[str]]) -> list[tuple[str, int, int, float]]:
    """Every stretch of as many shingles as a template has, from one of its shingles on, that holds four fifths of them; overlapping ones of a licence joined."""
    w, hits = licenses.words_of(text), []
    s = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    for name, ts in templates.items():
        for t in ts:
            tw = licenses.words_of(t)
            n = len(tw) - 4
            if n < 1:
                hits += [(name, a, a + len(tw) - 1, 1.0) for a in range(len(w) - len(tw) + 1) if w[a : a + len(tw)] == tw]
                continue
            want = {tuple(tw[i : i + 5]) for i in range(n)}
            for a in range(len(s)):
                held = [q for q in range(a, min(a + n, len(s))) if s[q] in want]
                if s[a] in want and len({s[q] for q in held}) >= licenses.CONTAINED * len(want):
                    hits.append((name, a, held[-1] + 4, len({s[q] for q in held}) / len(want)))
    out: list[list] = []
    for h in sorted(hits):
        if out and out[-1][0] == h[0] and h[1] <= out[-1][2]:
            out[-1][2:] = [max(out[-1][2], h[2]), max(out[-1][3], h[3])]
        else:
            out.append(list(h))
    return sorted(map(tuple, out), key=lambda x: (x[1], x[0]))


def test_places_do_not_depend_on_batches(spark):
    """Notices close to each other, cut off, edited or repeated, behind texts of any length."""
    r, every = random.Random(5), [(n, t) for n, ts in licenses.ALL_TEMPLATES.items() for t in ts]
    texts = []
    for k in range(150):
        a, b = r.choice(every)[1].split(), r.choice(every)[1].split()
        if k % 3 == 0:
            a[r.randrange(len(a))] = "edited"
        if k % 4 == 0:
            b = b[: -(-len(b) * 9 // 10)]
        texts.append(" ".join([prose(r.randrange(0, 14), k), *a, prose(r.randrange(0, 5), k + 500), *b, *(a if k % 5 == 0 else [])]))
    want = [brute_places(t, licenses.ALL_TEMPLATES) for t in texts]
    scanner = licenses.Scanner(licenses.ALL_TEMPLATES)
    assert [scanner.scan_many([t])[0] for t in texts] == want
    for shift in range(1, 14):
        assert scanner.scan_many([prose(shift + 4, shift), *texts])[1:] == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS licenses", "2 AS matches", "3 AS N_MATCHES")
    for parts in (1, 3, 13):
        got = {r.doc_id: [tuple(m) for m in r.matches] for r in licenses.scan(docs.repartition(parts), licenses.ALL_TEMPLATES).collect()}
        assert got == dict(enumerate(want))


def test_a_containment_beyond_the_bands_is_an_error():
    with pytest.raises(ValueError, match="bands"):
        licenses.Scanner(licenses.TEMPLATES, contained=0.2)


def brute_scan(text: str, templates: dict[str, list[str]]) -> set[str]:
    """Licences of which some stretch holds four fifths of a template's shingles."""
    w, out = licenses.words_of(text), set()
    s = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    for name, ts in templates.items():
        for t in ts:
            tw = licenses.words_of(t)
            want = {tuple(tw[i : i + 5]) for i in range(len(tw) - 4)}
            for a in range(len(s)):
                if want and len(want & set(s[a : a + len(want)])) / len(want) >= licenses.CONTAINED:
                    out.add(name)
    return out


def test_license_scan_by_brute_force():
    r, every = random.Random(2), [(n, t) for n, ts in licenses.TEMPLATES.items() for t in ts]
    texts = []
    for k in range(60):
        name, t = every[k % len(every)]
        w = t.split()
        if len(w) > 20 and k % 3 == 1:
            w[r.randrange(len(w))] = "edited"
        texts.append(f"{prose(r.randrange(0, 90), k)} {' '.join(w)} {prose(r.randrange(0, 90), 99 + k)}")
    texts += [prose(200, 500 + k) for k in range(20)] + [None, "", "MIT License"]
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for together in (50_000, 10):
        found = scanner.scan_many(texts, together)
        assert [{m[0] for m in x} for x in found] == [brute_scan(t or "", licenses.TEMPLATES) for t in texts]
    one = scanner.scan_many(["a b c. Released under the MIT License. d e f"])[0]
    assert [(m[0], m[1], m[2], m[3]) for m in one] == [("MIT", 3, 7, 1.0)]


def test_bands_guarantee():
    for j in (0.3, 0.5, 0.8):
        assert (1 - j) ** licenses.bands_for(j) <= 1e-9
    assert all(c.bands < licenses.MAX_BANDS for c in licenses.Scanner(licenses.TEMPLATES).classes)


def test_license_scan_of_tables(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    want = {r.doc_id: sorted(brute_scan(r.text, licenses.TEMPLATES)) for r in docs.collect()}
    assert {r.doc_id: r.licenses for r in licenses.scan(docs).collect()} == want
    got = {r.doc_id: r.licenses for r in licenses.scan(odd_documents(spark)).collect()}
    assert got[12] == ["MIT"] and got[4] == got[5] == got[10] == []
    clash = odd_documents(spark).selectExpr("*", "'x' AS licenses", "1 AS n_matches", "2 AS containment", "3 AS first_word", "4 AS matches")
    assert {r.doc_id: r.licenses for r in licenses.scan(clash).collect()} == got
    assert licenses.scan(no_documents(spark)).count() == 0


def test_every_licence_line_is_found(spark):
    lines = {
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "All rights reserved.": "proprietary", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    }
    base = f"{DATA}/sf0.01"
    got = {r.doc_id: set(r.licenses) for r in QUERIES["op3_license_scan"](spark, base).collect()}
    seen = set()
    for r in spark.read.parquet(f"{base}/documents.parquet").collect():
        want = {name for line, name in lines.items() if line in (r.text or "")}
        assert want <= got[r.doc_id]
        seen |= want
    assert seen == set(lines.values())


def test_every_template_is_found():
    scanner = licenses.Scanner(licenses.ALL_TEMPLATES)
    for name, ts in licenses.ALL_TEMPLATES.items():
        for t in ts:
            assert name in {m[0] for m in scanner.scan_many([f"{prose(30, 1)} {t} {prose(30, 2)}"])[0]}
            assert scanner.scan_many([t])[0]
    assert scanner.scan_many(["all rights. All rights RESERVED, reserved", "rights reserved all"]) == [[("proprietary", 2, 4, 1.0)], []]
    assert all(c.bands < licenses.MAX_BANDS for c in scanner.classes)
