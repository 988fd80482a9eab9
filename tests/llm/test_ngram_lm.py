from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from barline.llm import elias_fano, ngram_lm
from tests.compare import DATA
from tests.llm.fixtures import no_documents, odd_documents


@pytest.mark.parametrize("top", [1, 50, 5_000, 10**9])
def test_elias_fano(top, tmp_path):
    r = random.Random(top)
    v = np.array(sorted(r.randrange(top) for _ in range(3000)), dtype=np.uint64)
    (tmp_path / "x").write_bytes(b"".join(elias_fano.dump(elias_fano.build(v, "s"))))
    e = elias_fano.EliasFano(elias_fano.load(str(tmp_path / "x")), "s")
    assert (e.access(np.arange(3000)) == v).all()
    q = np.array([r.randrange(top + 10) for _ in range(2000)] + v[::7].tolist(), dtype=np.uint64)
    at, found = e.successor(q)
    known = set(v.tolist())
    assert found.tolist() == [int(x) in known for x in q]
    assert (at[found] == np.searchsorted(v, q[found])).all()


def brute(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    held = [zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False for i, _ in rows]
    texts = [ngram_lm.tokens(t) for _, t in rows]
    uni, pair, span = Counter(), Counter(), Counter()
    for t, h in zip(texts, held, strict=True):
        if not h:
            uni.update(t)
            pair.update(zip([ngram_lm.END, *t], t, strict=False))
    for a, _ in pair:
        span[a] += 1
    n, v, d = sum(uni.values()), len(uni), ngram_lm.DISCOUNT
    out = []
    for (i, _), t, h in zip(rows, texts, held, strict=True):
        p1 = [(uni[w] + 1) / (n + v + 1) for w in t]
        p2 = [(max(pair[a, b] - d, 0) + d * span[a] * p) / uni[a] if uni[a] else p for a, b, p in zip([ngram_lm.END, *t], t, p1, strict=False)]
        out.append((i, h, len(t), sum(uni[w] > 0 for w in t), n, sum(map(math.log10, p1)), sum(map(math.log10, p2))))
    return out


def check(rows, got):
    want = brute(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    for a, b in zip(sorted(want, key=key), sorted(map(tuple, got), key=key), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 and abs(a[6] - b[6]) < 2e-4 * a[2]


def test_scores_by_brute_force(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(rows, ngram_lm.score(docs).collect())


def test_frequent_contexts_get_groups_of_their_own(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["the", "the", "the", f"w{r.randrange(300)}"]) for _ in range(200))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = ngram_lm.train(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 7 <> 2"))
    assert len(model.hot) >= 1 and set(model.spans) == {c for c, _ in model.hot}
    check(rows, ngram_lm.score(docs).collect())


def test_odd_rows(spark):
    docs = odd_documents(spark)
    check([(r.doc_id, r.text) for r in docs.collect()], ngram_lm.score(docs).collect())
    assert ngram_lm.score(no_documents(spark)).count() == 0
    alone = spark.createDataFrame([(12, "only held out")], "doc_id long, text string") if zlib.crc32(b"12") % 7 == 2 else spark.createDataFrame([(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2), "only held out")], "doc_id long, text string")
    r = ngram_lm.score(alone).first()
    assert (r.held_out, r.train_tokens, r.n_known, r.base_score, r.score) == (True, 0, 0, 0.0, 0.0)


def test_held_out_text_is_likelier_than_by_unigrams(spark):
    got = [r for r in ngram_lm.score(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_a_lost_file_is_an_error(spark):
    """Not an empty group, which would change scores without a sign."""
    import glob
    import os

    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    model = ngram_lm.train(docs)
    folder = model.folder.removeprefix("file://")
    found = sorted(glob.glob(f"{folder}/pairs-*"))
    assert sum(model.has(g) for g in range(8 * len(model.written))) == len(found)
    texts = [r.text for r in docs.limit(20).collect()]
    whole = ngram_lm.Reader(model).score(texts)
    assert len(whole) == 20
    os.rename(found[0], f"{found[0]}-gone")
    with pytest.raises(FileNotFoundError):
        ngram_lm.Reader(model).score(texts)
