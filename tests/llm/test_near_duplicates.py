from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from barline.llm import simhash
from barline.llm.components import components
from tests.compare import DATA
from tests.llm.fixtures import no_documents, odd_documents


def plain_fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute(rows: list[tuple[int, int]]) -> dict[int, int]:
    ids, fps = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    label = np.array(ids)
    while True:
        new = np.where(near, label[None, :], 2**62).min(axis=1)
        if (new == label).all():
            return dict(zip(ids, label.tolist(), strict=True))
        label = new


def test_fingerprints_and_components_by_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    got = simhash.near_duplicates(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(texts)
    assert {r.doc_id: r.fp % 2**64 for r in got} == {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {r.doc_id: r.component_id for r in got} == brute([(r.doc_id, r.fp % 2**64) for r in got])
    assert all(r.fingerprint == f"{r.fp % 2**64:016x}" for r in got)


def test_odd_rows(spark):
    got = simhash.near_duplicates(odd_documents(spark)).collect()
    assert len(got) == 16
    by = {r.doc_id: r for r in got}
    assert by[1].component_id == by[2].component_id == by[3].component_id == 1
    assert by[4].fp == by[5].fp == by[6].fp == 0 and by[6].component_id == 4
    assert [r.component_id for r in got if r.doc_id == 7] == [7, 7]
    assert simhash.near_duplicates(no_documents(spark)).count() == 0


def test_keep_one(spark):
    docs = odd_documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r._row for r in kept.select('_row').collect()} == {3}
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: -1 if x is None else x)
    assert ids == [None, 1, 4, 7, 8, 9, 10, 11, 12, 13, 14]


def plain_words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def plain_shingles(text: str | None) -> set[bytes]:
    words = plain_words(text)
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(texts: dict[int, str]) -> set[tuple[int, int]]:
    """All pairs of ids whose five-word shingles have Jaccard 0.8 or more; by way of shared shingles, none left out."""
    sets = {i: plain_shingles(t) for i, t in texts.items()}
    holders: dict[bytes, list[int]] = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    rare = {i: sorted(s, key=lambda x: (len(holders[x]), x))[: len(s) - -(-4 * len(s) // 5) + 1] for i, s in sets.items()}  # similar texts share one of these
    pairs = {(min(i, j), max(i, j)) for i, r in rare.items() for x in r for j in holders[x] if i != j}
    return {(i, j) for i, j in pairs if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}


def plain_copies(texts: dict[int, str | None]) -> dict[int, int]:
    """Components of near copies, every pair of texts compared."""
    ids = sorted(texts)
    sig = np.array([simhash.signature(texts[i]) for i in ids])
    x = np.bitwise_count(sig[:, None, :] ^ sig[None, :, :])
    near = (x[:, :, :4] <= simhash.MAX_BITS).any(axis=2) & (x[:, :, 4:].sum(axis=2) <= simhash.SKETCH_BUDGET)
    sets = [plain_shingles(texts[i]) for i in ids]
    label = np.arange(len(ids))
    links = [(a, b) for a, b in zip(*np.nonzero(near), strict=True) if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in ids:
        before = label.copy()
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if (before == label).all():
            break
    return {i: ids[label[k]] for k, i in enumerate(ids)}


def test_near_copies_by_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert got == plain_copies(texts)
    pairs = similar(texts)
    assert all(got[i] == got[j] for i, j in pairs if plain_words(texts[i]) == plain_words(texts[j]))
    other = [(i, j) for i, j in pairs if plain_words(texts[i]) != plain_words(texts[j])]
    assert len(other) > 10 and sum(got[i] == got[j] for i, j in other) >= 0.9 * len(other)
    apart = {i for i in texts if got[i] != i} - {i for p in pairs for i in p}
    assert not apart  # whoever goes has a copy


def test_near_copies_of_edited_texts(spark):
    """One word of 120 changed, thirty copies of each of twenty texts: nearly all go; texts that share half their words stay."""
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(20):
        base = [r.choice(vocabulary) for _ in range(120)]
        for _ in range(30):
            words = list(base)
            for k in r.sample(range(120), 1):
                words[k] = r.choice(vocabulary)
            rows.append(" ".join(words))
        rows.append(" ".join(base[:60] + [r.choice(vocabulary) for _ in range(60)]))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = {x.doc_id for x in simhash.keep_one(docs).collect()}
    assert {i for i in range(len(rows)) if i % 31 == 30} <= kept
    assert len(kept) - 20 <= 0.1 * 600


def edited(groups: int, variants: int, seed: int) -> dict[int, str]:
    """Variants of texts of 300 words with one to six words changed each: pairs lie on both sides of Jaccard 0.8, dozens in a bucket."""
    r = random.Random(seed)
    vocabulary, out = [f"w{i}" for i in range(3000)], []
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(300)]
        for _ in range(variants):
            words = list(base)
            for k in r.sample(range(300), r.randrange(1, 7)):
                words[k] = r.choice(vocabulary)
            out.append(" ".join(words))
    r.shuffle(out)
    return dict(enumerate(out))


def test_refused_pairs_hide_no_link(spark):
    """All pairs within three bits of a fingerprint and at Jaccard 0.8 are linked, also in blocks where many pairs are refused."""
    texts = edited(8, 40, 11)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert got == plain_copies(texts)


def test_second_pass_lists_no_pairs(spark):
    """Rows alike, each a part of its own, as after refusals: a forest for each of the eight keys, not the 44,850 pairs, and still one cluster."""
    rows = [(1 << (i % 3), i, 0, 0, 0, i, i) for i in range(300)]
    df = spark.createDataFrame(rows, "fp long, node long, s0 long, s1 long, s2 long, s3 long, part long")
    edges = simhash.links(df)
    assert edges.count() <= 8 * len(rows)
    assert {r.component for r in components(edges).collect()} == {0}
    assert simhash.links(df.withColumn("part", df.part * 0)).count() == 0


@pytest.mark.parametrize("blocks", [16, 3])
def test_blocks_of_a_cluster_lose_no_link(spark, monkeypatch, blocks):
    """Clusters cut into pairs of blocks give the same components."""
    monkeypatch.setattr(simhash, "EXACT_BLOCK", 7)
    monkeypatch.setattr(simhash, "EXACT_BLOCKS", blocks)
    texts = edited(4, 40, 17)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()} == plain_copies(texts)


@pytest.mark.parametrize("block", [1024, 40])
def test_dense_buckets_lose_no_link(spark, block):
    """Fingerprints that differ from one another in few of a dozen bits, in blocks of either size."""
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(4)]
    fps = {b ^ sum(1 << k for k in r.sample(range(q, 60, 5), r.randrange(0, 5))) for q, b in enumerate(base) for _ in range(200)} | {r.getrandbits(64) for _ in range(200)}
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f, i) for i, f in rows], "fp long, node long")
    edges = simhash.links(df, block)
    found = {x.node: x.component for x in components(edges).collect()}
    assert {i: found.get(i, i) for i, _ in rows} == brute(rows)
    assert edges.count() < 60 * len(rows)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(5, 5), (8, 9), (9, 8)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[k] for k in range(200, 260)} == {7} and got[9] == 8 and 5 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_keep_estimates_small(spark):
    """Spark's estimate of a table's size follows the rows, not the product over all joins before."""
    edges = [(i, i + 1) for i in range(300)]
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert int(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 10**9
    assert {r.component for r in found.collect()} == {0}
