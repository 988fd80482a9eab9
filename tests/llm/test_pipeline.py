from __future__ import annotations

from collections import Counter

import corpus_pipeline
from barline.llm import quality_rules, simhash, substring
from tests.compare import DATA
from tests.llm.fixtures import no_labels, odd_documents
from tests.llm.test_near_duplicates import plain_copies
from tests.llm.test_quality import plain_statistics
from tests.llm.test_substring import brute as brute_repeats


def test_stages_by_brute_force(spark):
    """Every stage against plain Python on what the one before kept."""
    base = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    (_, rules), (_, near), (_, passages), (_, mix), (_, ids) = corpus_pipeline.STAGES

    kept = rules(spark, docs, base)
    stats = {i: plain_statistics(r.text) for i, r in rows.items()}
    want = {i for i, s in stats.items() if s[0] >= quality_rules.MIN_WORDS and 100 * s[4] <= quality_rules.REPEAT_PERCENT * s[0]}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns  # too few labels here for any cutoff

    one = near(spark, kept, base)
    comp = plain_copies({i: rows[i].text for i in want})
    want = {i for i, c in comp.items() if i == c}
    assert {r.doc_id for r in one.collect()} == want and one.columns == docs.columns

    cut = {r.doc_id: r for r in passages(spark, one, base).collect()}
    spans = brute_repeats([(i, rows[i].text) for i in sorted(want)], substring.MIN_WORDS, extend=True)
    for i, s in spans.items():
        assert cut[i].text == "".join(c for k, c in enumerate(rows[i].text) if not any(a <= k < b for a, b in s)) and cut[i].n_chars == (len(cut[i].text) if s else rows[i].n_chars)

    mixed = Counter(r.doc_id for r in mix(spark, passages(spark, one, base), base).collect())
    assert set(mixed) == want

    out = corpus_pipeline.run(spark, base).collect()
    assert Counter(r.doc_id for r in out) == mixed and all(len(r.tokens) == r.n_tokens for r in out)
    assert simhash.MAX_BITS == 3


def test_odd_rows_and_empty_tables(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns through the whole chain; no rows, no result."""
    for name, docs in (("odd", odd_documents(spark)), ("none", odd_documents(spark).limit(0))):
        base = str(tmp_path / name)
        docs.write.parquet(f"{base}/documents.parquet")
        no_labels(spark).write.parquet(f"{base}/labels.parquet")
        out = corpus_pipeline.run(spark, base)
        assert {"doc_id", "text", "tokens", "n_tokens"} <= set(out.columns)
        got = Counter(r.doc_id for r in out.collect())
        if name == "none":
            assert not got
        else:  # too short: 4 to 7; repetitive: 10, 13, 14; copies of 1: 2, and 3 unless it is over three bits away
            assert {1, 8, 9, None, 12} <= set(got) and not {2, 4, 5, 6, 7, 10, 13, 14} & set(got)
