from __future__ import annotations

import pytest

from barline.llm import common
from barline.llm import substring as sub
from tests.compare import DATA
from tests.llm.fixtures import DOCS, no_documents, odd_documents, prose


SPACE = " \t\n\v\f\r"


def plain_units(text: str) -> list[tuple[int, int]]:
    """Character by character: a unit ends before a line end, or after a full stop, question or exclamation mark with a blank behind it."""
    out, start, k = [], 0, 0
    while k < len(text):
        stop = k > 0 and text[k - 1] in ".!?" and text[k].isspace() and text[k] != "\n"
        if text[k] == "\n" or stop:
            out.append((start, k))
            while k < len(text) and text[k].isspace():
                k += 1
            start = k
        else:
            k += 1
    out.append((start, len(text)))
    return [(s, e) for s, e in out if text[s:e].strip(SPACE)]


def plain_words(text: str) -> list[tuple[str, int, int]]:
    """(word with A-Z lower-cased, start, end)."""
    out, start = [], None
    for k, c in enumerate(text + " "):
        if c in SPACE:
            if start is not None:
                out.append(("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text[start:k]), start, k))
            start = None
        elif start is None:
            start = k
    return out


def plain_windows(sizes: list[int]) -> set[tuple[int, int]]:
    """All (first, last) units of at least eight words that are the fewest from their first unit, and the fewest up to the last one; else the whole text."""
    n = len(sizes)
    enough = [(u, v) for u in range(n) for v in range(u, n) if sum(sizes[u : v + 1]) >= 8 and sum(sizes[u:v]) < 8]
    last = [u for u in range(n) if sum(sizes[u:]) >= 8]
    return {*enough, (max(last), n - 1)} if last else {(0, n - 1)} if n else set()


def brute(rows: list[tuple[int, str]], least: int, extend: bool = False) -> dict[int, list[tuple[int, int]]]:
    """The spans to go, by whole texts in memory; ids differ."""
    first: dict[tuple[str, ...], tuple[int, int]] = {}
    held = {}
    for i, t in sorted(rows):
        units = plain_units(t or "")
        words = [[(w, s + x, s + y) for w, x, y in plain_words(t[s:e])] for s, e in units]
        flat, at = [w for x in words for w in x], [sum(map(len, words[:u])) for u in range(len(units) + 1)]
        pairs = sorted(plain_windows([len(x) for x in words]))
        for u, v in pairs:
            first.setdefault(tuple(w for w, _, _ in flat[at[u] : at[v + 1]]), (i, at[u]))
        held[i] = units, flat, at, pairs
    out = {}
    for i, (units, flat, at, pairs) in held.items():
        place = lambda u, v: first[tuple(w for w, _, _ in flat[at[u] : at[v + 1]])]  # noqa: B023, E731
        again, spans = [(u, v) for u, v in pairs if place(u, v) != (i, at[u])], []
        gone = {k for u, v in again for k in range(u, v + 1)}
        for x in sorted(k for k in gone if k - 1 not in gone or not any(u < k <= v or v == k - 1 for u, v in again)):
            y = x
            while y + 1 in gone:
                y += 1
            a, b, start, end = at[x], at[y + 1], units[x][0], units[y][1]
            u, v = max((p for p in again if x <= p[0] <= y), key=lambda p: (at[p[1] + 1] - at[p[0]], -p[0]))
            (j, k), n = place(u, v), b - a
            if extend:
                theirs, shift = [w for w, _, _ in held[j][1]], k - at[u]
                for m in range(a - 1, at[x - 1] - 1 if x else a - 1, -1):
                    if not 0 <= m + shift < len(theirs) or flat[m][0] != theirs[m + shift]:
                        break
                    start, n = flat[m][1], n + 1
                behind = [q for p, q in pairs if p == y + 1 and at[q + 1] - at[p] >= 8]
                for m in range(b, at[min(behind, default=len(units) - 1) + 1]):
                    if not 0 <= m + shift < len(theirs) or flat[m][0] != theirs[m + shift]:
                        break
                    end, n = flat[m][2], n + 1
            if n >= least:
                if spans and start <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
                else:
                    spans.append((start, end))
        out[i] = spans
    return out


def test_units_keep_offsets():
    t = "  One two.  Three four!\n\nFive. six 3.5 seven\n"
    assert [t[s:e] for s, e in sub.units(t)] == ["  One two.", "Three four!", "Five.", "six 3.5 seven"]
    assert sub.normal("One  TWO.") == sub.normal(" one two. ") and sub.normal("É") != sub.normal("é")


@pytest.mark.parametrize(("size", "extend"), [("sf0.001", False), ("sf0.001", True), ("sf0.01", True)])
def test_removed_spans_by_brute_force(spark, size, extend):
    docs = spark.read.parquet(f"{DATA}/{size}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sub.deduplicate(docs, extend=extend).collect()
    want = brute(rows, sub.MIN_WORDS, extend)
    assert {r.doc_id: [(x.start, x.end) for x in r.removed_spans] for r in got} == want
    assert sum(map(bool, want.values())) > 10
    texts = dict(rows)
    for r in got:
        spans = want[r.doc_id]
        assert r.text == "".join(c for k, c in enumerate(texts[r.doc_id]) if not any(s <= k < e for s, e in spans))


def test_units_hashed_together():
    assert sub.windows([9, 3, 6, 2, 1]) == [(0, 0), (1, 2), (2, 3), (2, 4)] and sub.windows([2, 1]) == [(0, 1)] and sub.windows([]) == []
    for sizes in ([1] * 20, [8, 8], [3, 9, 1, 1, 9, 2], [7, 1, 7, 1], [12], [5, 2]):
        assert set(sub.windows(sizes)) == plain_windows(sizes) and len(set(sub.windows(sizes))) == len(sub.windows(sizes))


def test_words_that_recur_by_chance_stay(spark):
    """Two hundred sentences of one or two words, each of which stands in other texts as well, but not beside the same ones."""
    from random import Random

    lots = [[f"{a}!" for a in Random(i).sample([f"w{k}" for k in range(250)], 200)] for i in range(6)]
    docs = spark.createDataFrame([(i, " ".join(x), "en", "s", 0) for i, x in enumerate(lots)], DOCS)
    for extend in (False, True):
        assert all(r.removed_words == 0 for r in sub.deduplicate(docs, extend=extend).collect())


def test_small_partitions_and_buffers_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    for extend in (False, True):
        one = {r.doc_id: r.removed_spans for r in sub.deduplicate(docs, extend=extend).collect()}
        assert one == {r.doc_id: r.removed_spans for r in sub.deduplicate(docs.repartition(13), extend=extend).collect()}
        with monkeypatch.context() as m:
            m.setattr(sub, "LOCAL_UNITS", 7)
            m.setattr(common, "BATCH_ROWS", 20)
            assert one == {r.doc_id: r.removed_spans for r in sub.deduplicate(docs, extend=extend).collect()}


def test_short_sentences_do_not_hide_a_passage(spark):
    """The passage starts with a sentence that stands earlier elsewhere; all of it is still compared with its own first place."""
    passage = "Of. With. " + " ".join(f"w{i}" for i in range(30)) + ". " + " ".join(f"v{i}" for i in range(25))
    rows = [(0, "Of. It. With. As."), *[(i, f"Begin a{i} b{i}. c{i} {passage} d{i} e{i}. End {i}.") for i in (1, 2, 3)]]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    got = {r.doc_id: r.text for r in sub.deduplicate(docs, extend=True).collect()}
    assert got == {i: t if i < 2 else t.replace(passage, "") for i, t in rows}


def test_passages_of_a_benchmark_go(spark):
    """Every later occurrence of a benchmark passage of over 50 words, wherever it stands in a text."""
    base, n = f"{DATA}/sf0.1", 0
    docs = spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text")
    long = [r.text for r in spark.read.parquet(f"{base}/benchmark.parquet").collect() if len(r.text.split()) > 50]
    got = {r.doc_id: r.removed_spans for r in sub.deduplicate(docs, extend=True).select("doc_id", "removed_spans").collect()}
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    for p in long:
        for i, k in [(i, t.index(p)) for i, t in texts if p in t][1:]:
            assert any(x.start <= k and k + len(p) <= x.end for x in got[i])
            n += 1
    assert n > 10


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = {r.doc_id: r for r in sub.deduplicate(docs).collect()}
    assert got[1].removed_units == 0 and got[2].text == "" and got[2].removed_words == 300
    assert got[4].text is None and got[5].text == "" and got[7].text == "One two"
    assert got[8].removed_units == 0 and got[9].removed_words == 70 and len(got[9].removed_spans) == 1
    out = sub.deduplicate(docs)
    assert out.columns == [c for c in docs.columns if c != "removed_units"] + ["removed_spans", "removed_words", "removed_units"]
    assert out.count() == 16 and sub.deduplicate(no_documents(spark)).count() == 0


def test_repeated_rows_keep_their_text(spark):
    a, b = prose(150, 21) + ".", prose(120, 22) + "."
    rows = [(1, a), (1, a), (2, b), (2, b), (3, a + "\n" + b), (3, a + "\n" + b), (None, b + "\n" + b), (None, b + "\n" + b)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    for parts in (1, 5):
        got = [(r.doc_id, r.text.strip()) for r in sub.deduplicate(docs.repartition(parts)).collect()]
        assert sorted(got, key=str) == sorted([(1, a), (1, a), (2, ""), (2, ""), (3, ""), (3, ""), (None, b), (None, b)], key=str)


def test_passages_within_sentences_are_cut_whole(spark):
    """A passage of 52 words planted after and before words without a full stop goes but for its first place; one of 40 stays."""
    words = [f"w{i}" for i in range(52)]
    passage = " ".join(w + ("." if i % 13 == 12 and i < 51 else "") for i, w in enumerate(words))
    short = " ".join(f"v{i}" + ("." if i % 10 == 4 else "") for i in range(40))
    rows = [(i, f"Start a{i} {passage} b{i} goes on {i}.\nLast c{i} {short} d{i} line") for i in range(6)]
    rows += [(9, f"Begin 9\n{passage}\nEnd 9 it."), (9, f"Begin 9\n{passage}\nEnd 9 it.")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    for parts in (1, 5):
        got = sub.deduplicate(docs.repartition(parts), extend=True).collect()
        assert sorted((r.doc_id, r.text) for r in got) == sorted((i, t.replace(passage, "") if i else t) for i, t in rows)
        assert {r.removed_words for r in got} == {0, 52}
    from barline.llm.queries import op2_substring_dedup

    out = {(r.doc_id, r.removed_words) for r in _query(spark, docs, op2_substring_dedup)}
    assert out == {(0, 0), *((i, 52) for i in range(1, 6)), (9, 52)}


def _query(spark, docs, query):
    import tempfile

    base = tempfile.mkdtemp(prefix="spark-")
    docs.write.parquet(f"{base}/documents.parquet")
    return query(spark, base).collect()
