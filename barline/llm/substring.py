"""Substring dedup by hashing the sentences and lines of every text.

A unit is a line or, within a line, a sentence: texts are cut after each run of
line ends, and after the blanks that follow a full stop, an exclamation or a
question mark. A unit is normalised by lower-casing A-Z and joining its words
with single spaces. One of fewer than ``UNIT_WORDS`` words is hashed with those
that follow it, and the last ones with those before, until there are as many:
a word or two recur by chance. Units group by digest over all documents; the
occurrence of the lowest rank (doc_id, then position) is the first and stays.
Repeats go where a run of repeats without a gap has at least ``min_words``
words: a passage is found wherever it stands in a line, and sentences that
occur twice by chance stay. With ``extend`` a run grows word by word into what
stands beside it, as far as that agrees with what stands beside the first
occurrence of its longest unit, and the words of the whole stretch count: a
passage that starts or ends within a sentence, or ends with a short one, is
then cut whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import checkpoint, tune, with_cleared, written

#: Words that a run of repeated units has at least, to be removed.
MIN_WORDS = 50
#: Words that a hashed unit has at least, where its text has as many.
UNIT_WORDS = 8
#: Units of one partition among which repeats are told apart before the shuffle.
LOCAL_UNITS = 2_000_000
_WORDS = re.compile(r"[^ \t-\r]+")
_CUT = re.compile(r"\n\s*|(?<=[.!?])[^\S\n]+(?:\n\s*)?")


def units(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every unit with a word, in code points; separators belong to none."""
    if not text:
        return []
    out, at = [], 0
    for m in _CUT.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return [(s, e) for s, e in out if text[s:e].encode("utf-8", "surrogatepass").split()]


def normal(unit: str) -> bytes:
    return b" ".join(_bytes(unit).split())


def windows(words: list[int], least: int | None = None) -> list[tuple[int, int]]:
    """(first, last) of the units hashed together, given the words of each: from every unit the fewest that have ``least`` words, and the fewest last ones."""
    least = least or UNIT_WORDS
    out: list[tuple[int, int]] = []
    v, total = -1, 0
    for u, n in enumerate(words):
        while total < least and v < len(words) - 1:
            v += 1
            total += words[v]
        if total < least:
            while total < least and u > 0:
                u -= 1
                total += words[u]
            return out if out and (u, v) == out[-1] else [*out, (u, v)]
        out.append((u, v))
        total -= n
    return out


def row_key(key: str = "doc_id", text: str = "text") -> Column:
    """Tells rows apart; rows equal in id and text count as one document."""
    return F.xxhash64(F.col(key).cast("long"), F.col(text))


def _occurrences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(digest, rank, row, at, words, before, after, row0, at0, first): hashed units; ``first`` is false where the partition holds a lower rank of the digest.

    ``at``: words before it in its text; ``before``: words of the unit before
    it, ``after``: those of the hashed unit that starts behind it; (row0, at0)
    is the partition's lowest. Only the lowest of each partition can be the
    first of all, so a digest's rows in the later shuffle are at most the
    partitions, however frequent it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[np.ndarray]] = []
        held = 0
        for b in batches:
            ids, rows = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            dig: list[int] = []
            owner: list[int] = []
            rest: list[tuple[int, int, int, int]] = []
            for i, t in enumerate(b.column(2).to_pylist()):
                plain = [normal(t[s:e]) for s, e in units(t)]
                size = [x.count(b" ") + 1 for x in plain]
                at = [0, *accumulate(size)]
                pairs = windows(size)
                end = dict(pairs)  # of the last units, which start none, the end is the text's
                for u, v in pairs:
                    dig.append(xxhash.xxh3_64_intdigest(b" ".join(plain[u : v + 1])))
                    behind = at[end.get(v + 1, len(size) - 1) + 1] - at[v + 1] if v + 1 < len(size) else 0
                    rest.append((at[u], at[v + 1] - at[u], size[u - 1] if u else 0, behind))
                owner += [i] * len(pairs)
            if dig:
                own = np.array(owner)
                got.append([np.array(dig, dtype=np.uint64), ids[own], rows[own], *np.array(rest, dtype=np.int32).T])
                held += len(dig)
            if held >= LOCAL_UNITS:
                yield from told(got)
                got, held = [], 0
        if got:
            yield from told(got)

    def told(got: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        dig, ids, rows, at, num, before, after = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((at, rows, ids, dig))
        first = np.r_[True, dig[order][1:] != dig[order][:-1]]
        lead = order[np.flatnonzero(first)[np.cumsum(first) - 1]]  # the partition's first of each digest
        keep = first | (rows[order] != rows[lead]) | (at[order] != at[lead])  # a repeated row's copy of it is the same one
        order, lead, first = order[keep], lead[keep], first[keep]
        cols = [x[order] for x in (dig.view(np.int64), ids, rows, at, num, before, after)] + [rows[lead], at[lead], first]
        for i in range(0, len(order), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in cols], names=["digest", "rank", "row", "at", "words", "before", "after", "row0", "at0", "first"])

    source = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("rank"), row_key(key, text).alias("row"), F.col(text).alias("text"))
    return source.mapInArrow(run, "digest long, rank long, row long, at int, words int, before int, after int, row0 long, at0 int, first boolean")


def _runs(docs: DataFrame, key: str, text: str, min_words: int, extend: bool) -> DataFrame:
    """(row, a, b, head, tail): runs of repeats, from word a up to b, that have ``min_words`` words, with ``extend`` counting those beside them.

    ``head`` and ``tail``: the word (row0, at0) where an earlier occurrence of the run starts and where it has ended, and the
    words ``near`` it in this row outwards. The occurrence is the first of the run's longest unit: a short
    sentence is often found first in another passage.
    """
    tune(docs.sparkSession)
    seen = written(_occurrences(docs, key, text), "units")
    # equal ranks are copies of one unit in repeated rows: none of them is a repeat of another
    order = Window.partitionBy("digest").orderBy("rank", "row", "at")
    lead = F.first(F.struct("row", "at")).over(order)
    across = seen.where("first").withColumns({"nth": F.rank().over(order), "lead": lead}).where("nth > 1")
    kept = ["row", "at", "words", "before", "after"]
    again = across.select(*kept, "lead.row", "lead.at").toDF(*kept, "row0", "at0").unionAll(seen.where("not first").select(*kept, "row0", "at0"))
    # repeated rows yield a repeat twice, and two may start at one word; one exchange by row serves this and the steps below
    again = again.repartition("row").groupBy("row", "at").agg(F.max("words").alias("words"), F.max("before").alias("before"), F.max_by("after", "words").alias("after"), F.max(F.struct("words", "row0", "at0")).alias("of"))
    ordered = Window.partitionBy("row").orderBy("at")
    gap = F.col("at") > F.max(F.col("at") + F.col("words")).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(gap.cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    longest = F.max_by(F.struct("of.row0", "of.at0", "at"), F.struct("words", -F.col("at")))
    runs = again.withColumn("island", F.coalesce(island, F.lit(0))).groupBy("row", "island").agg(
        F.min("at").alias("a"), F.max(F.col("at") + F.col("words")).alias("b"), F.min_by("before", "at").alias("before"), F.max_by("after", F.col("at") + F.col("words")).alias("after"), longest.alias("of")
    )
    if not extend:
        return runs.where(F.col("b") - F.col("a") >= min_words).select("row", "a", "b")
    runs = runs.where(F.col("b") - F.col("a") + F.col("before") + F.col("after") >= min_words).select("*", "of.*").drop("of")
    # a partition's first occurrence leads on to the first of all
    leads = across.select(F.col("row").alias("row0"), F.col("at").alias("at0"), F.col("words"), F.col("lead.row").alias("lead_row"), F.col("lead.at").alias("lead_at"))
    leads = leads.groupBy("row0", "at0").agg(F.max_by(F.struct("lead_row", "lead_at"), "words").alias("lead")).select("row0", "at0", "lead.*")
    runs = runs.join(leads, ["row0", "at0"], "left").withColumns({"row0": F.coalesce("lead_row", "row0"), "shift": F.coalesce("lead_at", "at0") - F.col("at")})
    end = lambda word, near: F.struct("row0", (F.col(word) + F.col("shift")).cast("int").alias("at0"), F.col(near).alias("near"))
    return runs.select("row", "a", "b", end("a", "before").alias("head"), end("b", "after").alias("tail"))


def _beside(tagged: DataFrame, runs: DataFrame, text: str) -> DataFrame:
    """(row, a, b, side, near, found): both ends of ``runs``, with the words beside the earlier occurrence there, as many as could agree."""
    ends = runs.select("row", "a", "b", F.lit(False).alias("side"), "head.*").unionAll(runs.select("row", "a", "b", F.lit(True), "tail.*"))
    asked = ends.where("near > 0").groupBy("row0", "at0", "side").agg(F.max("near").alias("near"))
    asked = asked.groupBy(F.col("row0").alias("__bl_row")).agg(F.collect_list(F.struct("at0", "side", "near")).alias("__bl_asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: list[list] = [[], [], [], []]
            for row, t, asks in zip(*(b.column(c).to_pylist() for c in ("__bl_row", text, "__bl_asked")), strict=True):
                words = [w for s, e in units(t) for w in _bytes(t[s:e]).split()]
                for x in asks:
                    k = max(x["at0"], 0)  # outside of it the earlier text has nothing that could agree
                    w = words[k : k + x["near"]] if x["side"] else words[max(k - x["near"], 0) : k]
                    for c, v in zip(got, (row, x["at0"], x["side"], b" ".join(w)), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(got, (pa.int64(), pa.int32(), pa.bool_(), pa.binary()), strict=True)], names=["row0", "at0", "side", "found"])

    # all columns of the rows, so that their exchange is the one of the last join
    found = tagged.join(asked, "__bl_row").mapInArrow(run, "row0 long, at0 int, side boolean, found binary")
    found = found.dropDuplicates(["row0", "at0", "side"])
    none = ends.where("near = 0").select("row", "a", "b", "side", "near", F.lit(None).cast("binary").alias("found"))
    return ends.where("near > 0").join(found, ["row0", "at0", "side"]).select(*none.columns).unionAll(none)


def _bytes(t: str) -> bytes:
    return t.encode("utf-8", "surrogatepass").lower()


def _spans(t: str, runs: list[dict], min_words: int) -> tuple[list[tuple[int, int]], int]:
    """The stretches to remove, in order and apart, and the whole units in them."""
    at = units(t)
    words = [[m.span() for m in _WORDS.finditer(t, *unit)] for unit in at]
    firsts = [0, *accumulate(map(len, words))]
    unit = {n: k for k, n in enumerate(firsts)}
    flat = [w for x in words for w in x]
    beside = {(r["a"], r["side"]): (r["found"] or b"").split()[slice(r["near"]) if r["side"] else slice(-r["near"], None)] for r in runs if r["near"]}
    out, k = [], 0
    for a, b in sorted({(r["a"], r["b"]) for r in runs}):
        s, e, left, right = at[unit[a]][0], at[unit[b] - 1][1], 0, 0
        for w in reversed(beside.get((a, False), [])):
            if _bytes(t[slice(*flat[a - left - 1])]) != w:
                break
            left += 1
            s = flat[a - left][0]
        for w in beside.get((a, True), []):
            if _bytes(t[slice(*flat[b + right])]) != w:
                break
            e = flat[b + right][1]
            right += 1
        if left + b - a + right < min_words:
            continue
        k += unit[b] - unit[a]
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out, k


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, extend: bool = True) -> DataFrame:
    """All rows and columns of ``docs``, the text without repeated passages, and what was removed.

    ``removed_spans``: array of (start, end), code points of the original text;
    ``removed_words``, ``removed_units``: long. A null text stays null and an
    empty one empty, with no spans. Ids rank ascending, a null id first;
    repeated rows (equal id and text) are one document, so neither is taken for
    a repeat of the other; different texts under one id rank by a hash of the
    text. ``extend``: runs grow word by word into the units at either end; the
    units counted are the whole ones. A text that consists of repeats alone becomes empty and its row
    stays. Input columns named as those added are replaced.
    """
    own = with_cleared(docs, "removed_spans", "removed_words", "removed_units", "__bl_row", "__bl_removed")
    tagged = own.withColumn("__bl_row", row_key(key, text))
    runs = _runs(own, key, text, min_words, extend)
    if extend:
        runs = _beside(tagged, checkpoint(runs), text)
    else:
        runs = runs.withColumns({"side": F.lit(False), "near": F.lit(0), "found": F.lit(None).cast("binary")})
    found = runs.groupBy(F.col("row").alias("__bl_row")).agg(F.collect_list(F.struct("a", "b", "side", "near", "found")).alias("__bl_removed"))
    joined = tagged.join(found, "__bl_row", "left")
    names = [c for c in own.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans, words, counts = [], [], [], []
            for t, runs in zip(b.column(text).to_pylist(), b.column("__bl_removed").to_pylist(), strict=True):
                cut, n, k = [], 0, 0
                if runs and t:
                    cut, k = _spans(t, runs, min_words)
                    n = sum(len(t[s:e].encode("utf-8", "surrogatepass").split()) for s, e in cut)
                    ends = [0, *[e for _, e in cut]]
                    t = "".join(t[e:s] for e, s in zip(ends, [*[s for s, _ in cut], len(t)], strict=True))
                texts.append(t)
                spans.append([{"start": s, "end": e} for s, e in cut])
                words.append(n)
                counts.append(k)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(texts, pa.string()), pa.array(spans, kind), pa.array(words, pa.int64()), pa.array(counts, pa.int64())], names=[*names, text, "removed_spans", "removed_words", "removed_units"])

    kinds = ", ".join(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in [*names, text])
    out = joined.mapInArrow(run, f"{kinds}, removed_spans array<struct<start:int,end:int>>, removed_words long, removed_units long")
    return out.select(*own.columns, "removed_spans", "removed_words", "removed_units")
