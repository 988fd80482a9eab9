"""Source divergence audit: how far each source's use of words lies from its language's and from the other sources'.

Only words in at least ``least`` documents of a language count. A count-min
sketch of document frequencies is merged over all tasks first. It never
underestimates, so a word whose estimate is below ``least`` is impossible and
is dropped within the task that meets it, before anything is shuffled; the
others are counted exactly. Comparisons of sources are sparse: a word that
neither source has adds the same to every sum, one that a single source has
depends on its count alone, and only words that both have are joined.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import LETTERS, folded, tune, written

#: Rows of the sketch; its width grows with the documents between these bounds; cells of a block.
ROWS, NARROWEST, WIDEST, BLOCK = 3, 1 << 16, 1 << 23, 1 << 16
#: Words that a task counts before it passes them on.
HELD = 200_000


class Sketch:
    """A count-min sketch whose cells stop at ``least``: enough to tell which counts may reach it."""

    def __init__(self, width: int, least: int):
        self.width, self.least = width, least
        self.cells = np.zeros(ROWS * width, dtype=np.uint16)

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        for i in range(ROWS):
            cells = places(hashes, i, self.width)
            order = np.argsort(cells, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(cells[order]) > 0])
            at = cells[order][first]
            more = np.add.reduceat(np.minimum(counts, self.least)[order], first)
            self.cells[at] = np.minimum(self.cells[at] + more, self.least)

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        for i in range(0, len(self.cells), BLOCK):
            part = self.cells[i : i + BLOCK]
            if part.any():
                yield i // BLOCK, zlib.compress(part.tobytes(), 1)


def places(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    """Cells of a row: both halves of a 64-bit hash, combined; the width is a power of two."""
    low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32)
    return (row * width + ((low + np.uint64(row) * (high | np.uint64(1))) & np.uint64(width - 1))).astype(np.int64)


def hashed(lang: str, words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the words of a language."""
    head = lang.encode() + b"\0"
    return np.fromiter((xxhash.xxh3_64_intdigest(head + w) for w in words), dtype=np.uint64, count=len(words))


def _sketched(docs: DataFrame, width: int, least: int) -> np.ndarray:
    """Which cells of the merged sketch reach ``least``, as bits: rows x width / 8 bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen = Sketch(width, least), {}

        def spend() -> None:
            for lang, words in ((k, w) for k, w in seen.items() if w):
                sketch.add(hashed(lang, list(words)), np.fromiter(words.values(), np.int64, len(words)))
            seen.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(set(folded(text, LETTERS)))
                if sum(map(len, seen.values())) > HELD:
                    spend()
        spend()
        rows = list(sketch.blocks())
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.binary())], names=["block", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, np.ndarray] = {}
        for b in batches:
            for i, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(cells), np.uint16)
                whole[i] = np.minimum(whole[i] + part, least) if i in whole else part
        bits = [(i, np.packbits(c >= least).tobytes()) for i, c in whole.items()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in bits], pa.int32()), pa.array([c for _, c in bits], pa.binary())], names=["block", "bits"])

    parts = docs.mapInArrow(count, "block int, cells binary")
    out = np.zeros(ROWS * width // 8, dtype=np.uint8)
    for r in parts.repartition("block").mapInArrow(merge, "block int, bits binary").collect():  # rows x width bits
        out[r.block * BLOCK // 8 : r.block * BLOCK // 8 + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return out


def possible(bits: np.ndarray, hashes: np.ndarray, width: int) -> np.ndarray:
    """Which of the hashed words may have the frequency that the bits are for."""
    ok = np.ones(len(hashes), dtype=bool)
    for i in range(ROWS):
        at = places(hashes, i, width)
        ok &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return ok


def counted(docs: DataFrame, least: int, width: int) -> DataFrame:
    """(lang, term, source, count, lang_count) of the words in ``least`` documents of their language or more."""
    bits = _sketched(docs, width, least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: dict[tuple[str, str], Counter] = {}
        held: dict[tuple[str, str], Counter] = {}

        def spend() -> pa.RecordBatch:
            cols: list[list] = [[], [], [], [], []]
            for (lang, source), words in times.items():
                keys = list(words)
                kept = [keys[i] for i in np.flatnonzero(possible(bits, hashed(lang, keys), width)).tolist()]
                n = held[lang, source]
                for c, x in zip(cols, ([lang] * len(kept), [k.decode() for k in kept], [source] * len(kept), [words[k] for k in kept], [n[k] for k in kept]), strict=True):
                    c += x
            times.clear()
            held.clear()
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["lang", "term", "source", "count", "docs"])

        for b in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = folded(text, LETTERS)
                times.setdefault((lang, source), Counter()).update(words)
                held.setdefault((lang, source), Counter()).update(set(words))
                if sum(map(len, times.values())) > HELD:
                    yield spend()
        yield spend()

    parts = docs.mapInArrow(count, "lang string, term string, source string, count long, docs long")
    exact = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    word = Window.partitionBy("lang", "term")  # lies within the same exchange
    exact = exact.withColumns({"lang_docs": F.sum("docs").over(word), "lang_count": F.sum("count").over(word)})
    return exact.where(F.col("lang_docs") >= least).select("lang", "term", "source", "count", "lang_count")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)) in decimals, exact for any counts."""
    top = (count + 2).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    return F.call_function("div", top, F.greatest(total + 2 * terms, F.lit(1)).cast("decimal(20,0)")).cast("long") + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of shares, which are at most 10^9 + 1: squares fit in 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least: int = 10, top: int = 10, lang: str = "lang", source: str = "source", text: str = "text", width: int | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` compares a source with each other one of its language, part ``term`` names its most overused words.

    A null text, language or source counts as empty. A source without words has
    pairs, but no words to name; a language with a single source has no pairs.
    Repeated rows are documents each. Words are runs of ASCII letters and
    characters beyond ASCII, A-Z lower-cased. An empty table gives an empty
    result. ``width`` is the sketch's; by default it grows with the documents
    up to ``WIDEST``, beyond which more words pass the sketch and are dropped
    by their exact counts: results are the same at any width.
    """
    spark = tune(docs.sparkSession)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    named = docs.select(empty(lang).alias("lang"), empty(source).alias("source"))
    if width is None:
        width = min(max(1 << (8 * docs.count()).bit_length(), NARROWEST), WIDEST)
    words = written(counted(named_texts(docs, lang, source, text), least, width), "divergence")
    langs = words.select("lang", "term", "lang_count").distinct().groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_count").alias("lang_total"))
    sources = words.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    groups = written(
        named.distinct().join(langs, "lang", "left").join(sources, ["lang", "source"], "left")
        .select("lang", "source", zero("terms").alias("terms"), zero("lang_total").alias("lang_total"), zero("total").alias("total"))
        .withColumn("p0", share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))), "groups",
    )
    rated = words.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "count", "p0", share(F.col("count"), F.col("total"), F.col("terms")).alias("p"), share(F.col("lang_count"), F.col("lang_total"), F.col("terms")).alias("q")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    term = rated.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return _pairs(rated, groups).withColumn("rank", F.row_number().over(order)).unionByName(term)


def named_texts(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).cast("binary").alias("text"))


def _pairs(rated: DataFrame, groups: DataFrame) -> DataFrame:
    """Sums of gaps over all words, for each ordered pair of a language's sources.

    With a word's gap for two absent counts taken off every word, what is left
    of a word that one source has depends on its count and the other's zero
    share: those are summed by count. A word that both have gets what is still
    missing from a join by word, once for each unordered pair.
    """
    a, b = F.col, lambda c: F.col(f"{c}2")
    other = groups.select("lang", F.col("source").alias("source2"), F.col("p0").alias("p02"))
    nothing = gap(a("p0"), b("p0"))
    pairs = groups.join(other, "lang").where("source <> source2").select("lang", "source", "source2", (F.col("terms") * nothing).alias("value"))
    by_count = rated.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("n"))
    alone = by_count.join(other, "lang").where("source <> source2").select("lang", "source", "source2", (F.col("n") * (gap(a("p"), b("p0")) - nothing)).alias("value"))
    mine = rated.select("lang", "term", "source", "p", "p0")
    theirs = mine.toDF("lang", "term", "source2", "p2", "p02")
    both = gap(a("p"), b("p")) - gap(a("p"), b("p0")) - gap(a("p0"), b("p")) + nothing
    shared = mine.join(theirs, ["lang", "term"]).where("source < source2").select("lang", "source", "source2", both.alias("value")).groupBy("lang", "source", "source2").agg(F.sum("value").alias("value"))
    turned = lambda df: df.select("lang", F.col("source2").alias("source"), F.col("source").alias("source2"), "value")
    alone = alone.groupBy("lang", "source", "source2").agg(F.sum("value").alias("value"))
    parts = pairs
    for x in (alone, turned(alone), shared, turned(shared)):
        parts = parts.unionByName(x)
    return parts.groupBy("lang", "source", "source2").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), F.col("source2").alias("item"), "value")
