"""Ranked lexical search by Fagin's threshold algorithm over shards of documents.

Texts are read once, into a compact forward index of the words that the queries
ask for; corpus statistics come from that index. Every task then takes shards
of it: a posting's impact is its whole-number contribution to a score, lists
are sorted by impact, and for each query the lists are read round robin. A
document met for the first time is scored in full by random access to the
forward index. What no document unmet can exceed is the sum of the impacts at
the depth reached; reading stops when that is strictly below the k-th score, so
that ties are settled by id. The k-th score goes on from a task's shard to the
next, and the tasks' best are merged at the end.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import TERMS, folded, map_arrow, tune, written

#: Pairs of query and word that are searched for together, and postings of a shard: what a task holds of either.
BLOCK, SHARD = 1_000_000, 2_000_000
#: First and greatest number of postings read from each list in a round.
STRIDE, MOST = 32, 1024
NO_ID = np.iinfo(np.int64).max


class Shard:
    """Documents with their words: a forward index, and lists by word in order of impact."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray):
        self.ids, self.terms, self.impacts = ids, terms, impacts
        self.starts = np.r_[0, np.cumsum(sizes)]
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        order = np.lexsort((-impacts, terms))
        self.list_docs, self.list_impacts = owner[order], impacts[order]
        self.lists = np.searchsorted(terms[order], np.arange((int(terms.max()) if len(terms) else -1) + 2))
        self.met = np.zeros(len(ids), dtype=bool)

    def scores(self, docs: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Full scores of documents, from the forward index; ``times``: how often the query has each word."""
        sizes = self.starts[docs + 1] - self.starts[docs]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[docs] - ends + sizes, sizes)
        return np.add.reduceat(self.impacts[at] * times[self.terms[at]], ends - sizes)

    def search(self, terms: list[int], times: np.ndarray, k: int, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The k best (-score, id) of ``best`` and this shard."""
        spans = [(int(self.lists[t]), int(self.lists[t + 1]), int(times[t])) for t in terms if t + 1 < len(self.lists)]
        spans = [(a, b, x) for a, b, x in spans if a < b and self.list_impacts[a] > 0]
        read, stride, touched = 0, STRIDE, []
        while spans:
            seen = np.concatenate([self.list_docs[a + read : min(b, a + read + stride)] for a, b, _ in spans])
            new = np.unique(seen[~self.met[seen]])
            if len(new):
                self.met[new] = True
                touched.append(new)
                score = self.scores(new, times)
                if len(best) == k:
                    keep = score >= -best[-1][0]
                    new, score = new[keep], score[keep]
                if len(score) > k:
                    keep = score >= np.partition(score, len(score) - k)[len(score) - k]
                    new, score = new[keep], score[keep]
                best = sorted([*best, *zip((-score).tolist(), self.ids[new].tolist(), strict=True)])[:k]
            read += stride
            stride = min(2 * stride, MOST)
            spans = [(a, b, x) for a, b, x in spans if a + read < b]
            unmet = sum(int(self.list_impacts[a + read]) * x for a, _, x in spans)
            if len(best) == k and unmet < -best[-1][0]:
                break
        for d in touched:
            self.met[d] = False
        return [x for x in best if x[0] < 0]


def _index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document: its words in all, and those of the vocabulary with their counts."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, sizes, terms, tfs = [], [0], [], []
        for text in b.column(1).to_pylist():
            words = folded(text or b"", TERMS)
            counts = Counter(words)
            held = sorted((vocabulary[w], counts[w]) for w in counts.keys() & vocabulary.keys())
            n.append(len(words))
            sizes.append(len(held))
            terms += [t for t, _ in held]
            tfs += [c for _, c in held]
        offsets = pa.array(np.cumsum(sizes), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (tfs, pa.int64()))]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return map_arrow(docs, "doc_id long, n long, terms array<int>, tfs array<long>", run)


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple[int | None, Counter]]]:
    """Queries as (id, words), as many together as have ``most`` words; the driver holds one such block."""
    block, size = [], 0
    for r in items.toLocalIterator():
        words = Counter(folded(bytes(r.text or b""), TERMS))
        block.append((r.item_id, words))
        size += len(words)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def _search_block(docs: DataFrame, block: list[tuple[int | None, Counter]], k: int, shard: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*(c for _, c in block))))}
    index = written(_index(docs, vocabulary), "lexical")
    held = index.where("n > 0")
    totals = held.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    n_docs, n_words = totals.docs, totals.words
    weights = np.zeros(len(vocabulary), dtype=np.int64)
    for r in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # the words of a block of queries
        weights[r.term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["count"] + 1)))
    asked = [([vocabulary[w] for w in c], list(c.values())) for _, c in block]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in asked]
        waiting: list[tuple[np.ndarray, ...]] = []

        def spend() -> None:
            ids, n, sizes, terms, tfs = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting.clear()
            m = np.repeat(75 + (25 * n * n_docs) // n_words, sizes)
            here = Shard(ids, sizes, terms, weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 12 * m)))
            times = np.zeros(len(weights), dtype=np.int64)
            for q, (words, often) in enumerate(asked):
                times[words] = often
                best[q] = here.search(words, times, k, best[q])
                times[words] = 0

        for b in batches:
            lists = b.column(2)
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            some = sizes > 0
            ids = b.column(0).fill_null(NO_ID).to_numpy()
            waiting.append((ids[some], b.column(1).to_numpy()[some], sizes[some], lists.flatten().to_numpy(), b.column(3).flatten().to_numpy()))
            if sum(len(w[3]) for w in waiting) >= shard:
                spend()
        if waiting:
            spend()
        rows = [(q, i, -s) for q, found in enumerate(best) for s, i in found]
        cols = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * 3
        yield pa.RecordBatch.from_arrays(cols, names=["query", "doc_id", "score"])

    got = held.where(F.size("terms") > 0).mapInArrow(run, "query long, doc_id long, score long")
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id"))
    top = got.withColumn("rank", nth).where(F.col("rank") <= k)
    names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], "query long, item_id long")
    return top.join(names, "query").select("item_id", "rank", F.when(F.col("doc_id") != int(NO_ID), F.col("doc_id")).alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest scores above 0 for each item, equal scores by id.

    ``items`` has item_id and text. A null text has no words: such an item has
    no rows, such a document counts in no statistic. Each row is an item or a
    document of its own, also where an id repeats; a null document id ranks
    last among equals. Words are runs of ASCII letters, digits and characters
    beyond ASCII, A-Z lower-cased. Empty tables give no rows. Items are
    searched for in blocks of ``block`` pairs of item and word: a block is
    what the driver and each task hold, and costs one pass over the texts.
    """
    tune(docs.sparkSession)
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    out = None
    for b in _blocks(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")), block):
        found = _search_block(own, b, k, shard)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
