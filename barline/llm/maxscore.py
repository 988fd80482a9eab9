"""Exact top-k inner products by MaxScore over shards of vectors.

The dimensions are the terms. In a shard a dimension's values lie between a
lowest and a highest one, so a query's weight on it adds at most |weight| times
that range to a floor all vectors share; impacts measured from the floor are
never negative, as MaxScore needs. Terms are ordered by that bound. The
essential ones are those without which a vector can't reach the current k-th
score: their columns are traversed for the whole shard. The others are probed
in blocks, for vectors that are still competitive. Shards are merged at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import checkpoint, tune

#: Vectors of a shard and queries of a block at most: what one task holds of either.
SHARD, QUERIES = 65_536, 16_384
PROBED = 8


def quantised(x: Column, scale: int) -> Column:
    """floor(scale * component) of every component as long; an error beyond its range."""
    whole = lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long")
    fits = lambda c: F.abs(F.lit(float(scale)) * c.cast("double")) < float(2**62)
    return F.transform(x, lambda c: F.when(fits(c), whole(c)).otherwise(F.raise_error(F.lit("a component is beyond 2^62")).cast("long")))


def _exact(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``shard_topk`` in Python's whole numbers, for a shard whose sums may pass 63 bits."""
    whole = vectors.astype(object)
    for qid, q in zip(query_ids.tolist(), queries.astype(object), strict=True):
        best = sorted((-int(s), i) for s, i in zip(whole @ q, ids.tolist(), strict=True) if i != qid)[:k]
        if any(not -(2**63) <= -s < 2**63 for s, _ in best):
            raise OverflowError("a score is beyond 64 bits")
        yield qid, np.array([i for _, i in best], dtype=np.int64), np.array([-s for s, _ in best], dtype=np.int64)


def shard_topk(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, vector ids, scores) of the k best of a shard for each query; ties to the smaller id."""
    order = np.argsort(ids)
    ids, vectors = ids[order], vectors[order]
    low, high = vectors.min(axis=0), vectors.max(axis=0)
    most = lambda x: max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    if 4 * most(vectors) * most(queries) * max(1, vectors.shape[1]) >= 2**62:
        yield from _exact(ids, vectors, query_ids, queries, k)
        return
    span = high - low
    up, down = np.ascontiguousarray((vectors - low).T), np.ascontiguousarray((high - vectors).T)
    n, dims = vectors.shape
    safe = max(1, int(span.max(initial=0))) * max(1, int(np.abs(queries).max(initial=0))) * max(1, dims) < 2**53
    if safe:  # whole numbers below 2^53 are exact in doubles, which multiply faster
        up, down = up.astype(np.float64), down.astype(np.float64)
    seed = np.linspace(0, n - 1, min(n, 4 * k + 60)).astype(np.int64)
    for qid, q in zip(query_ids.tolist(), queries, strict=True):
        weight = np.abs(q)
        bound = weight * span
        terms = np.argsort(-bound, kind="stable")
        left = np.r_[np.cumsum(bound[terms][::-1])[::-1], 0]  # bound of the terms from the i-th on
        floor = int((q * np.where(q >= 0, low, high)).sum())
        impact = lambda t, rows: (up if q[t] >= 0 else down)[t][rows] * weight[t]  # noqa: B023, E731
        own = ids != qid
        some = seed[own[seed]]
        theta = -1
        if len(some) >= k:
            start = (vectors[some] * q).sum(axis=1) - floor
            theta = int(np.partition(start, len(start) - k)[len(start) - k])
        essential = int(np.searchsorted(-left, -theta, side="left")) if theta > 0 else 0
        essential = min(max(essential, 1), dims)  # left[essential] < theta: the rest alone is not enough
        plus = terms[:essential][q[terms[:essential]] >= 0]
        minus = terms[:essential][q[terms[:essential]] < 0]
        part = weight[plus].astype(up.dtype) @ up[plus] + weight[minus].astype(up.dtype) @ down[minus]
        rows = np.flatnonzero(own & (part + left[essential] >= theta))
        part, at = part[rows], essential
        while at < dims and len(rows):
            for t in terms[at : at + PROBED]:
                part = part + impact(t, rows)
            at = min(at + PROBED, dims)
            if len(part) > k:
                theta = max(theta, int(np.partition(part, len(part) - k)[len(part) - k]))
            keep = part + left[at] >= theta
            rows, part = rows[keep], part[keep]
        best = np.lexsort((ids[rows], -part))[:k]
        yield qid, ids[rows[best]], part[best].astype(np.int64) + floor


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", column: str = "embedding", scale: int = 256, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best vectors, its own id left out; ties to the smaller vec_id.

    ``queries`` and ``vectors`` have an id and an array column. Scores are exact
    integer inner products of components floor(scale * x); a shorter vector
    counts as filled up with zeros. Rows without an id, null vectors and those
    with a null or non-finite component take no part. Vectors that repeat an id
    are candidates each, but for the id's own query; queries that repeat one
    count once, with the greatest of their vectors. Scores are exact at any
    size; components beyond 2^62 / scale and scores beyond 64 bits are errors.
    Fewer than k other vectors give as many rows; empty tables none.
    """
    spark = tune(vectors.sparkSession)

    def usable(df: DataFrame) -> DataFrame:
        c = F.col(column)
        odd = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return df.where(F.col(key).isNotNull() & c.isNotNull() & ~odd).select(F.col(key).cast("long").alias("id"), quantised(c, scale).alias("v"))

    found, asked = checkpoint(usable(vectors)), checkpoint(usable(queries).groupBy("id").agg(F.max("v").alias("v")))
    n, nq = found.count(), asked.count()
    # some shards for every task slot, but none above its limit
    width = min(shard, max(1024, -(-n // (2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    shards, blocks = max(1, -(-n // width)), max(1, -(-nq // block))
    dims = max(found.agg(F.max(F.size("v"))).first()[0] or 0, asked.agg(F.max(F.size("v"))).first()[0] or 0)
    spread = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = found.select(spread(shards).alias("shard"), every(blocks).alias("block"), "id", "v")
    right = asked.select(every(shards).alias("shard"), spread(blocks).alias("block"), "id", "v")

    def matrix(t: pa.Table) -> np.ndarray:
        v = t.column("v").combine_chunks()
        sizes = np.diff(v.offsets.to_numpy())
        flat = v.flatten().to_numpy(zero_copy_only=False)
        if (sizes == dims).all():
            return flat.reshape(-1, dims)
        out = np.zeros((len(sizes), dims), dtype=np.int64)
        out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes])] = flat
        return out

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(a) and len(b):
            ids, qids = (t.column("id").to_numpy() for t in (a, b))
            out = [(np.full(len(i), q), i, s) for q, i, s in shard_topk(ids, matrix(a), qids, matrix(b), k)]
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3
        return pa.table({"query_id": cols[0], "vec_id": cols[1], "score": cols[2].astype(np.int64)})

    got = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(run, "query_id long, vec_id long, score long")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return got.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
