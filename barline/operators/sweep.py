"""Portfolios of very many variable combinations, by a threshold rule over rank lists.

Per date there is one matrix of ranks. A combination's score of a name is the
mean of its ranks, so lists sorted by rank can be read from the top for many
combinations at once: names met are scored in full, a name not met is at best
as good as the ranks at the depth reached. Once the n-th best lies strictly
below that bound, no more is read (Fagin's threshold rule). A combination and
date send n names on, however many there are; ranks are whole numbers (twice
the mean rank), so ties are exact and go to the smaller ticker.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.operators.portfolio import chained_returns

#: Names of a date in one task, combinations taken together, and cells of a working array.
SHARD, TOGETHER, CELLS = 65_536, 2048, 4_000_000
NONE = np.iinfo(np.int64).max


def rank_panel(df: DataFrame, variables: list[str], keep: list[str], descending: bool = True, date: str = "date") -> DataFrame:
    """(date, ticker, keep, variables): twice the mean rank of each variable within its date, NULL for NULL.

    All ranks lie in one exchange; a rank and its ties share one sort. ``_shard``
    numbers runs of ``SHARD`` names of a date.
    """

    def doubled(v: str):
        w = Window.partitionBy(date).orderBy(F.desc_nulls_last(v) if descending else F.asc_nulls_last(v))
        peers = F.count("*").over(w.rangeBetween(Window.currentRow, Window.currentRow))
        return F.when(F.col(v).isNotNull(), 2 * F.rank().over(w) + peers - 1).cast("long").alias(v)

    shard = F.floor((F.row_number().over(Window.partitionBy(date).orderBy("ticker")) - 1) / SHARD).cast("int")
    return df.select(date, "ticker", *keep, *[doubled(v) for v in variables], shard.alias("_shard"))


class RankLists:
    """Ranks of a date's names, (names x variables) with -1 for a missing one, and the lists sorted by rank."""

    def __init__(self, ranks: np.ndarray):
        self.present = ranks >= 0
        self.ranks = np.where(self.present, ranks, 0)
        sortable = np.where(self.present, ranks, NONE)
        self.order = np.argsort(sortable, axis=0, kind="stable")
        self.sorted = np.take_along_axis(sortable, self.order, axis=0)

    def best(self, members: np.ndarray, n: int, most_missing: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(scores, names) of the n best of every combination, both (combinations x n); ``NONE`` where there are fewer.

        A score is the mean rank times the least common multiple of the
        numbers of ranks it may be a mean of, so that scores compare exactly.
        """
        k, size = members.shape[1], len(self.ranks)
        least = max(1, k - most_missing)
        self.scale = math.lcm(*range(least, k + 1))
        scores, names = np.full((len(members), n), NONE), np.zeros((len(members), n), np.int64)
        waiting, depth = np.arange(len(members)), min(size, 2 * n)
        while len(waiting):
            left = []
            step = max(1, CELLS // (depth * k))
            for i in range(0, len(waiting), step):
                some = waiting[i : i + step]
                key = self._met(members[some], depth, n, least)
                scores[some], names[some] = np.where(key == NONE, NONE, key // size), np.where(key == NONE, 0, key % size)
                if depth < size:
                    left.append(some[scores[some, n - 1] >= self._bound(members[some], depth, least)])
            waiting = np.concatenate(left) if left else waiting[:0]
            depth = min(size, 2 * depth)
        return scores, names

    def _met(self, members: np.ndarray, depth: int, n: int, least: int) -> np.ndarray:
        """score x names + name of the n best among those in the lists' first ``depth`` places, in order."""
        b, k = members.shape
        met = self.order[:depth][:, members].transpose(1, 0, 2).reshape(b, depth * k)
        total, count = np.zeros(met.shape, np.int64), np.zeros(met.shape, np.int64)
        for j in range(k):
            total += self.ranks[met, members[:, j : j + 1]]
            count += self.present[met, members[:, j : j + 1]]
        share = np.array([0] + [self.scale // c for c in range(1, k + 1)])
        key = np.where(count >= least, total * share[count] * len(self.ranks) + met, NONE)
        if key.shape[1] > k * n:  # a name is met k times at most
            key = np.partition(key, k * n - 1, axis=1)[:, : k * n]
        key.sort(axis=1)
        key[:, 1:][key[:, 1:] == key[:, :-1]] = NONE
        key.sort(axis=1)
        out = np.full((b, n), NONE)
        out[:, : min(n, key.shape[1])] = key[:, :n]
        return out

    def _bound(self, members: np.ndarray, depth: int, least: int) -> np.ndarray:
        """No name still to be met has a lower score: the mean of the ``least`` lowest ranks next in line."""
        following = np.sort(self.sorted[depth][members], axis=1)[:, :least]
        end = (following == NONE).any(axis=1)
        return np.where(end, NONE, np.where(following == NONE, 0, following).sum(axis=1) * (self.scale // least))


def bounded_sweep(ranks: DataFrame, variables: list[str], combos: DataFrame, n: int, ret: str = "next_month_return", most_missing: int = 0) -> DataFrame:
    """(model_id, date, ret, _names): mean return and names of the n best of every combination and date.

    ``ranks``: a ``rank_panel``; ``combos``: (model_id, var_1..), a table of
    parameters that every task holds. A name takes part with at most
    ``most_missing`` ranks missing. A date's names are one task, or one for
    each ``SHARD`` of them; the n best of each meet again in one exchange by
    model, in which later windows by model lie too.
    """
    places = {v: i for i, v in enumerate(variables)}
    vars_ = [c for c in combos.columns if c.startswith("var_")]
    rows = combos.select("model_id", *vars_).collect()
    if not rows:
        return ranks.sparkSession.createDataFrame([], f"model_id string, date date, {ret} double, _names array<string>")
    ids, members = [r.model_id for r in rows], np.array([[places[r[v]] for v in vars_] for r in rows])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("ticker").combine_chunks()
        lists = RankLists(np.column_stack([t.column(v).fill_null(-1).to_numpy() for v in variables]))
        for i in range(0, len(members), TOGETHER):
            score, name = lists.best(members[i : i + TOGETHER], n, most_missing)
            found = score != NONE
            sizes = found.sum(axis=1)
            some = sizes > 0
            at = pa.array(name[found])
            best = pa.StructArray.from_arrays([pa.array(score[found]), t.column("ticker").combine_chunks().take(at), t.column(ret).combine_chunks().cast(pa.float64()).take(at)], names=["score", "ticker", "ret"])
            held = [ids[i + j] for j in np.flatnonzero(some).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array([t.column("date")[0].as_py()] * len(held), pa.date32()), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes[some])], pa.int32()), best)], names=["model_id", "date", "best"])

    got = ranks.groupBy("date", "_shard").applyInArrow(choose, "model_id string, date date, best array<struct<score:long,ticker:string,ret:double>>")
    merged = got.repartition("model_id").groupBy("model_id", "date").agg(F.flatten(F.collect_list("best")).alias("b"))
    best = merged.withColumn("b", F.slice(F.sort_array("b"), 1, n))
    known = F.filter(F.col("b.ret"), lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known))
    return best.select("model_id", "date", F.coalesce(mean, F.lit(0.0)).alias(ret), F.col("b.ticker").alias("_names"))


def combo_sweep(df: DataFrame, variables: list[str], combos: DataFrame, n: int, cost: float, ret: str = "next_month_return", most_missing: int = 0, descending: bool = True) -> DataFrame:
    """Portfolio returns, turnover, costs and index of every combination: (model_id, date, ..), as ``portfolio.period_returns`` has them."""
    best = bounded_sweep(rank_panel(df, variables, [ret], descending), variables, combos, n, ret, most_missing)
    return chained_returns(best, cost, ["model_id"], ret)
