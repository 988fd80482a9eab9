"""Many boosted-tree models fitted in one set of jobs.

A walk-forward backtest has a model for each date, a parameter search one for
each draw and fold; all see the same rows. Here they grow together, level by
level: a pass over the binned rows adds up gradients by (model, node, variable,
bin), the sums meet in one aggregate, the best cuts are chosen by windows over
it, and every model's tree is a level deeper. The number of jobs depends on
trees x depth, not on the number of models.

Gradients are of second order, with the regularised gain of gradient-boosted
trees: G_l^2 / (H_l + l) + G_r^2 / (H_r + l) - G^2 / (H + l), which must pass
``gamma``. They are summed as whole multiples of 2^-30, so that a sum, and with
it a tree, doesn't depend on how rows are partitioned. Rows that miss a value
go to the side where they gain more. A fitted model is rows of a flat table.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.session import kept as table_of, shared_folder

UNIT = 2.0**-30
#: Gains below this are none; trees between two written states; nodes of all models together.
LEAST_GAIN, KEPT, MOST_NODES = 1e-6, 5, 5_000_000
TABLE = "model_id string, tree int, node int, variable string, cut double, missing_left boolean, value double, gain double, cover double"


@dataclass(frozen=True)
class Spec:
    """A model to be fitted: its parameters, the rows that train it (``order`` below ``until``, ``fold`` another than its own), the places of the variables it may use, and its seed."""

    model_id: str
    trees: int = 10
    depth: int = 3
    eta: float = 0.3
    gamma: float = 0.0
    reg_lambda: float = 1.0
    min_child: float = 1.0
    columns: float = 1.0
    pos_weight: float = 1.0
    until: int | None = None
    fold: int | None = None
    seed: int = 1
    only: tuple[int, ...] | None = None

    def drawn(self, tree: int, n: int) -> list[int]:
        """Variables that a tree may use."""
        among = list(range(n)) if self.only is None else sorted(self.only)
        k = max(1, round(self.columns * len(among)))
        return sorted(random.Random(f"{self.seed}-{self.model_id}-{tree}").sample(among, k)) if k < len(among) else among


def quantile_cuts(rows: DataFrame, variables: list[str], bins: int = 32, exact: bool = False) -> dict[str, list[float]]:
    """Up to bins - 1 distinct cuts of each variable, at its quantiles: one aggregate, of which bins x variables numbers come back.

    ``exact`` interpolates between values and holds all distinct ones of a
    variable in a task; otherwise quantiles are approximate and the memory bounded.
    """
    shares = [i / bins for i in range(1, bins)]
    f = (lambda v: F.percentile(F.col(v).cast("double"), shares)) if exact else (lambda v: F.percentile_approx(F.col(v).cast("double"), shares, 10_000))
    got = rows.agg(*[f(v).alias(f"_{i}") for i, v in enumerate(variables)]).first()
    return {v: sorted(set(got[i] or [])) for i, v in enumerate(variables)}


class Forests:
    """Trees of several models as arrays over heap-numbered nodes: node n has children 2n and 2n + 1."""

    def __init__(self, specs: list[Spec]):
        self.specs = specs
        self.trees: list[list[Tree]] = [[] for _ in specs]

    def margins(self, bins: np.ndarray, before: np.ndarray, start: int) -> np.ndarray:
        """Margins (rows x models) after the trees from number ``start`` on."""
        out = before.copy()
        for m, trees in enumerate(self.trees):
            for t in trees[start:]:
                out[:, m] += t.value[t.leaves(bins)]
        return out


class Tree:
    def __init__(self, depth: int):
        n = 2 ** (depth + 1)
        self.depth = depth
        self.variable, self.bin, self.left = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, bool)
        self.value, self.gain, self.cover = np.zeros(n), np.zeros(n), np.zeros(n)
        self.open = {1}

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node each row ends in; bin 0 is a missing value."""
        node = np.ones(len(bins), dtype=np.int64)
        rows = np.arange(len(bins))
        for _ in range(self.depth):
            v = self.variable[node]
            if (v < 0).all():
                break
            x = bins[rows, np.maximum(v, 0)]
            right = np.where(x == 0, ~self.left[node], x > self.bin[node])
            node = np.where(v >= 0, 2 * node + right, node)
        return node


def gradients(margin: np.ndarray, y: np.ndarray, objective: str, pos_weight: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives in whole units."""
    if objective == "logistic":
        p = 1 / (1 + np.exp(-margin))
        w = np.where(y == 1, pos_weight, 1.0)
        g, h = (p - y) * w, np.maximum(p * (1 - p), 1e-16) * w
    else:
        g, h = margin - y, np.ones(len(y))
    return np.rint(g / UNIT).astype(np.int64), np.rint(h / UNIT).astype(np.int64)


def binned(rows: DataFrame, variables: list[str], cuts: dict[str, list[float]], extra: list[str]) -> DataFrame:
    """``extra`` and ``bins``: for each variable one more than the number of cuts below the value, 0 for a missing one."""
    arrays = [np.array(cuts[v]) for v in variables]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(variables))]
            codes = np.column_stack([np.where(np.isnan(x), 0, 1 + np.searchsorted(c, x, side="left")) for x, c in zip(cols, arrays, strict=True)]).astype(np.uint8)
            bins = pa.array([r.tobytes() for r in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(variables), b.num_columns)), bins], names=[*extra, "bins"])

    own = rows.select(*[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(variables)], *extra)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*extra).schema)
    return own.mapInArrow(run, f"{schema}, bins binary")


def _codes(column: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, n)


def _trains(s: Spec, order: np.ndarray, fold: np.ndarray) -> np.ndarray:
    ok = np.ones(len(order), bool) if s.until is None else order < s.until
    return ok if s.fold is None else ok & (fold != s.fold)


def _histograms(state: DataFrame, forests: Forests, growing: list[Tree], start: int, variables: int, objective: str, base: float, tree: int) -> DataFrame:
    """(model, node, variable, bin, g, h) of the growing trees' open nodes, summed over all rows."""
    specs = forests.specs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        for b in batches:
            bins = _codes(b.column(3), variables)
            y, order, fold = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            stored = b.column(4).to_pylist()
            before = np.frombuffer(b"".join(stored), np.float64).reshape(len(y), -1) if stored[0] else np.full((len(y), len(specs)), base)
            margin = forests.margins(bins, before, start)
            for m, (s, t) in enumerate(zip(specs, growing, strict=True)):
                use = np.flatnonzero(_trains(s, order, fold) & ~np.isnan(y))
                if not len(use) or not t.open:
                    continue
                node = t.leaves(bins[use])
                live = np.isin(node, list(t.open))
                use, node = use[live], node[live]
                g, h = gradients(margin[use, m], y[use], objective, s.pos_weight)
                for n in np.unique(node).tolist():
                    at = node == n
                    for v in s.drawn(tree, variables):
                        x = bins[use[at], v]
                        k = int(x.max()) + 1
                        both = np.zeros((256, 2), np.int64) if (m, n, v) not in sums else sums[m, n, v]
                        np.add.at(both[:k, 0], x, g[at])
                        np.add.at(both[:k, 1], x, h[at])
                        sums[m, n, v] = both
        rows = [(m, n, v, k, *both[k].tolist()) for (m, n, v), both in sums.items() for k in np.flatnonzero(both[:, 1]).tolist()]
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (pa.int32(),) * 4 + (pa.int64(),) * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["model", "node", "variable", "bin", "g", "h"])

    parts = state.mapInArrow(run, "model int, node int, variable int, bin int, g long, h long")
    return parts.groupBy("model", "node", "variable", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def best_splits(sums: DataFrame, params: DataFrame) -> DataFrame:
    """(model, node, g, h, variable, bin, missing_left, gain, g_left, h_left): the best cut of each node, NULL where none is allowed.

    ``sums``: (model, node, variable, bin, g, h) in doubles; ``params``: (model,
    gamma, reg_lambda, min_child). Of equal gains the first variable wins, then
    the lowest cut, then missing values to the right.
    """
    by = Window.partitionBy("model", "node", "variable")
    up = by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    present = F.col("bin") > 0
    cums = sums.join(F.broadcast(params), "model").select(  # a row for each model
        "*", F.sum("g").over(by).alias("all_g"), F.sum("h").over(by).alias("all_h"), F.sum(F.when(present, F.col("g")).otherwise(0.0)).over(up).alias("gl"), F.sum(F.when(present, F.col("h")).otherwise(0.0)).over(up).alias("hl"),
        F.coalesce(F.sum(F.when(~present, F.col("g"))).over(by), F.lit(0.0)).alias("gm"), F.coalesce(F.sum(F.when(~present, F.col("h"))).over(by), F.lit(0.0)).alias("hm"),
    )
    part = lambda g, h: F.coalesce(F.try_divide(g * g, h + F.col("reg_lambda")), F.lit(0.0))

    def option(left: bool):
        g, h = (F.col("gl") + F.col("gm"), F.col("hl") + F.col("hm")) if left else (F.col("gl"), F.col("hl"))
        ok = (h >= F.col("min_child")) & (F.col("all_h") - h >= F.col("min_child")) & present
        gain = part(g, h) + part(F.col("all_g") - g, F.col("all_h") - h) - part(F.col("all_g"), F.col("all_h"))
        return F.struct(F.when(ok & (gain > F.greatest(F.col("gamma"), F.lit(LEAST_GAIN))), gain).alias("gain"), (-F.col("variable")).alias("v"), (-F.col("bin")).alias("b"), F.lit(0 if left else 1).alias("r"), g.alias("g"), h.alias("h"))

    tried = cums.select("model", "node", "all_g", "all_h", F.explode(F.array(option(False), option(True))).alias("o"))
    best = tried.groupBy("model", "node").agg(F.max(F.struct("all_g", "all_h")).alias("t"), F.max(F.when(F.col("o.gain").isNotNull(), F.col("o"))).alias("o"))
    return best.select("model", "node", F.col("t.all_g").alias("g"), F.col("t.all_h").alias("h"), (-F.col("o.v")).alias("variable"), (-F.col("o.b")).alias("bin"), (F.col("o.r") == 0).alias("missing_left"), F.col("o.gain").alias("gain"), F.col("o.g").alias("g_left"), F.col("o.h").alias("h_left"))


def fit_many(rows: DataFrame, y: str, variables: list[str], specs: list[Spec], objective: str = "logistic", order: str | None = None, fold: str | None = None, cuts: dict[str, list[float]] | None = None, bins: int = 32, base: float = 0.0) -> DataFrame:
    """The fitted models as a flat table (model_id, tree, node, variable, cut, missing_left, value, gain, cover).

    ``order`` and ``fold`` are whole-number columns that the specs refer to.
    A value up to ``cut`` goes left, to node 2n; a leaf has a ``value`` and no
    variable. Rows without ``y`` train nothing; a model without rows is a leaf
    of 0. Rows are binned once and written; every ``KEPT`` trees the margins
    are written anew, which cuts the lineage. The models are held by the
    driver and by every task: at most ``MOST_NODES`` nodes, else an error.
    """
    spark = rows.sparkSession
    if not specs:
        return spark.createDataFrame([], TABLE)
    if sum(s.trees * 2 ** (s.depth + 1) for s in specs) > MOST_NODES:
        raise ValueError(f"more than {MOST_NODES} nodes: fit fewer models at a time")
    if bins > 255:
        raise ValueError("at most 255 bins")
    cuts = cuts or quantile_cuts(rows, variables, bins)
    number = lambda c: (F.lit(0) if c is None else F.col(c)).cast("long")
    own = rows.select(*variables, F.col(y).cast("double").alias("_y"), number(order).alias("_order"), number(fold).alias("_fold"))
    folder = shared_folder(spark, "boosting")
    binned(own, variables, cuts, ["_y", "_order", "_fold"]).withColumn("margins", F.lit(None).cast("binary")).write.parquet(f"{folder}/0")
    state, start, forests, n = spark.read.parquet(f"{folder}/0"), 0, Forests(specs), len(variables)
    params = spark.createDataFrame([(m, float(s.gamma), float(s.reg_lambda), float(s.min_child)) for m, s in enumerate(specs)], "model int, gamma double, reg_lambda double, min_child double")
    for tree in range(max(s.trees for s in specs)):
        growing = [Tree(s.depth) for s in specs]
        for s, t in zip(specs, growing, strict=True):
            t.open = {1} if tree < s.trees else set()
        for level in range(max(1, *(s.depth for s in specs))):
            sums = _histograms(state, forests, growing, start, n, objective, base, tree)
            real = sums.select("model", "node", "variable", "bin", (F.col("g") * UNIT).alias("g"), (F.col("h") * UNIT).alias("h"))
            opened: list[set[int]] = [set() for _ in specs]
            for r in best_splits(real, params).collect():  # a row for each open node
                s, t = specs[r.model], growing[r.model]
                sides = [(r.node, r.g, r.h)]
                if r.gain is not None and level < s.depth:
                    t.variable[r.node], t.bin[r.node], t.left[r.node], t.gain[r.node] = r.variable, r.bin, r.missing_left, r.gain
                    sides += [(2 * r.node, r.g_left, r.h_left), (2 * r.node + 1, r.g - r.g_left, r.h - r.h_left)]
                    if level + 1 < s.depth:
                        opened[r.model] |= {2 * r.node, 2 * r.node + 1}
                for n_, g, h in sides:
                    t.cover[n_], t.value[n_] = h, -g / (h + s.reg_lambda) * s.eta
            for t, o in zip(growing, opened, strict=True):
                t.open = o
            if not any(opened):
                break
        for m, (s, t) in enumerate(zip(specs, growing, strict=True)):
            if tree < s.trees:
                forests.trees[m].append(t)
        if (tree + 1) % KEPT == 0 and tree + 1 < max(s.trees for s in specs):
            _kept(state, forests, start, n, base).write.parquet(f"{folder}/{tree + 1}")
            state, start = spark.read.parquet(f"{folder}/{tree + 1}"), tree + 1
    return _table(spark, forests, variables, cuts)


def _kept(state: DataFrame, forests: Forests, start: int, variables: int, base: float) -> DataFrame:
    """The state with the margins of all trees so far."""
    models = len(forests.specs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stored = b.column(4).to_pylist()
            before = np.frombuffer(b"".join(stored), np.float64).reshape(len(stored), -1) if stored and stored[0] else np.full((b.num_rows, models), base)
            margin = forests.margins(_codes(b.column(3), variables), before, start)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array([r.tobytes() for r in margin], pa.binary())], names=b.schema.names)

    return state.mapInArrow(run, state.schema)


def _table(spark: SparkSession, forests: Forests, variables: list[str], cuts: dict[str, list[float]]) -> DataFrame:
    rows = []
    for s, trees in zip(forests.specs, forests.trees, strict=True):
        for i, t in enumerate(trees):
            nodes = [1]
            for n in nodes:
                v = int(t.variable[n])
                name = variables[v] if v >= 0 else None
                rows.append((s.model_id, i, n, name, cuts[name][int(t.bin[n]) - 1] if name and int(t.bin[n]) <= len(cuts[name]) else None, bool(t.left[n]) if name else None, None if name else float(t.value[n]), float(t.gain[n]) if name else None, float(t.cover[n])))
                nodes += [2 * n, 2 * n + 1] if name else []
    return spark.createDataFrame(rows, TABLE)


def predict(rows: DataFrame, table: DataFrame, variables: list[str], model: str = "model_id", objective: str = "logistic", base: float = 0.0, name: str = "pred") -> DataFrame:
    """``rows`` with the prediction of the model that each row names; NULL where there is no such model.

    The table is what every task holds; its size is bounded where it is fitted.
    """
    by_model: dict[str, list] = {}
    for r in table.collect():
        by_model.setdefault(r.model_id, []).append(r)
    forests, names = {m: _arrays(t, variables) for m, t in by_model.items()}, [*rows.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(variables))])
            ids = np.array(b.column(len(variables)).to_pylist(), dtype=object)
            out = np.full(len(x), np.nan)
            for m in set(ids.tolist()) & forests.keys():
                at = np.flatnonzero(ids == m)
                out[at] = base + _margin(forests[m], x[at])
            pred = 1 / (1 + np.exp(-out)) if objective == "logistic" else out
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(variables) + 1, b.num_columns)), pa.array(pred, pa.float64(), from_pandas=True)], names=names)

    own = rows.select(*[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(variables)], F.col(model).cast("string").alias("_model"), *rows.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return own.mapInArrow(run, f"{schema}, `{name}` double")


def _arrays(rows: Iterable, variables: list[str]) -> list[tuple[np.ndarray, ...]]:
    """By tree: variable (-1 for a leaf), cut (infinite where all present values go left), missing_left, value."""
    trees: dict[int, list] = {}
    for r in rows:
        trees.setdefault(r.tree, []).append(r)
    out = []
    for _, nodes in sorted(trees.items()):
        n = max(r.node for r in nodes) + 1
        v, cut, left, value = np.full(n, -1), np.full(n, np.inf), np.zeros(n, bool), np.zeros(n)
        for r in nodes:
            if r.variable is None:
                value[r.node] = r.value
            else:
                v[r.node], left[r.node] = variables.index(r.variable), r.missing_left
                cut[r.node] = np.inf if r.cut is None else r.cut
        out.append((v, cut, left, value))
    return out


def _margin(trees: list[tuple[np.ndarray, ...]], x: np.ndarray) -> np.ndarray:
    out, rows = np.zeros(len(x)), np.arange(len(x))
    for v, cut, left, value in trees:
        node = np.ones(len(x), dtype=np.int64)
        while (inner := v[node] >= 0).any():
            value_at = x[rows, np.maximum(v[node], 0)]
            right = np.where(np.isnan(value_at), ~left[node], value_at > cut[node])
            node = np.where(inner, 2 * node + right, node)
        out += value[node]
    return out


def importance(table: DataFrame) -> DataFrame:
    """(model_id, variable, gain, splits, importance): summed gains of a model's variables, and their share."""
    by = table.where("variable is not null").groupBy("model_id", "variable").agg(F.sum("gain").alias("gain"), F.count("*").alias("splits"))
    return by.withColumn("importance", F.try_divide("gain", F.sum("gain").over(Window.partitionBy("model_id"))))


def walk_forward_many(df: DataFrame, y: str, variables: list[str], cutoff: int, objective: str = "logistic", cuts: dict[str, list[float]] | None = None, min_train_rows: int = 0, **params) -> tuple[DataFrame, DataFrame]:
    """(predictions, models): for each date from the ``cutoff``-th on, rows scored by a model of earlier rows only; all dates in one set of jobs.

    Predictions are the rows of those dates with ``model_id``, the date, and
    ``pred``. With ``min_train_rows`` only tickers with more rows than that
    before the first predicted date train. Cuts lie at quantiles of all rows
    before that date. Too few dates, or none, give no rows.
    """
    spark = df.sparkSession
    rows = df.withColumn("_order", F.unix_date("date").cast("long")).withColumn("model_id", F.col("date").cast("string"))
    dates = sorted(r.date for r in df.select("date").distinct().where("date is not null").collect())[cutoff:]
    if not dates:
        return df.limit(0).withColumns({"model_id": F.lit(""), "pred": F.lit(0.0)}), spark.createDataFrame([], TABLE)
    train, early = rows.where(F.col(y).isNotNull()), F.col("date") < F.lit(dates[0])
    if min_train_rows:
        known = train.where(early).groupBy("ticker").count().where(F.col("count") > min_train_rows)
        train = train.join(known.select("ticker"), "ticker", "left_semi")
    day = lambda d: (d - d.replace(year=1970, month=1, day=1)).days
    specs = [Spec(str(d), until=day(d), **params) for d in dates]
    table = fit_many(train, y, variables, specs, objective, "_order", cuts=cuts or quantile_cuts(train.where(early), variables))
    return predict(rows.where(F.col("date") >= F.lit(dates[0])).drop("_order"), table, variables, objective=objective), table


def search_many(df: DataFrame, y: str, variables: list[str], space: dict[str, list], draws: int, folds: int = 3, key: list[str] | None = None, seed: int = 1, **fixed) -> DataFrame:
    """(draw, parameters, mean_f1, folds): a random search, all draws and folds fitted in one set of jobs, the best first.

    ``draws`` distinct points of the space, or all of a smaller one. A row's
    fold is by the hash of its ``key``. The F1 score of a fold is over its own
    rows, at a probability of one half; 0 where nothing is predicted right.
    """
    names = sorted(space)
    size = int(np.prod([len(space[k]) for k in names]))
    points = [dict(zip(names, p, strict=True)) for p in (_point(i, [space[k] for k in names]) for i in sorted(random.Random(seed).sample(range(size), min(draws, size))))]
    rows = df.where(F.col(y).isNotNull()).withColumn("_fold", F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in key or ["date", "ticker"]]), F.lit(folds)))
    rows = table_of(rows.select(*variables, y, "_fold"), "rows")  # read for the cuts, the bins and the scores
    specs = [Spec(f"{i}-{f}", fold=f, seed=seed, **{**fixed, **p}) for i, p in enumerate(points) for f in range(folds)]
    table = fit_many(rows, y, variables, specs, fold="_fold")
    counts = _confusion(rows, y, table, variables, len(points))
    f1 = counts.groupBy("draw", "fold").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))
    by_draw = f1.groupBy("draw").agg(F.avg("f1").alias("mean_f1"), F.count("*").alias("folds"))
    listed = df.sparkSession.createDataFrame([(i, *[float(p[k]) for k in names]) for i, p in enumerate(points)], "draw int, " + ", ".join(f"{k} double" for k in names))
    return listed.join(by_draw, "draw").orderBy(F.desc("mean_f1"), "draw")


def _point(i: int, values: list[list]) -> list:
    out = []
    for v in reversed(values):
        out.append(v[i % len(v)])
        i //= len(v)
    return out[::-1]


def _confusion(rows: DataFrame, y: str, table: DataFrame, variables: list[str], draws: int) -> DataFrame:
    """(draw, fold, tp, fp, fn) by task: every row scored by the models that didn't see its fold."""
    by_model: dict[str, list] = {}
    for r in table.collect():
        by_model.setdefault(r.model_id, []).append(r)
    forests = {m: _arrays(t, variables) for m, t in by_model.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(variables))])
            truth, fold = b.column(len(variables)).to_numpy(zero_copy_only=False) == 1, b.column(len(variables) + 1).to_numpy()
            for f in np.unique(fold).tolist():
                at = fold == f
                for d in range(draws):
                    said = _margin(forests[f"{d}-{f}"], x[at]) > 0
                    sums[d, f] = sums.get((d, f), 0) + np.array([(said & truth[at]).sum(), (said & ~truth[at]).sum(), (~said & truth[at]).sum()])
        out = [(d, f, *s.tolist()) for (d, f), s in sums.items()]
        cols = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32())] + [pa.array(c, pa.int64()) for c in cols[1:]], names=["draw", "fold", "tp", "fp", "fn"])

    own = rows.select(*[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(variables)], F.col(y).cast("double").alias("_y"), F.col("_fold").cast("long").alias("_fold"))
    return own.mapInArrow(run, "draw int, fold long, tp long, fp long, fn long")


def swap_prefixes(train: DataFrame, valid: DataFrame, y: str, variables: list[str], suffixes: dict[str, str], **params) -> DataFrame:
    """(place, variable, replacement, replaced, f1, f1_replaced): variables put to the test against another form of the same prefix.

    In turn, each ``prefix_suffix`` whose suffix has a counterpart and whose
    counterpart is a column is replaced by it, where a model with it in its
    place scores a higher F1 on the later rows; what was replaced stays so for
    the tests after it. Both models of a test grow together.
    """
    tested = []
    for v in variables:
        prefix, _, suffix = v.rpartition("_")
        if (other := f"{prefix}_{suffixes.get(suffix)}") in train.columns and other not in variables:
            tested.append((v, other))
    every = [*variables, *[o for _, o in tested]]
    train, valid = (table_of(x.select(*every, y), "rows") for x in (train, valid))  # read anew by each test
    cuts, chosen, rows = quantile_cuts(train, every), list(variables), []
    for i, (v, other) in enumerate(tested):
        trial = [other if c == v else c for c in chosen]
        specs = [Spec(k, only=tuple(every.index(c) for c in vs), **params) for k, vs in (("kept", chosen), ("swapped", trial))]
        table = fit_many(train, y, every, specs, cuts=cuts)
        both = valid.where(F.col(y).isNotNull()).withColumn("model_id", F.explode(F.array(F.lit("kept"), F.lit("swapped"))))
        said, true = F.col("pred") > 0.5, F.col(y) == 1
        c = predict(both, table, every).groupBy("model_id").agg(*[F.count(F.when(w, 1)).alias(k) for k, w in (("tp", said & true), ("fp", said & ~true), ("fn", ~said & true))])
        f1 = {r.model_id: 2 * r.tp / (2 * r.tp + r.fp + r.fn) if r.tp else 0.0 for r in c.collect()}
        kept, swapped = f1.get("kept", 0.0), f1.get("swapped", 0.0)
        chosen = trial if swapped > kept else chosen
        rows.append((i, v, other, swapped > kept, kept, swapped))
    return train.sparkSession.createDataFrame(rows, "place int, variable string, replacement string, replaced boolean, f1 double, f1_replaced double")
