"""What each variable adds to a tree model's prediction: path-dependent Shapley values, in polynomial time.

A leaf's value is reached if every variable on its path sends the row that way.
For a variable that isn't known the row goes both ways, weighted by the cover
of the branches. So a leaf's part of the prediction, over subsets of known
variables, is a product of one factor for each distinct variable of its path:
1 or 0 where it is known, a share where it isn't. The Shapley weights of such a
product follow from the coefficients of a polynomial of the path's length, so
that no subset is ever listed. Rows are taken in batches, all of a batch at once
for each leaf.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.session import shared_folder


class Leaf:
    """A leaf's value and, for each distinct variable of its path, the splits to pass and the share that unknown values have."""

    def __init__(self, value: float, path: list[tuple[int, float, bool, bool, float]]):
        self.value = value
        self.variables = sorted({p[0] for p in path})
        self.splits = [[(cut, left, goes_left) for v, cut, left, goes_left, _ in path if v == u] for u in self.variables]
        self.shares = [math.prod(share for v, *_, share in path if v == u) for u in self.variables]

    def passes(self, x: np.ndarray) -> np.ndarray:
        """(rows x variables of the path): whether the row's value takes every branch towards the leaf."""
        out = np.ones((len(x), len(self.variables)))
        for j, (v, splits) in enumerate(zip(self.variables, self.splits, strict=True)):
            for cut, missing_left, goes_left in splits:
                left = np.where(np.isnan(x[:, v]), missing_left, x[:, v] <= cut)
                out[:, j] *= left if goes_left else ~left
        return out


def leaves(nodes: Iterable, variables: list[str]) -> list[Leaf]:
    """The leaves of a model's rows of a flat table (tree, node, variable, cut, missing_left, value, cover)."""
    trees: dict[int, dict[int, object]] = {}
    for r in nodes:
        trees.setdefault(r.tree, {})[r.node] = r
    out = []
    for _, at in sorted(trees.items()):
        stack = [(1, [])]
        while stack:
            n, path = stack.pop()
            r = at[n]
            if r.variable is None:
                out.append(Leaf(r.value, path))
                continue
            cut = math.inf if r.cut is None else r.cut
            total = at[2 * n].cover + at[2 * n + 1].cover
            for child, goes_left in ((2 * n, True), (2 * n + 1, False)):
                share = at[child].cover / total if total else 0.5
                stack.append((child, [*path, (variables.index(r.variable), cut, bool(r.missing_left), goes_left, share)]))
    return out


def shapley(found: list[Leaf], x: np.ndarray, n: int) -> tuple[float, np.ndarray]:
    """(expected margin, contributions of rows x variables)."""
    out, expected = np.zeros((len(x), n)), 0.0
    for leaf in found:
        d = len(leaf.variables)
        expected += leaf.value * math.prod(leaf.shares)
        if not d:
            continue
        known, shares = leaf.passes(x), np.array(leaf.shares)
        weights = [math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d) for s in range(d)]
        for j, v in enumerate(leaf.variables):
            coefficients = np.zeros((len(x), d))  # of the sizes of known subsets of the others
            coefficients[:, 0] = 1
            for i in range(d):
                if i != j:
                    coefficients[:, 1:] = coefficients[:, 1:] * shares[i] + coefficients[:, :-1] * known[:, i : i + 1]
                    coefficients[:, 0] *= shares[i]
            out[:, v] += leaf.value * (known[:, j] - shares[j]) * (coefficients @ weights)
    return expected, out


def explain(rows: DataFrame, table: DataFrame, variables: list[str], model: str = "model_id") -> DataFrame:
    """``rows`` with ``expected`` and ``contributions``, an array in the order of ``variables``; both add up to the row's margin.

    Each row is explained by the model it names; NULL where there is no such
    model. A table of models is bounded where it is fitted, and held by every task.
    """
    by_model: dict[str, list] = {}
    for r in table.collect():
        by_model.setdefault(r.model_id, []).append(r)
    found, n, names = {m: leaves(t, variables) for m, t in by_model.items()}, len(variables), [*rows.columns, "expected", "contributions"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(n)])
            ids = np.array(b.column(n).to_pylist(), dtype=object)
            expected, parts = np.full(len(x), np.nan), np.zeros((len(x), n))
            for m in set(ids.tolist()) & found.keys():
                at = np.flatnonzero(ids == m)
                expected[at], parts[at] = shapley(found[m], x[at], n)
            lists = [None if np.isnan(e) else p.tolist() for e, p in zip(expected, parts, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n + 1, b.num_columns)), pa.array(expected, pa.float64(), from_pandas=True), pa.array(lists, pa.list_(pa.float64()))], names=names)

    own = rows.select(*[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(variables)], F.col(model).cast("string").alias("_model"), *rows.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return own.mapInArrow(run, f"{schema}, expected double, contributions array<double>")


def contributions(explained: DataFrame, variables: list[str], keys: list[str]) -> DataFrame:
    """(keys, variable, contribution): long rows of the variables that contribute."""
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, variables)).alias("variable"), F.col("contributions").alias("contribution"))).alias("c")
    return explained.select(*keys, each).select(*keys, F.col("c.variable").alias("variable"), F.col("c.contribution").alias("contribution")).where("contribution <> 0")


def node_table(model, variables: list[str], model_id: str = "m") -> DataFrame:
    """A fitted forest or boosted ensemble of pyspark.ml as a flat table, from the node data that it saves.

    Trees are weighted as the ensemble weights them: a forest's are averaged.
    Splits must be continuous; values up to the threshold go left, and there
    are no missing ones.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    path = f"{shared_folder(spark, 'model')}/model"
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    nodes: dict[int, dict[int, object]] = {}
    for r in data.select("treeID", "nodeData.*").collect():  # as large as the model
        nodes.setdefault(r.treeID, {})[r.id] = r
    weights = list(model.treeWeights)
    scale = 1 / sum(weights) if "RandomForest" in type(model).__name__ else 1.0
    rows = []
    for tree, at in sorted(nodes.items()):
        stack = [(0, 1)]
        while stack:
            i, n = stack.pop()
            r = at[i]
            if r.leftChild < 0:
                rows.append((model_id, tree, n, None, None, None, float(r.prediction) * weights[tree] * scale, None, float(r.rawCount)))
                continue
            if r.split.numCategories != -1:
                raise ValueError("categorical splits are not supported")
            rows.append((model_id, tree, n, variables[r.split.featureIndex], float(r.split.leftCategoriesOrThreshold[0]), True, None, float(r.gain), float(r.rawCount)))
            stack += [(r.leftChild, 2 * n), (r.rightChild, 2 * n + 1)]
    return spark.createDataFrame(rows, "model_id string, tree int, node long, variable string, cut double, missing_left boolean, value double, gain double, cover double")
