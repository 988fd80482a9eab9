"""Walk-forward models, parameter searches and variable selection on pyspark.ml."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import StorageLevel, inheritable_thread_target

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.operators.portfolio import sticky, top_n
from barline.operators.relational import sparse_rows_out

ESTIMATORS: dict[str, Callable] = {
    "gbt": lambda y, **p: GBTClassifier(labelCol=y, featuresCol="features", **p),
    "rf": lambda y, **p: RandomForestClassifier(labelCol=y, featuresCol="features", **p),
    "gbt_reg": lambda y, **p: GBTRegressor(labelCol=y, featuresCol="features", **p),
    "rf_reg": lambda y, **p: RandomForestRegressor(labelCol=y, featuresCol="features", **p),
}


def pipeline(algorithm: str, y: str, variables: list[str], **params) -> Pipeline:
    """Medians for missing values, one vector, and an estimator by name."""
    filled = [f"_{v}" for v in variables]
    return Pipeline(stages=[Imputer(inputCols=variables, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="features"), ESTIMATORS[algorithm](y, **params)])


def scored(model, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    if "probability" in out.columns:
        return out.withColumn("pred", vector_to_array("probability")[1])
    return out.withColumn("pred", F.col("prediction"))


def split_by_date(df: DataFrame, share: float = 0.8, date: str = "date") -> tuple[DataFrame, DataFrame]:
    """The first ``share`` of the distinct dates, and the rest, by semi-joins on the dates."""
    dates = df.select(date).distinct()
    cut = dates.agg(F.percentile(F.unix_date(date), share).alias("c")).select(F.date_from_unix_date(F.floor("c").cast("int")).alias("c"))
    early = dates.join(F.broadcast(cut), F.col(date) <= F.col("c"), "left_semi")  # one row
    return df.join(early, date, "left_semi"), df.join(early, date, "left_anti")


def walk_forward_predictions(df: DataFrame, y: str, variables: list[str], cutoff: int, algorithm: str = "gbt", last: int | None = None, drop_sparse: bool = False, min_train_rows: int = 0, parallelism: int = 4, **params) -> DataFrame:
    """(date, ticker, pred, next_month_return, mcap_pct_rank), the last two where there are such columns: for each date from the ``cutoff``-th on, predictions of a model fitted on earlier dates only.

    Fits depend on nothing but earlier rows, so ``parallelism`` dates are fitted
    at a time, each distributed, over rows that are kept once for all of them.
    Options: rows with too many missing variables go; training only on tickers
    with more than ``min_train_rows`` rows before the first predicted date
    (later ones never come in: a month's newcomers are dropped before the next
    one's are counted). ``last``: at most so many dates. Tables with too few
    dates, or none, give no rows.
    """
    rows = sparse_rows_out(df, variables) if drop_sparse else df
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    dates = [r.date for r in rows.select("date").distinct().orderBy("date").collect()]
    shown = ["date", "ticker", "pred", *[c for c in ("next_month_return", "mcap_pct_rank") if c in df.columns]]
    if len(dates) <= cutoff:
        return df.limit(0).withColumn("pred", F.lit(0.0)).select(*shown)
    train = rows.where(F.col(y).isNotNull())
    if min_train_rows:
        first = train.where(F.col("date") < F.lit(dates[cutoff])).groupBy("ticker").count()
        train = train.join(first.where(F.col("count") > min_train_rows), "ticker", "left_semi")

    def predicted(day) -> DataFrame:
        model = pipeline(algorithm, y, variables, **params).fit(train.where(F.col("date") < F.lit(day)))
        return scored(model, rows.where(F.col("date") == F.lit(day))).select(*shown)

    with ThreadPoolExecutor(parallelism) as pool:
        parts = list(pool.map(inheritable_thread_target(df.sparkSession)(predicted), dates[cutoff : None if last is None else cutoff + last]))
    return reduce(DataFrame.unionByName, parts)


def predicted_portfolio(pred: DataFrame, n: int = 50, threshold: float | None = None, held_pool: int | None = None, mcap_half: bool = False) -> DataFrame:
    """A portfolio a date of predictions: (date, ticker, pred, ..).

    Plain: the n best. With a threshold, or a pool to hold on within: n on the
    first date, after that n + 1, those held before first; a pool is the date's
    ``held_pool`` best, by default n + 1, and with a threshold all names at
    least at the smaller of it and the pool's last prediction. ``mcap_half``:
    out of the larger half by market cap only; models train on all rows.
    """
    if mcap_half:
        pred = pred.where("mcap_pct_rank <= 0.5")
    if threshold is None and held_pool is None:
        return top_n(pred, "pred", n, ["date"], "ticker", descending=True)
    return sticky(pred.withColumn("model_id", F.lit("")), n + 1, held_pool or n + 1, threshold, first=n).drop("model_id")


def walk_forward(df: DataFrame, y: str, variables: list[str], cutoff: int, n: int = 50, threshold: float | None = None, held_pool: int | None = None, mcap_half: bool = False, **options) -> DataFrame:
    """The portfolio of ``walk_forward_predictions``."""
    return predicted_portfolio(walk_forward_predictions(df, y, variables, cutoff, **options), n, threshold, held_pool, mcap_half)


def search(train: DataFrame, y: str, variables: list[str], algorithm: str, grid: dict[str, list], folds: int = 3, metric: str = "f1", draws: int | None = None, seed: int = 1) -> DataFrame:
    """(params, score) of a cross-validated grid, or of ``draws`` random points of it, best first."""
    import random

    pipe = pipeline(algorithm, y, variables)
    est = pipe.getStages()[-1]
    builder = ParamGridBuilder()
    for k, values in grid.items():
        builder = builder.addGrid(est.getParam(k), values)
    points = builder.build()
    if draws is not None and draws < len(points):
        points = random.Random(seed).sample(points, draws)
    train = train.persist(StorageLevel.MEMORY_AND_DISK)  # every fold and point would make it again
    lower = metric in ("mse", "rmse", "mae")
    ev = RegressionEvaluator(labelCol=y, metricName=metric) if lower or metric == "r2" else MulticlassClassificationEvaluator(labelCol=y, metricName=metric)
    got = CrossValidator(estimator=pipe, estimatorParamMaps=points, evaluator=ev, numFolds=folds, seed=seed, parallelism=4).fit(train)
    train.unpersist()
    rows = [(str(sorted((p.name, v) for p, v in pt.items())), float(s)) for pt, s in zip(points, got.avgMetrics, strict=True)]
    return train.sparkSession.createDataFrame(rows, "params string, score double").orderBy(F.col("score") if lower else F.desc("score"))


def importances(model, variables: list[str], spark) -> DataFrame:
    """(variable, importance), the most important first."""
    v = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(n, float(x)) for n, x in zip(variables, v, strict=True)], "variable string, importance double").orderBy(F.desc("importance"), "variable")


def f1_by_date(pred: DataFrame, y: str, date: str = "date") -> DataFrame:
    """(date, precision, recall, f1) of 0/1 predictions, by aggregates."""
    hit = lambda a, b: F.count(F.when((F.col("prediction") == a) & (F.col(y) == b), 1))
    c = pred.groupBy(date).agg(hit(1, 1).alias("tp"), hit(1, 0).alias("fp"), hit(0, 1).alias("fn"))
    return c.select(date, F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"), F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def swap_test(train: DataFrame, valid: DataFrame, y: str, start: list[str], others: list[str], algorithm: str = "gbt", **params) -> tuple[list[str], float]:
    """Greedy swaps: a variable is replaced by another where that improves F1 on the later rows, until no swap of one variable does.

    Each place is tested against all names outside the set, among them those
    replaced before. A set of variables is fitted once, in whatever order it is
    met. Both tables are kept while models are fitted, as each fit would make
    them again.
    """
    train, valid = (x.persist(StorageLevel.MEMORY_AND_DISK) for x in (train, valid))
    ev = MulticlassClassificationEvaluator(labelCol=y, metricName="f1")
    every, known = list(dict.fromkeys([*start, *others])), {}

    def score(vs: list[str]) -> float:
        if (names := frozenset(vs)) not in known:
            known[names] = ev.evaluate(pipeline(algorithm, y, [v for v in every if v in names], **params).fit(train).transform(valid))
        return known[names]

    chosen, best, before = list(start), score(start), None
    while chosen != before:
        before = list(chosen)
        for i in range(len(chosen)):
            for o in every:
                if o not in chosen:
                    trial = [*chosen[:i], o, *chosen[i + 1 :]]
                    if (s := score(trial)) > best:
                        chosen, best = trial, s
    train.unpersist(), valid.unpersist()
    return chosen, best


def registry_rows(model_id: int, params: dict[str, str], variables: DataFrame, spark) -> tuple[DataFrame, DataFrame]:
    """A model's parameters and variables as long tables, to be appended to the registry."""
    p = spark.createDataFrame([(k, str(v), model_id) for k, v in sorted(params.items())], "parameter string, value string, model_id long")
    return p, variables.withColumn("model_id", F.lit(model_id).cast("long"))


def next_id(registry: DataFrame, column: str = "model_id") -> int:
    """One more than the largest id so far; 1 for an empty registry."""
    return (registry.agg(F.max(column)).first()[0] or 0) + 1
