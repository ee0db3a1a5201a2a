"""Hyperparameter search: batches of trials as concurrent Spark jobs within a time budget."""

from __future__ import annotations

import itertools
import math
import random
import time
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.evaluation import Evaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktab.functions.columns import c, spread
from sparktab.operators import models
from sparktab.operators.metrics import regression_metrics
from sparktab.operators.split import inner_holdout, kfold, time_series_folds
from sparktab.operators.timeseries import trend_season_forecast

# fixed values: search ranges (low, high, log scale) or choices
SPACES = {
    "XGBoost": {"n_estimators": (100, 1000, False), "learning_rate": (0.01, 0.3, True), "max_depth": (3, 12, False),
                "subsample": (0.5, 1.0, False), "colsample_bytree": (0.5, 1.0, False)},
    "Random Forest": {"n_estimators": (50, 500, False), "max_depth": (5, 30, False), "min_samples_leaf": (1, 5, False)},
    "Extra Trees": {"n_estimators": (50, 500, False), "max_depth": (5, 30, False)},
    "Gradient Boosting": {"n_estimators": (50, 500, False), "learning_rate": (0.01, 0.2, True), "max_depth": (3, 8, False),
                          "subsample": (0.6, 1.0, False)},
    "SVM": {"C": (0.1, 100.0, True), "kernel": ["linear", "rbf"]},
    "KNN": {"n_neighbors": (3, 20, False)},
    "Ridge": {"alpha": (0.1, 100.0, True)},
    "Lasso": {"alpha": (0.001, 10.0, True)},
    "ElasticNet": {"alpha": (0.1, 10.0, True), "l1_ratio": (0.1, 0.9, False)},
    "Logistic Regression": {"C": (0.1, 100.0, True)},
    "AdaBoost": {"n_estimators": (10, 100, False), "learning_rate": (0.01, 1.0, True)},
    "Decision Tree": {"max_depth": (2, 20, False)},
    "Linear Regression": {},
}
TREND_SPACE = {"changepoint_scale": (0.001, 0.5, True), "season_scale": (0.01, 10.0, True)}


def propose(space: dict, history: list[tuple[float, dict]], rng: random.Random, explore: int = 8) -> dict:
    """Random at first; then a draw around one of the best quarter of trials."""
    parent = None
    if len(history) >= explore and rng.random() > 0.2:
        best = sorted(history, key=lambda h: -h[0])[:max(1, len(history) // 4)]
        parent = rng.choice(best)[1]
    out = {}
    for name, rule in space.items():
        if isinstance(rule, list):
            out[name] = parent[name] if parent and rng.random() < 0.8 else rng.choice(rule)
            continue
        lo, hi, log = rule
        a, b = (math.log(lo), math.log(hi)) if log else (float(lo), float(hi))
        if parent:
            mid = math.log(parent[name]) if log else float(parent[name])
            x = min(b, max(a, rng.gauss(mid, (b - a) * 0.15)))
        else:
            x = rng.uniform(a, b)
        v = math.exp(x) if log else x
        out[name] = int(round(v)) if isinstance(lo, int) and not log else v
    return out


def search(space: dict, score, time_budget: float, max_trials: int | None, batch: int, spark, seed: int):
    """(best parameters, best score, finished trials); failed trials are skipped."""
    rng, history, start, tried = random.Random(seed), [], time.time(), 0
    while (time.time() - start < time_budget or not tried) and (max_trials is None or tried < max_trials):
        size = batch if max_trials is None else min(batch, max_trials - tried)
        asks = [propose(space, history, rng) for _ in range(size)]
        tried += size

        def safe(p):
            try:
                return score(p), p
            except Exception:  # a failed trial gives no score
                return None, p

        with ThreadPool(size) as pool:
            history += [(s, p) for s, p in pool.map(inheritable_thread_target(spark)(safe), asks, chunksize=1)
                        if s is not None]
        if not space and history:
            break
    if not history:
        raise RuntimeError("no trial finished within the time budget")
    best = max(history, key=lambda h: h[0])
    return best[1], best[0], len(history)


class CellRmse(Evaluator):
    """RMSE of the rows behind `cells`: what differs inside a cell is an error of any model."""

    def _evaluate(self, pred):
        w = F.col(models.WEIGHT)
        return pred.agg(F.sqrt(F.sum(w * F.pow(F.col("label") - F.col("prediction"), 2) + F.col(models.REST)) / F.sum(w))).first()[0]

    def isLargerBetter(self):
        return False


def _score(pred: DataFrame, task: str) -> float:
    if models.WEIGHT in pred.columns:
        return -CellRmse().evaluate(pred) if task == "regression" else MulticlassClassificationEvaluator(metricName="accuracy", weightCol=models.WEIGHT).evaluate(pred)
    if task == "regression":
        return -RegressionEvaluator(metricName="rmse").evaluate(pred)
    return MulticlassClassificationEvaluator(metricName="accuracy").evaluate(pred)


TREE_ROWS = 1_000_000  # a tree draws its split candidates from a sample of rows or cells: cells only where passes over rows cost much


def _fold_rows(folded: DataFrame, name: str, task: str, features: list[str], label: str, key: str) -> tuple[DataFrame, int]:
    """(kept table of label, fold and features, its rows): as weighted cells of each fold where the model allows it and rows repeat, else row by row."""
    plain = folded.select(c(key).alias(models.ROW_ID), c(label).cast("double").alias("label"), "fold", *[c(f).cast("double").alias(f) for f in features])
    if models.weighed(name, task):
        out, n = models.cells(plain, features, task, ("fold",), TREE_ROWS if name == "Decision Tree" else 1)
        if out is not plain:
            return out.persist(), n
    tr = spread(models.VectorAssembler(inputCols=features, outputCol="features").transform(plain)).persist()
    return tr, tr.count()


def tune(train: DataFrame, test: DataFrame, name: str, task: str, features: list[str], label: str, key: str,
         time_budget: float = 60, cv_folds: int = 3, max_trials: int | None = None, batch: int = 4,
         space: dict | None = None, time_col: str | None = None, seed: int = 42):
    """Best parameters by mean CV score (-RMSE or accuracy), refitted on all training rows.

    Returns (model, result): the result holds the test metrics under "<name> (Tuned)",
    the number of trials and the parameters.
    """
    start, task = time.time(), task.lower()
    space = SPACES[name] if space is None else space
    train, test, label, labels = models.coded_labels(train, test, label, task)
    if time_col:
        folded = time_series_folds(train, time_col, key, cv_folds).withColumnRenamed("block", "fold")
    else:
        folded = kfold(train, key, cv_folds)
    tr, n = _fold_rows(folded, name, task, features, label, key)
    classes = len(labels) or (int(tr.agg(F.max("label")).first()[0]) + 1 if task == "classification" else 2)

    def score(params):
        total = 0.0
        for i in range(1, cv_folds + 1) if time_col else range(cv_folds):
            fit = tr.filter(F.col("fold") < i) if time_col else tr.filter(F.col("fold") != i)
            model = models.fit_weighed(models.make_estimator(name, task, n, features, classes, params, seed), fit)
            total += _score(model.transform(tr.filter(F.col("fold") == i)), task)
        return total / cv_folds

    try:
        params, value, trials = search(space, score, time_budget, max_trials, batch, train.sparkSession, seed)
        model = models.fit_weighed(models.make_estimator(name, task, n, features, classes, params, seed), tr.drop("fold"))
        pred = model.transform(models.assemble(test, features, label, key))
        result = {"model": f"{name} (Tuned)", **models.evaluate(pred, task, classes), "cv_score": value,
                  "trials": trials, "params": params, "seconds": round(time.time() - start, 4), **({"labels": labels} if labels else {})}
    finally:
        tr.unpersist()
    return model, result


# fixed values: MLlib parameter behind each public setting
MLLIB_NAMES = {"max_depth": "maxDepth", "learning_rate": "stepSize", "subsample": "subsamplingRate", "min_samples_leaf": "minInstancesPerNode"}


OWN = ("KNN", "SVM", "AdaBoost", "Extra Trees")


def _own_grid(tr: DataFrame, name: str, task: str, n: int, features: list[str], classes: int, grid: dict[str, list], cv_folds: int, parallelism: int):
    asks = [dict(zip(grid, v)) for v in itertools.product(*grid.values())]

    def score(params):
        total = 0.0
        for i in range(cv_folds):
            model = models.fit_weighed(models.make_estimator(name, task, n, features, classes, params), tr.filter(F.col("fold") != i))
            total += _score(model.transform(tr.filter(F.col("fold") == i)), task)
        return total / cv_folds

    try:
        with ThreadPool(parallelism) as pool:
            scores = pool.map(inheritable_thread_target(tr.sparkSession)(score), asks, chunksize=1)
        best = asks[max(range(len(asks)), key=lambda i: scores[i])]
        model = models.fit_weighed(models.make_estimator(name, task, n, features, classes, best), tr.drop("fold"))
    finally:
        tr.unpersist()
    rows = [({k: str(v) for k, v in a.items()}, abs(s)) for a, s in zip(asks, scores)]
    return model, tr.sparkSession.createDataFrame(rows, "params map<string,string>, cv_metric double")


def custom_grid(train: DataFrame, name: str, task: str, features: list[str], label: str, key: str,
                grid: dict[str, list], cv_folds: int = 3, parallelism: int = 4):
    """User lists of values on fixed folds: (best model, params with their metric).

    Through ParamGridBuilder and CrossValidator; families without MLlib parameters (OWN) are fitted for each combination.
    """
    train, _, label, labels = models.coded_labels(train, None, label, task)
    tr, n = _fold_rows(kfold(train, key, cv_folds), name, task, features, label, key)
    classes = len(labels) or (int(tr.agg(F.max("label")).first()[0]) + 1 if task == "classification" else 2)
    if name in OWN:
        return _own_grid(tr, name, task, n, features, classes, grid, cv_folds, parallelism)
    if name in ("Ridge", "Lasso", "ElasticNet"):
        est, (rows, std) = LinearRegression(standardization=False, **models.weight_of(tr)), models.label_stats(tr)
        asks = [dict(zip(grid, v)) for v in itertools.product(*grid.values())]
        maps = [{est.regParam: r, est.elasticNetParam: m} for r, m in (models.penalty(name, a, rows, std) for a in asks)]
    else:
        est = models.make_estimator(name, task, n, features, classes)
        if models.WEIGHT in tr.columns:
            est = est.copy({est.getParam("weightCol"): models.WEIGHT})
        builder = ParamGridBuilder()
        for k, values in grid.items():
            target = MLLIB_NAMES.get(k)
            if k == "n_estimators":
                target = "numTrees" if est.hasParam("numTrees") else "maxIter"
            elif k == "C":
                target, values = "regParam", [1.0 / (v * max(n, 1)) for v in values]
            builder = builder.addGrid(est.getParam(target), values)
        maps = builder.build()
    if task == "regression":
        ev = CellRmse() if models.WEIGHT in tr.columns else RegressionEvaluator(metricName="rmse")
    else:
        ev = MulticlassClassificationEvaluator(metricName="accuracy", **models.weight_of(tr))
    try:
        cv = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=ev, numFolds=cv_folds, foldCol="fold",
                            parallelism=parallelism).fit(tr)
    finally:
        tr.unpersist()
    rows = [({p.name: str(v) for p, v in m.items()}, float(s)) for m, s in zip(maps, cv.avgMetrics)]
    return cv.bestModel, train.sparkSession.createDataFrame(rows, "params map<string,string>, cv_metric double")


def tune_trend_model(train: DataFrame, test: DataFrame, ts: str, value: str, key: str, time_budget: float = 60,
                     max_trials: int | None = None, batch: int = 4, seed: int = 42, **kw):
    """Trend and season penalties by RMSE on the last fifth of the training rows."""
    inner = inner_holdout(train, ts, key)
    inner.persist()
    fit, val = inner.filter("split = 'fit'"), inner.filter("split = 'validate'")

    def rmse(p):
        return -regression_metrics(trend_season_forecast(fit, val, ts, value, **p, **kw), value, "forecast").first()["rmse"]

    params, best, trials = search(TREND_SPACE, rmse, time_budget, max_trials, batch, train.sparkSession, seed)
    inner.unpersist()
    pred = trend_season_forecast(train, test, ts, value, **params, **kw)
    return pred, {"model": "Prophet (Tuned)", "holdout_rmse": -best, "trials": trials, "params": params}


def tune_ar_order(train: DataFrame, ts: str, value: str, key: str, orders=(1, 2, 3, 5, 8), season: int = 0) -> DataFrame:
    """Holdout RMSE of each autoregression length, forecasting the whole validation part."""
    from sparktab.functions.order import series_index
    from sparktab.operators.timeseries import ar_forecast
    inner = inner_holdout(train, ts, key)
    fit = inner.filter("split = 'fit'")
    val = series_index(inner.filter("split = 'validate'").select(c(ts), c(key), c(value)), [], [ts, key], "i")
    n = val.count()
    rows = []
    for p in orders:
        lags = tuple(range(1, p + 1)) if not season else tuple(sorted({*range(1, p + 1), season, season + 1}))
        pred = ar_forecast(fit.select(c(ts), c(key), c(value)), [], [ts, key], value, n, lags=lags, season=season)
        both = val.join(pred, F.col("i") == F.col("step") - 1)
        rows.append((p, regression_metrics(both, value, "forecast").first()["rmse"]))
    return train.sparkSession.createDataFrame(rows, "p int, rmse double")
