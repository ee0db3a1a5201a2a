"""Model catalogue: MLlib estimators, and ensembles built on them, behind one naming.

Settings use the names tabular users know (n_estimators, max_depth, alpha, C).
Some families have no exact MLlib form and are approximations:
Extra Trees splits on seeded random cut points, the kernel SVMs use random
Fourier features (the regressor with squared loss), and the XGBoost slot is MLlib's
boosted trees with row and column sampling.
"""

from __future__ import annotations

import math
import random
import time
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC,
                                       LogisticRegression, OneVsRest, RandomForestClassifier)
from pyspark.ml.feature import Bucketizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktab.functions.aggregate import wide_agg
from sparktab.functions.columns import c, dbl, spread
from sparktab.functions.lookup import BROADCAST_ROWS
from sparktab.functions.staging import stage
from sparktab.operators import metrics
from sparktab.operators.base import Fitted
from sparktab.operators.neighbors import knn_classify, knn_regress, vector

# fixed values: names of the supported models
SHARED = ["AdaBoost", "Decision Tree", "Extra Trees", "Gradient Boosting", "KNN", "Random Forest",
          "SVM", "XGBoost"]
REGRESSORS = SHARED + ["Linear Regression", "Ridge", "Lasso", "ElasticNet"]
CLASSIFIERS = SHARED + ["Logistic Regression"]
SERIES = ["Prophet", "ARIMA", "SARIMAX"]
ROW_ID = "row_id"
MANY_PASSES = ("Extra Trees", "SVM")  # go through their rows once per tree, or in many columns


def supported_models(task: str, time_series: bool = False) -> list[str]:
    names = REGRESSORS if task.lower() == "regression" else CLASSIFIERS
    return sorted(names + (SERIES if time_series else []))


def assemble(df: DataFrame, features: list[str], label: str | None = None, key: str | None = None) -> DataFrame:
    """row_id, features as a vector and as columns, label as double."""
    cols = [c(x).cast("double").alias(x) for x in features]
    extra = [c(key).alias(ROW_ID)] if key else []
    if label:
        extra.append(c(label).cast("double").alias("label"))
    plain = df.select(*extra, *cols)
    return VectorAssembler(inputCols=features, outputCol="features").transform(plain)


WEIGHT, REST = "_weight", "_rest"
CELL_ROWS = 4  # rows of a cell, on average, from which on cells are made
WEIGHED = ("Linear Regression", "Ridge", "Lasso", "ElasticNet", "Decision Tree", "Extra Trees", "SVM")


def weighed(name: str, task: str) -> bool:
    """Does a weighted fit of `cells` give the model that all rows give? SVM classes go by hinge loss through rows."""
    return name in WEIGHED and (name != "SVM" or task == "regression")


def cells(df: DataFrame, features: list[str], task: str, by: tuple[str, ...] = (), least: int = 1) -> tuple[DataFrame, int]:
    """(table, rows of df): rows of equal features (and `by`; for classes, label) as one, with their number as _weight; df itself below `least` rows or where rows seldom repeat.

    Numbers have their mean as label, and as _rest the squares around it: least squares and variance splits over the cells are those
    over the rows, as what differs inside a cell no function of the features can tell. A null label stays null.
    """
    keys = [*by, *features, *(["label"] if task == "classification" else [])]
    rows, kinds = df.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*[c(x) for x in keys]))).first()
    if rows < max(CELL_ROWS * kinds, least):
        return df, rows
    n = F.count(F.lit(1))
    told = [] if task == "classification" else [F.when(F.count("label") == n, F.avg("label")).alias("label"), (F.var_pop("label") * n).alias(REST)]
    out = stage(df.groupBy(*[c(x) for x in keys]).agg(n.cast("double").alias(WEIGHT), *told), "cells")
    return VectorAssembler(inputCols=features, outputCol="features").transform(spread(out)), rows


def fit_weighed(est: Estimator, df: DataFrame) -> Model:
    """The fit of an estimator with the weights of `cells`, where df has them; own estimators look for them themselves."""
    return est.fit(df, {est.getParam("weightCol"): WEIGHT}) if WEIGHT in df.columns and est.hasParam("weightCol") else est.fit(df)


def weight_of(df: DataFrame) -> dict[str, str]:
    return {"weightCol": WEIGHT} if WEIGHT in df.columns else {}


def predict_cells(model: Model, df: DataFrame, features: list[str]) -> DataFrame:
    """label and prediction of each row; the model is asked once for each distinct row of the features."""
    asked = stage(df.select(*[c(x) for x in features]).distinct(), "asked")
    told = model.transform(VectorAssembler(inputCols=features, outputCol="features").transform(spread(asked)))
    told = stage(told.select(*[c(x) for x in features], "prediction"), "told")
    told = F.broadcast(told) if told.count() <= BROADCAST_ROWS else told
    return df.select("label", *[c(x) for x in features]).join(told, features).select("label", "prediction")


class RandomFourier(Fitted):
    """features -> cosines of random projections, which approximate an RBF kernel."""

    defaults = {"size": 128, "gamma": 1.0, "width": 1, "seed": 42}

    def apply(self, df):
        rng = np.random.default_rng(self["seed"])
        w = rng.normal(0, math.sqrt(2 * self["gamma"]), (self["width"], self["size"]))
        b = rng.uniform(0, 2 * math.pi, self["size"])
        scale = math.sqrt(2.0 / self["size"])

        @F.pandas_udf("array<double>")
        def project(x: pd.Series) -> pd.Series:
            m = np.array(x.tolist(), dtype="float64").reshape(len(x), -1)
            return pd.Series(list(scale * np.cos(m @ w + b))) if len(x) else pd.Series([], dtype=object)

        return df.withColumn("fourier", array_to_vector(project(vector_to_array("features"))))


class _EnsembleWriter(DefaultParamsWriter):
    def saveImpl(self, path):
        for i, m in enumerate(self.instance.members):
            m.write().save(f"{path}/members/{i}")
        super().saveImpl(path)


class _EnsembleReader(DefaultParamsReader):
    def load(self, path):
        model = super().load(path)
        model.members = [PipelineModel.load(f"{path}/members/{i}") for i in range(model["count"])]
        return model


class Ensemble(Fitted):
    """Members combined by mean, weighted vote or weighted median."""

    defaults = {"mode": "mean", "weights": [], "classes": 0, "count": 0}

    def __init__(self, members=None, **values):
        super().__init__(**values)
        self.members = members or []

    def write(self):
        return _EnsembleWriter(self)

    @classmethod
    def read(cls):
        return _EnsembleReader(cls)

    def apply(self, df):
        keep, weights = df.columns, self["weights"]
        for i, m in enumerate(self.members):
            before = df.columns
            df = m.transform(df).withColumnRenamed("prediction", f"_p{i}")
            df = df.select(*[c(x) for x in before], f"_p{i}")
        preds = [F.col(f"_p{i}") for i in range(len(self.members))]
        out = [c(x) for x in keep]
        if self["mode"] == "mean":
            return df.select(*out, (sum(preds[1:], preds[0]) / len(preds)).alias("prediction"))
        if self["mode"] == "median":
            pairs = F.array_sort(F.array(*[F.struct(p.alias("p"), F.lit(w).alias("w"))
                                           for p, w in zip(preds, weights)]))
            start = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("v"))
            half = F.lit(sum(weights) / 2)
            step = F.aggregate(pairs, start, lambda a, x: F.struct(
                (a["s"] + x["w"]).alias("s"),
                F.when(a["v"].isNull() & (a["s"] + x["w"] >= half), x["p"]).otherwise(a["v"]).alias("v")))
            return df.select(*out, step["v"].alias("prediction"))
        total = sum(weights) or 1.0
        votes = [sum((F.when(p == k, w).otherwise(0.0) for p, w in zip(preds, weights)), F.lit(0.0)) / total
                 for k in range(self["classes"])]
        arr = F.array(*votes)
        return df.select(*out, array_to_vector(arr).alias("probability"),
                         (F.array_position(arr, F.array_max(arr)) - 1).cast("double").alias("prediction"))


class AdaBoost(Estimator):
    """SAMME for classes, R2 for numbers: one weighted tree and one error aggregate per round."""

    def __init__(self, task, n_estimators=50, learning_rate=1.0, max_depth=None, classes=2, seed=42):
        super().__init__()
        self.task, self.rounds, self.rate = task, n_estimators, learning_rate
        self.depth, self.classes, self.seed = max_depth, classes, seed

    def _fit(self, df):
        members, weights = [], []
        data = df.select("features", "label", F.lit(1.0).alias("w"))
        regress = self.task == "regression"
        for i in range(self.rounds):
            tree = (DecisionTreeRegressor(maxDepth=self.depth or 3, weightCol="w", seed=self.seed + i) if regress
                    else DecisionTreeClassifier(maxDepth=self.depth or 1, weightCol="w", seed=self.seed + i))
            model = tree.fit(data)
            seen = model.transform(data).select("features", "label", "w", "prediction")
            if regress:
                seen = seen.withColumn("e", F.abs(F.col("label") - F.col("prediction")))
                top = seen.agg(F.max("e")).first()[0]
                seen = seen.withColumn("e", F.col("e") / (top or 1.0))
            else:
                seen = seen.withColumn("e", (F.col("label") != F.col("prediction")).cast("double"))
            err, total = seen.agg(F.sum(F.col("w") * F.col("e")), F.sum("w")).first()
            err = err / total
            limit = 0.5 if regress else 1 - 1 / self.classes
            if err >= limit and members:
                break
            safe = min(max(err, 1e-10), 1 - 1e-10)
            if regress:
                beta = safe / (1 - safe)
                alpha, factor = self.rate * math.log(1 / beta), F.pow(F.lit(beta), self.rate * (1 - F.col("e")))
            else:
                alpha = self.rate * (math.log((1 - safe) / safe) + math.log(max(self.classes - 1, 1)))
                factor = F.exp(F.lit(alpha) * F.col("e"))
            members.append(PipelineModel([model]))
            weights.append(alpha)
            if err <= 0 or err >= limit:
                break
            scale = 1.0 / total  # keeps the weights in range
            data = seen.select("features", "label", (F.col("w") * factor * F.lit(scale * 1e3)).alias("w"))
            data = stage(data, "boost") if i % 5 == 4 else data
        return Ensemble(members, mode="median" if regress else "vote", weights=weights,
                        classes=self.classes, count=len(members))


class ExtraTrees(Estimator):
    """Each tree sees the features cut at its own random points and uses all rows."""

    def __init__(self, task, features, n_estimators=20, max_depth=8, cuts=16, classes=2, seed=42, threads=4):
        super().__init__()
        self.task, self.features, self.trees, self.depth = task, features, n_estimators, max_depth
        self.cuts, self.classes, self.seed, self.threads = cuts, classes, seed, threads

    def _fit(self, df):
        span = wide_agg(df, {x: F.struct(F.min(dbl(x)), F.max(dbl(x))) for x in self.features})
        usable = [x for x in self.features if span[x][0] is not None and span[x][0] < span[x][1]]
        base = df.select("label", *[c(x) for x in usable], *weight_of(df).values())

        def one(i):
            rng = random.Random(self.seed * 1000 + i)
            splits = [[-math.inf, *sorted({rng.uniform(*span[x]) for _ in range(self.cuts)}), math.inf]
                      for x in usable]
            kind = RandomForestRegressor if self.task == "regression" else RandomForestClassifier
            forest = kind(featuresCol="_binned", numTrees=1, bootstrap=False, maxDepth=self.depth, seed=self.seed + i, **weight_of(df),
                          featureSubsetStrategy="auto" if len(usable) < 3 else "onethird")
            bins = [f"_bin{j}" for j in range(len(usable))]
            return Pipeline(stages=[
                Bucketizer(splitsArray=splits, inputCols=usable, outputCols=bins, handleInvalid="keep"),
                VectorAssembler(inputCols=bins, outputCol="_binned"), forest]).fit(base)

        with ThreadPool(self.threads) as pool:
            members = pool.map(inheritable_thread_target(df.sparkSession)(one), range(self.trees))
        if self.task == "regression":
            return Ensemble(members, mode="mean", count=len(members))
        return Ensemble(members, mode="vote", weights=[1.0] * len(members), classes=self.classes,
                        count=len(members))


class KnnModel(Fitted):
    """Holds its training rows as a written table."""

    defaults = {"table": "", "task": "regression", "k": 5}

    def write(self):
        return _KnnWriter(self)

    @classmethod
    def read(cls):
        return _KnnReader(cls)

    def apply(self, df):
        train = df.sparkSession.read.parquet(self["table"])
        asks = df.withColumn("_v", vector_to_array("features"))
        fn = knn_regress if self["task"] == "regression" else knn_classify
        got = fn(asks, train, ROW_ID, "_v", "label", self["k"])
        return df.join(got, ROW_ID, "left")


class _KnnWriter(DefaultParamsWriter):
    def saveImpl(self, path):
        self.sparkSession.read.parquet(self.instance["table"]).write.parquet(f"{path}/rows")
        super().saveImpl(path)


class _KnnReader(DefaultParamsReader):
    def load(self, path):
        model = super().load(path)
        model._set(values={**model.getOrDefault(model.values), "table": f"{path}/rows"})
        return model


class Knn(Estimator):
    def __init__(self, task, n_neighbors=5):
        super().__init__()
        self.task, self.k = task, n_neighbors

    def _fit(self, df):
        from sparktab.functions.staging import stage_path
        path = stage_path(df.sparkSession, "knn-model")
        df.select(ROW_ID, "label", vector_to_array("features").alias("_v")).write.parquet(path)
        return KnnModel(table=path, task=self.task, k=self.k)


class KernelSvm(Estimator):
    def __init__(self, task, C=1.0, kernel="rbf", classes=2, size=128, seed=42):
        super().__init__()
        self.task, self.C, self.kernel, self.classes, self.size, self.seed = task, C, kernel, classes, size, seed

    def _fit(self, df):
        w = F.col(WEIGHT) if WEIGHT in df.columns else F.lit(1.0)
        parts = df.select(F.explode(vector_to_array("features")).alias("x"), F.size(vector_to_array("features")).alias("d"), w.alias("w"))
        n, width, mean = parts.agg(F.sum("w"), F.max("d"), F.sum(F.col("x") * F.col("w")) / F.sum("w")).first()
        var = parts.agg(F.sum(F.pow(F.col("x") - F.lit(mean), 2) * F.col("w")) / F.sum("w")).first()[0]
        rows = max(int(n or 0) // max(width, 1), 1)
        col, stages = "features", []
        if self.kernel == "rbf":
            stages = [RandomFourier(size=self.size, gamma=1.0 / (width * (var or 1.0)), width=width, seed=self.seed)]
            col = "fourier"
        reg = 1.0 / (self.C * rows)
        if self.task == "regression":
            last = Penalized("Ridge", {"alpha": 1.0 / self.C}, col)
        else:
            last = LinearSVC(featuresCol=col, regParam=reg, maxIter=30, tol=1e-3)
            if self.classes > 2:
                last = OneVsRest(classifier=last, featuresCol=col, parallelism=4)
        return Pipeline(stages=[*stages, last]).fit(df)


def penalty(name: str, params: dict, rows: int, label_std: float) -> tuple[float, float]:
    """(regParam, elasticNetParam) that give the usual objective of a penalised linear model.

    MLlib scales the label to unit deviation first, which divides the squared
    penalty by that deviation and leaves the absolute one as it is.
    """
    alpha, std = params.get("alpha", 1.0), label_std or 1.0
    if name == "Ridge":
        return alpha / max(rows, 1) * std, 0.0
    mix = 1.0 if name == "Lasso" else params.get("l1_ratio", 0.5)
    total = alpha * (mix + (1 - mix) * std)
    return total, alpha * mix / total if total else 0.0


def label_stats(df: DataFrame) -> tuple[int, float]:
    """Rows and deviation of the labels as a fit sees them: of the cells' means where df has weights."""
    if WEIGHT not in df.columns:
        return df.agg(F.count("label"), F.coalesce(F.stddev_pop("label"), F.lit(0.0))).first()
    w = F.col(WEIGHT)
    n, mean = df.agg(F.sum(w), F.sum(F.col("label") * w) / F.sum(w)).first()
    return int(n), df.agg(F.coalesce(F.sqrt(F.sum(F.pow(F.col("label") - F.lit(mean), 2) * w) / F.sum(w)), F.lit(0.0))).first()[0]


class Penalized(Estimator):
    """Ridge, Lasso and ElasticNet with the penalty measured on the training rows."""

    def __init__(self, name, params, features_col="features"):
        super().__init__()
        self.name, self.params_, self.col = name, params, features_col

    def _fit(self, df):
        reg, mix = penalty(self.name, self.params_, *label_stats(df))
        solver = "normal" if self.name == "Ridge" else "auto"
        return LinearRegression(featuresCol=self.col, solver=solver, regParam=reg, elasticNetParam=mix,
                                standardization=False, **weight_of(df)).fit(df)


def make_estimator(name: str, task: str, rows: int, features: list[str], classes: int = 2,
                   params: dict | None = None, seed: int = 42) -> Estimator:
    """Estimator over (features, label) for a model name; `rows` converts penalties to MLlib's scale."""
    p, regress = dict(params or {}), task == "regression"
    trees, depth = p.get("n_estimators"), p.get("max_depth")
    if name == "Linear Regression":
        return LinearRegression(solver="normal")
    if name in ("Ridge", "Lasso", "ElasticNet"):
        return Penalized(name, p)
    if name == "Logistic Regression":
        return LogisticRegression(family="auto", regParam=1.0 / (p.get("C", 1.0) * max(rows, 1)), standardization=False)
    if name == "Decision Tree":
        kind = DecisionTreeRegressor if regress else DecisionTreeClassifier
        return kind(maxDepth=depth or 10, seed=seed)
    if name == "Random Forest":
        kind = RandomForestRegressor if regress else RandomForestClassifier
        return kind(numTrees=trees or 20, maxDepth=min(depth or 10, 30), seed=seed,
                    minInstancesPerNode=p.get("min_samples_leaf", 1))
    if name in ("Gradient Boosting", "XGBoost"):
        kind = GBTRegressor if regress else GBTClassifier
        slot = name == "XGBoost"
        model = kind(maxIter=trees or 20, maxDepth=depth or (6 if slot else 3), stepSize=p.get("learning_rate", 0.3 if slot else 0.1),
                     subsamplingRate=p.get("subsample", 0.8 if slot else 1.0), seed=seed,
                     featureSubsetStrategy=str(p.get("colsample_bytree", 0.8)) if slot else "all")
        return OneVsRest(classifier=model, parallelism=4) if not regress and classes > 2 else model
    if name == "AdaBoost":
        return AdaBoost(task, trees or 50, p.get("learning_rate", 1.0), depth, classes, seed)
    if name == "Extra Trees":
        return ExtraTrees(task, features, trees or 20, depth or 8, classes=classes, seed=seed)
    if name == "SVM":
        return KernelSvm(task, p.get("C", 1.0), p.get("kernel", "rbf"), classes, seed=seed)
    if name == "KNN":
        return Knn(task, p.get("n_neighbors", 5))
    raise KeyError(f"no model named {name}")


def encode_target_labels(df: DataFrame, label: str, name: str = "label") -> tuple[DataFrame, list[str]]:
    """Codes 0..k-1 in alphabetical order of the classes."""
    coder = StringIndexer(inputCol=label, outputCol=name, stringOrderType="alphabetAsc").fit(df)
    return coder.transform(df), list(coder.labels)


def coded_labels(train: DataFrame, test: DataFrame | None, label: str, task: str) -> tuple[DataFrame, DataFrame | None, str, list[str]]:
    """(train, test, label column, classes): text classes become codes in alphabetical order, learned from the training rows.

    A class that only the test rows have gets a code of its own, which no model can predict. Numbers stay as they are.
    """
    if task != "classification" or not isinstance(train.schema[label].dataType, T.StringType):
        return train, test, label, []
    name = f"_code_{label}"
    coder = StringIndexer(inputCol=label, outputCol=name, stringOrderType="alphabetAsc", handleInvalid="keep").fit(train.filter(c(label).isNotNull()))
    code = lambda d: None if d is None else coder.transform(d.filter(c(label).isNotNull()))
    return code(train), code(test), name, list(coder.labels)


def decode_labels(df: DataFrame, labels: list[str], name: str = "prediction", out: str = "predicted_label") -> DataFrame:
    arr = F.array(*[F.lit(x) for x in labels])
    return df.withColumn(out, F.get(arr, c(name).cast("int")))


@dataclass
class Trained:
    task: str
    features: list[str]
    labels: list[str] = field(default_factory=list)
    models: dict[str, Model] = field(default_factory=dict)
    predictions: dict[str, DataFrame] = field(default_factory=dict)
    rows: list[dict] = field(default_factory=list)

    def results(self, spark) -> DataFrame:
        """One metric row per model; failed models carry `error`."""
        names = (["rmse", "mae", "r2", "mape"] if self.task == "regression"
                 else ["accuracy", "f1", "precision", "recall", "mcc", "kappa", "auc"])
        schema = "model string, seconds double, " + ", ".join(f"{n} double" for n in names) + ", error string"
        return spark.createDataFrame([tuple(r.get(k) for k in ["model", "seconds", *names, "error"])
                                      for r in self.rows], schema)


def evaluate(pred: DataFrame, task: str, classes: int = 2) -> dict:
    if task == "regression":
        return metrics.regression_metrics(pred, "label", "prediction").first().asDict()
    out = metrics.classification_values(pred, "label", "prediction", 1.0)
    if "probability" in pred.columns:
        p = pred.select("label", vector_to_array("probability").alias("p"))
        if classes == 2:
            out["auc"] = metrics.auc_binary(p, F.col("label") == 1, F.col("p")[1])
        else:
            wide = p.select("label", *[F.col("p")[k].alias(f"p{k}") for k in range(classes)])
            out["auc"] = metrics.auc_ovr_weighted(wide, "label", {float(k): f"p{k}" for k in range(classes)})
    return {k: None if v is None else round(float(v), 4) for k, v in out.items()}


def train_many(train: DataFrame, test: DataFrame, features: list[str], label: str, key: str, task: str,
               names: list[str], params: dict[str, dict] | None = None, parallelism: int = 2,
               strict: bool = False, seed: int = 42) -> Trained:
    """Fit the named models as concurrent Spark jobs over one stored feature table."""
    task = task.lower()
    labels: list[str] = []
    train, test = train.filter(c(label).isNotNull()), test.filter(c(label).isNotNull())  # nothing to learn from or to score
    if task == "classification":
        coder = StringIndexer(inputCol=label, outputCol="_code", stringOrderType="alphabetAsc",
                              handleInvalid="keep").fit(train)
        labels = list(coder.labels)
        train, test, label = coder.transform(train), coder.transform(test), "_code"
    tr, te = assemble(train, features, label, key), assemble(test, features, label, key)
    packed, rows, few = None, 0, [x for x in names if x in MANY_PASSES and weighed(x, task)]
    if len(few) == len(names):
        packed, rows = cells(tr, features, task)
    if packed is None or packed is tr:  # some model goes through the rows
        tr = spread(tr).persist()
        if packed is None:
            rows = tr.count()
            packed = cells(tr, features, task)[0] if few else tr
        else:
            packed = tr
        te.persist()
    out = Trained(task, features, labels)
    known = supported_models(task)

    def one(name):
        start = time.time()
        try:
            if name not in known:
                raise KeyError(f"no model named {name}")
            once = name in few and packed is not tr
            model = make_estimator(name, task, rows, features, len(labels), (params or {}).get(name), seed).fit(packed if once else tr)
            pred = model.transform(te)
            seen = predict_cells(model, te, features) if once and task == "regression" else pred
            return name, model, pred, {"model": name, "seconds": round(time.time() - start, 4),
                                       **evaluate(seen, task, len(labels))}
        except Exception as e:  # a failed model is a row of the results
            if strict:
                raise
            return name, None, None, {"model": name, "error": f"{type(e).__name__}: {e}"[:500]}

    with ThreadPool(parallelism) as pool:
        done = pool.map(inheritable_thread_target(train.sparkSession)(one), names, chunksize=1)
    for name, model, pred, row in done:
        out.rows.append(row)
        if model is not None:
            out.models[name], out.predictions[name] = model, pred
    tr.unpersist()
    te.unpersist()
    return out


def multi_output(train: DataFrame, test: DataFrame, features: list[str], targets: list[str], key: str, task: str,
                 name: str, params: dict | None = None) -> tuple[dict[str, Model], DataFrame]:
    """One model per target over one stored feature vector; predictions side by side, text classes as text."""
    codes, labels = {}, {}
    for t in targets:
        train, test, codes[t], labels[t] = coded_labels(train, test, t, task)
    vec = VectorAssembler(inputCols=features, outputCol="features")
    numbers = [c(x).cast("double").alias(x) for x in dict.fromkeys([*features, *codes.values()])]
    tr = vec.transform(train.select(c(key).alias(ROW_ID), *numbers))
    te = vec.transform(test.select(c(key).alias(ROW_ID), *numbers, *[c(t) for t in targets if codes[t] != t]))
    tr = spread(tr).persist()
    rows, models, out = tr.count(), {}, te
    for t in targets:
        classes = len(labels[t]) or (int(tr.agg(F.max(c(codes[t]))).first()[0]) + 1 if task == "classification" else 2)
        models[t] = make_estimator(name, task, rows, features, classes, params).fit(tr.withColumn("label", c(codes[t])))
        kept = out.columns
        out = models[t].transform(out).withColumnRenamed("prediction", f"prediction_{t}") \
            .select(*[c(x) for x in kept], c(f"prediction_{t}"))
        if labels[t]:
            out = decode_labels(out, labels[t], f"prediction_{t}", f"prediction_{t}").drop(codes[t])
    tr.unpersist()
    return models, out
