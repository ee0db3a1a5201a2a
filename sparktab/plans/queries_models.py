"""Checked queries: model training (section F). Fits have no SQL form except one-feature least squares."""

from __future__ import annotations

import math

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sparktab.operators import metrics, models, split
from sparktab.plans.catalog import query

REG = ["c_acctbal", "c_nationkey", "month", "priority", "seg"]


def orders_table(t):
    """orders with customer features; customer is small by its row count against orders."""
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return o.select("o_orderkey", "o_totalprice", "o_orderstatus", "c_acctbal", "c_nationkey",
                    F.month("o_orderdate").alias("month"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
                    F.length("c_mktsegment").alias("seg"))


LI = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def lineitem_table(t):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return t.lineitem.select(F.xxhash64(*cols, "l_quantity", "l_extendedprice").alias("row"), "l_quantity", "l_discount",
                             "l_tax", "l_linenumber", "l_extendedprice", "l_returnflag",
                             (F.col("l_quantity") >= 40).cast("int").alias("big"))


def fit_reg(t, name, params=None):
    df = split.split_random(lineitem_table(t), "row")
    r = models.train_many(df.filter("split = 'train'"), df.filter("split = 'test'"), LI, "l_extendedprice", "row",
                          "regression", [name], {name: params or {}}, strict=True)
    return r.results(t.spark)


VEC = [f"e{i}" for i in range(64)]


def vectors(t):
    """All parts of each embedding as features of its label."""
    return split.split_random(t.embeddings.select("vec_id", "label", (F.col("label") % 2).alias("odd"), (F.col("label") % 3).alias("third"),
                                                  *[F.col("embedding")[i].alias(x) for i, x in enumerate(VEC)]), "vec_id")


def fit_cls(t, name, params=None, label="label"):
    df = vectors(t)
    r = models.train_many(df.filter("split = 'train'"), df.filter("split = 'test'"), VEC, label, "vec_id",
                          "classification", [name], {name: params or {}}, strict=True)
    return r.results(t.spark)


@query("linear_regression", """select round(regr_slope(l_extendedprice, l_quantity), 4) as slope,
 round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept from lineitem""")
def _(t):
    df = models.assemble(t.lineitem, ["l_quantity"], "l_extendedprice")
    m = models.make_estimator("Linear Regression", "regression", 0, ["l_quantity"]).fit(df)
    return t.spark.createDataFrame([(round(float(m.coefficients[0]), 4), round(float(m.intercept), 4))],
                                   "slope double, intercept double")


@query("encode_target_labels", """select o_orderkey, (dense_rank() over (order by o_orderstatus) - 1)::double as label from orders""")
def _(t):
    return models.encode_target_labels(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus")[0].drop("o_orderstatus")


for _name, _key, _params in [("Ridge", "ridge", {}), ("Lasso", "lasso", {}), ("ElasticNet", "elasticnet", {}),
                             ("Decision Tree", "decision_tree_regressor", {}),
                             ("Random Forest", "random_forest_regressor", {"max_depth": 6}),
                             ("Extra Trees", "extra_trees_regressor", {"n_estimators": 5}),
                             ("Gradient Boosting", "gradient_boosting_regressor", {"n_estimators": 10}),
                             ("XGBoost", "xgboost_regressor", {"n_estimators": 10, "max_depth": 4}),
                             ("AdaBoost", "adaboost_regressor", {"n_estimators": 5}),
                             ("SVM", "svm_regressor", {})]:
    query(_key)(lambda t, n=_name, p=_params: fit_reg(t, n, p))

for _name, _key, _params, _label in [
        ("Logistic Regression", "logistic_regression", {}, "label"),
        ("Logistic Regression", "logistic_regression_binary", {}, "odd"),
        ("Decision Tree", "decision_tree_classifier", {}, "label"),
        ("Random Forest", "random_forest_classifier", {"max_depth": 6}, "label"),
        ("Extra Trees", "extra_trees_classifier", {"n_estimators": 5}, "label"),
        ("Gradient Boosting", "gradient_boosting_classifier", {"n_estimators": 5}, "odd"),
        ("Gradient Boosting", "gradient_boosting_multiclass", {"n_estimators": 3}, "label"),
        ("XGBoost", "xgboost_classifier", {"n_estimators": 5, "max_depth": 4}, "odd"),
        ("AdaBoost", "adaboost_classifier", {"n_estimators": 8}, "label"),
        ("SVM", "svm_classifier", {}, "label"), ("SVM", "svm_classifier_linear", {"kernel": "linear"}, "odd"),
        ("KNN", "knn_model", {}, "label")]:
    query(_key)(lambda t, n=_name, p=_params, y=_label: fit_cls(t, n, p, y))


@query("train_many")
def _(t):
    df = split.split_random(orders_table(t), "o_orderkey")
    r = models.train_many(df.filter("split = 'train'"), df.filter("split = 'test'"), REG, "o_totalprice", "o_orderkey",
                          "regression", ["Linear Regression", "Ridge", "Decision Tree", "No Such Model"])
    return metrics.leaderboard(r.results(t.spark), "regression")


@query("multi_output")
def _(t):
    df = split.split_random(lineitem_table(t), "row")
    _, out = models.multi_output(df.filter("split = 'train'"), df.filter("split = 'test'"), ["l_discount", "l_tax", "l_linenumber"],
                                 ["l_extendedprice", "l_quantity"], "row", "regression", "Decision Tree", {"max_depth": 4})
    return metrics.multi_output_metrics(out, {x: (x, f"prediction_{x}") for x in ("l_extendedprice", "l_quantity")})


@query("penalised_optima", "select model, true as flat from (values ('Ridge'), ('Lasso'), ('ElasticNet'), ('Logistic Regression')) v(model)")
def _(t):
    """The slope of each model's objective vanishes at its coefficients (for absolute penalties: stays within them)."""
    df = models.assemble(t.lineitem.select(*LI, "l_extendedprice", (F.col("l_quantity") * 0.02 + F.col("l_discount") * 3 + F.col("l_linenumber") % 2 > 0.9).cast("int").alias("big")),
                         LI, "l_extendedprice")
    big = models.assemble(t.lineitem.select(*LI, (F.col("l_quantity") * 0.02 + F.col("l_discount") * 3 + F.col("l_linenumber") % 2 > 0.9).cast("int").alias("big")), LI, "big")
    n, rows = df.count(), []
    for name, data, params in (("Ridge", df, {"alpha": 5000.0}), ("Lasso", df, {"alpha": 20.0}), ("ElasticNet", df, {"alpha": 2.0, "l1_ratio": 0.5}),
                               ("Logistic Regression", big, {"C": 1.0})):
        m = models.make_estimator(name, "classification" if data is big else "regression", n, LI, 2, params).fit(data)
        w = [float(v) for v in m.coefficients]
        x = vector_to_array("features")
        told = sum((x[i] * v for i, v in enumerate(w)), F.lit(float(m.intercept)))
        off = F.col("label") - (1 / (1 + F.exp(-told)) if data is big else told)
        sums = data.agg(F.sum(off), *[F.sum(off * x[i]) for i in range(len(LI))], *[F.sum(F.abs(off * x[i])) for i in range(len(LI))]).first()
        flat = abs(sums[0]) / n < 1e-3 * (1 + abs(m.intercept))
        for i, v in enumerate(w):
            slope, size = sums[1 + i], sums[1 + len(LI) + i]
            mix = {"Ridge": 0.0, "Logistic Regression": 0.0, "Lasso": 1.0, "ElasticNet": 0.5}[name]
            alpha = params.get("alpha", 1.0) * (1 if name == "Ridge" else n) if data is df else 1.0 / params["C"]
            rest = slope - alpha * (1 - mix) * v
            bound = alpha * mix
            gap = abs(rest - math.copysign(bound, v)) if v and bound else max(0.0, abs(rest) - bound)
            flat = flat and gap < 1e-3 * size
        rows.append((name, bool(flat)))
    return t.spark.createDataFrame(rows, "model string, flat boolean")
