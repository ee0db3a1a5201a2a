"""Advice from rules and past experiments: row-wise expressions; matching of tables is in `match`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktab.functions.columns import c
from sparktab.operators import match

# fixed values: rules of the knowledge base as (condition, models, reason)
RULES = [
    ("total_rows < 100", ["Linear Regression", "Lasso", "Ridge"], "very small data: simple linear models"),
    ("total_rows < 1000", ["Linear Regression", "Random Forest", "Ridge"], "small data: simple models"),
    ("total_rows > 5000 and total_columns > 10", ["XGBoost", "LightGBM", "CatBoost"], "tree ensembles do best"),
    ("total_rows > 10000", ["XGBoost", "LightGBM"], "boosting scales better than forests"),
    ("total_rows > 100000", ["LightGBM", "XGBoost"], "large data: fast boosting"),
    ("task_type = 'classification'", ["Random Forest", "XGBoost", "Logistic Regression", "SVM"], "categorical target"),
    ("task_type = 'classification' and min_share < 0.10", ["XGBoost", "Random Forest"], "severe class imbalance: use class weights"),
    ("max_cardinality > 50", ["CatBoost", "LightGBM"], "high-cardinality categories"),
    ("has_outliers", ["Random Forest", "XGBoost"], "outliers: robust scaling and tree models"),
    ("is_time_series", ["ARIMA", "SARIMAX", "Prophet", "XGBoost"], "time series: forecasting models"),
    ("is_time_series and span_days > 365", ["XGBoost"], "over one year of data: validate on the newest"),
]
# fixed values: choices when no rule gives a supported name
DEFAULT_SERIES = ["Prophet", "XGBoost", "Random Forest"]
DEFAULT_REGRESSION = ["XGBoost", "Random Forest", "Linear Regression"]
DEFAULT = ["XGBoost", "Random Forest"]


def rule_advice(profiles: DataFrame, key: str, supported: list[str]) -> DataFrame:
    """(key, model, reasons) for any number of dataset profiles.

    The rules are a fixed list, so every profile is judged by expressions in
    one narrow pass; names outside `supported` are left out.
    """
    hits = []
    for cond, names, reason in RULES:
        known = [n for n in names if n in supported]
        if known:
            hits.append(F.when(F.expr(cond), F.array(*[F.struct(F.lit(n).alias("model"), F.lit(reason).alias("reason"))
                                                       for n in known])))

    def fall(names):
        use = [n for n in names if n in supported] or supported[:3]
        return F.array(*[F.struct(F.lit(n).alias("model"), F.lit("default").alias("reason")) for n in use])

    found = F.flatten(F.array_compact(F.array(*hits)))
    default = F.when(F.col("is_time_series"), fall(DEFAULT_SERIES)).when(
        F.col("task_type") == "regression", fall(DEFAULT_REGRESSION)).otherwise(fall(DEFAULT))
    picked = F.when(F.size(found) > 0, found).otherwise(default)
    # group the few hits of a profile by model inside the row
    names = F.array_distinct(F.transform("_p", lambda s: s["model"]))
    return (profiles.withColumn("_p", picked).withColumn("model", F.explode(names))
            .select(c(key), "model", F.transform(F.filter("_p", lambda s: s["model"] == F.col("model")),
                                                 lambda s: s["reason"]).alias("reasons")))


def similar_experiments(experiments: DataFrame, stats: dict) -> DataFrame:
    """Finished runs of the same task with rows within 50 % or columns within 30 % of `stats`."""
    rows, cols = F.col("profile_summary.total_rows"), F.col("profile_summary.total_columns")
    near_rows = F.abs(rows - stats["total_rows"]) / max(stats["total_rows"], 1) < 0.5
    near_cols = F.abs(cols - stats["total_columns"]) / max(stats["total_columns"], 1) < 0.3
    return (experiments.filter(F.col("best_model").isNotNull() & (F.lower("task_type") == stats["task_type"].lower())
                               & (rows > 0) & (near_rows | near_cols))
            .select(F.col("dataset_name").alias("dataset"), "best_model", "best_score", rows.alias("total_rows"),
                    cols.alias("features")))


def match_names(df: DataFrame, column: str, known: list[str]) -> DataFrame:
    """match.match_names for known names given as a list, in its order; of any length."""
    spark = df.sparkSession
    table = spark.createDataFrame(list(enumerate(known)), "place bigint, name string")
    return match.match_names(df, column, table, "name", "place")


def matched_names(df: DataFrame, column: str, known: list[str]) -> DataFrame:
    """Distinct known names found in the column."""
    return match_names(df, column, known).filter("match is not null").select("match").distinct()
