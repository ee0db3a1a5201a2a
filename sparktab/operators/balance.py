"""Class weights; synthetic minority rows are `neighbors.smote`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktab.functions.columns import c
from sparktab.functions.lookup import lookup
from sparktab.functions.staging import stage
from sparktab.operators.profile import class_sizes


def weights_by_class(df: DataFrame, target: str) -> dict:
    """n / (k * n_class)"""
    counts = class_sizes(df.filter(c(target).isNotNull()), target)
    total = sum(counts.values())
    return {k: total / (len(counts) * n) for k, n in counts.items()}


def class_weights(df: DataFrame, target: str, name: str = "weight") -> DataFrame:
    """Adds n / (k * n_class); null where the target is null. The weights are a table, whatever the number of classes."""
    counts = df.filter(c(target).isNotNull()).groupBy(c(target).alias("_class")).agg(F.count(F.lit(1)).alias("_n"))
    counts = stage(counts, "class-weights")
    total, classes = counts.agg(F.sum("_n"), F.count(F.lit(1))).first()
    weights = counts.select("_class", (F.lit(float(total or 0)) / (F.col("_n") * max(classes, 1))).alias(name), (F.col("_n") / max(total or 0, 1)).alias("_share"))
    return lookup(df, weights, target, [name], weight="_share", rows=classes, right_key="_class")
