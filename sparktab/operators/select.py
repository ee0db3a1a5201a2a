"""Feature selection by variance and by correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktab.functions.aggregate import wide_agg
from sparktab.functions.columns import dbl, numeric_columns
from sparktab.operators.base import Fitted, Step
from sparktab.operators.profile import correlation_pairs


class FeatureSelector(Step):
    """Drop variance <= 0.01, then drop columns correlated above 0.95 with any earlier one."""

    defaults = {"min_variance": 0.01, "max_correlation": 0.95, "columns": None, "exclude": [],
                "steps": ["variance", "correlation"]}

    def learn(self, df):
        cols = self["columns"] if self["columns"] is not None else numeric_columns(df, self["exclude"])
        flat, twins = [], []
        if "variance" in self["steps"]:
            var = wide_agg(df, {x: F.var_pop(dbl(x)) for x in cols})
            flat = [x for x in cols if var[x] is not None and var[x] <= self["min_variance"]]
        rest = [x for x in cols if x not in flat]
        if "correlation" in self["steps"] and len(rest) > 1:
            high = correlation_pairs(df, rest, self["max_correlation"]).filter("is_high").select("right").distinct()
            found = {r[0] for r in high.collect()}  # names of columns
            twins = [b for b in rest if b in found]
        return FeatureSelectorModel(low_variance=flat, high_correlation=twins)


class FeatureSelectorModel(Fitted):
    defaults = {"low_variance": [], "high_correlation": []}

    def apply(self, df):
        return df.drop(*self["low_variance"], *self["high_correlation"])

    def dropped(self, spark) -> DataFrame:
        rows = [(x, "low_variance") for x in self["low_variance"]]
        rows += [(x, "high_correlation") for x in self["high_correlation"]]
        return spark.createDataFrame(rows, "feature string, reason string")

    def log(self):
        a, b = self["low_variance"], self["high_correlation"]
        return [("Flat columns", f"left out: {a}" if a else "none", "variance",
                 "applied" if a else "skipped"),
                ("Twin columns", f"left out: {b}" if b else "none", "correlation",
                 "applied" if b else "skipped")]
