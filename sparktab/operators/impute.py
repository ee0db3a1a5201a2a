"""Missing values: strategy per column from its null share, fitted fill values."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktab.functions.aggregate import exact_quantiles, wide_agg
from sparktab.functions.columns import c, dbl, numeric_columns, string_columns
from sparktab.operators.base import Fitted, Step
from sparktab.operators.profile import categorical_profile

DROP_ABOVE, MEDIAN_BELOW, MEAN_BELOW = 50.0, 5.0, 30.0  # per cent of nulls


def choose_strategy(null_pct: float, numeric: bool) -> str:
    if null_pct > DROP_ABOVE:
        return "drop"
    if not numeric:
        return "mode"
    return "knn" if MEDIAN_BELOW <= null_pct < MEAN_BELOW else "median"


class Imputer(Step):
    """`strategy` forces one way for all columns; None decides per column.

    "knn" on a single column has no other feature to measure distance by, so
    every known row is equally near and the fill is the mean. The form with
    other features is `neighbors.knn_impute`.
    """

    defaults = {"strategy": None, "columns": None, "exclude": []}

    def learn(self, df):
        nums = set(numeric_columns(df))
        cols = self["columns"] or [x for x in nums | set(string_columns(df)) if x not in self["exclude"]]
        cols = [x for x in df.columns if x in cols]
        known = wide_agg(df, {"*": F.count(F.lit(1)),
                              **{x: F.count(dbl(x) if x in nums else c(x)) for x in cols}})
        total = max(known["*"], 1)
        pct = {x: (total - known[x]) * 100.0 / total for x in cols if known[x] < total}
        plan = {x: self["strategy"] or choose_strategy(p, x in nums) for x, p in pct.items()}
        fills = {}
        med = [x for x, s in plan.items() if s == "median"]
        if med:
            fills |= {x: v[0] for x, v in exact_quantiles(df, {x: [0.5] for x in med}).items()}
        mean = [x for x, s in plan.items() if s == "knn"]
        fills |= wide_agg(df, {x: F.avg(dbl(x)) for x in mean})
        mode = [x for x, s in plan.items() if s == "mode"]
        if mode:
            tops = {r["column"]: r["top"] for r in categorical_profile(df, mode).collect()}
            fills |= {x: tops.get(x, "unknown") for x in mode}
        return ImputerModel(plan=plan, fills=fills, pct=pct, numeric=[x for x in plan if x in nums])


class ImputerModel(Fitted):
    defaults = {"plan": {}, "fills": {}, "pct": {}, "numeric": []}

    def apply(self, df):
        nums = set(self["numeric"])
        fill = {x: F.coalesce(dbl(x) if x in nums else c(x), F.lit(v))
                for x, v in self["fills"].items() if x in df.columns}
        return df.withColumns(fill).drop(*[x for x, s in self["plan"].items() if s == "drop"])

    def log(self):
        return [("Imputation", f"{s} for {x}", f"missing {self['pct'][x]:.1f} %", "applied")
                for x, s in self["plan"].items()]
