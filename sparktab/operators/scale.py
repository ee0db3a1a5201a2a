"""Scalers with exact quantiles and population deviations, and their inverse."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktab.functions.aggregate import exact_quantiles, wide_agg
from sparktab.functions.columns import c, dbl, numeric_columns
from sparktab.operators.base import Fitted, Step
from sparktab.operators.profile import heavy_outlier_shares


def choose_scaler(shares: dict[str, float]) -> str:
    """robust when any column has more than 5 % far outliers."""
    return "robust" if any(v > 0.05 for v in shares.values()) else "standard"


class Scaler(Step):
    defaults = {"strategy": "auto", "columns": None, "exclude": []}

    def learn(self, df):
        cols = self["columns"] if self["columns"] is not None else numeric_columns(df, self["exclude"])
        kind = self["strategy"]
        if kind == "auto":
            kind = choose_scaler(heavy_outlier_shares(df, cols)) if cols else "standard"
        if kind == "robust":
            q = exact_quantiles(df, {x: [0.25, 0.5, 0.75] for x in cols})
            pairs = {x: (m, b - a) for x, (a, m, b) in q.items() if m is not None}
        elif kind == "minmax":
            s = wide_agg(df, {x: F.struct(F.min(dbl(x)), F.max(dbl(x))) for x in cols})
            pairs = {x: (lo, hi - lo) for x, (lo, hi) in s.items() if lo is not None}
        else:
            s = wide_agg(df, {x: F.struct(F.avg(dbl(x)), F.stddev_pop(dbl(x))) for x in cols})
            pairs = {x: (m, d) for x, (m, d) in s.items() if m is not None}
        return ScalerModel(kind=kind, center={x: p[0] for x, p in pairs.items()},
                           width={x: p[1] or 1.0 for x, p in pairs.items()})


class ScalerModel(Fitted):
    defaults = {"kind": "standard", "center": {}, "width": {}}

    def apply(self, df):
        return df.withColumns({x: (c(x).cast("double") - m) / self["width"][x]
                               for x, m in self["center"].items() if x in df.columns})

    def inverse(self, df):
        return df.withColumns({x: c(x) * self["width"][x] + m
                               for x, m in self["center"].items() if x in df.columns})

    def log(self):
        if not self["center"]:
            return [("Scale", "no number columns", "nothing to do", "skipped")]
        return [("Scale", f"{self['kind']} scaling of {len(self['center'])} columns",
                 "outliers found" if self["kind"] == "robust" else "no heavy outliers", "applied")]
