"""Outlier caps, skew repair and calendar features as fitted steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktab.functions.aggregate import adjusted_skewness, exact_quantiles, wide_agg
from sparktab.functions.columns import c, date_formats, dbl, numeric_columns, read_time, string_columns, timestamp_columns
from sparktab.operators.base import Fitted, Step


class OutlierCapper(Step):
    """Clip to q1-1.5*IQR..q3+1.5*IQR ("iqr"), mean +- 3 std ("zscore") or percentiles ("winsor")."""

    defaults = {"method": "iqr", "columns": None, "exclude": [], "tails": [0.05, 0.95]}

    def learn(self, df):
        cols = self["columns"] or numeric_columns(df, self["exclude"])
        bounds = {}
        if self["method"] == "zscore":
            s = wide_agg(df, {x: F.struct(F.avg(dbl(x)), F.stddev_samp(dbl(x))) for x in cols})
            bounds = {x: (m - 3 * d, m + 3 * d) for x, (m, d) in s.items() if d is not None}
        elif self["method"] == "winsor":
            q = exact_quantiles(df, {x: self["tails"] for x in cols})
            bounds = {x: tuple(v) for x, v in q.items() if v[0] is not None}
        else:
            q = exact_quantiles(df, {x: [0.25, 0.75] for x in cols})
            bounds = {x: (a - 1.5 * (b - a), b + 1.5 * (b - a)) for x, (a, b) in q.items()
                      if a is not None}
        outside = wide_agg(df, {x: F.count_if((dbl(x) < lo) | (dbl(x) > hi))
                                for x, (lo, hi) in bounds.items()})
        caps = {x: [*bounds[x], outside[x]] for x in bounds if outside[x] > 0}
        return OutlierCapperModel(caps=caps)


class OutlierCapperModel(Fitted):
    defaults = {"caps": {}}

    def apply(self, df):
        out = {}
        for x, (lo, hi, _) in self["caps"].items():
            if x in df.columns:
                v = dbl(x)
                out[x] = F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(hi)), F.lit(lo)))
        return df.withColumns(out)

    def log(self):
        if not self["caps"]:
            return [("Outliers", "nothing to cap", "every value lies inside the limits", "skipped")]
        return [("Outliers", f"cap {x}", f"{n} values brought into {lo:.2f} to {hi:.2f}", "applied")
                for x, (lo, hi, n) in self["caps"].items()]


class SkewFixer(Step):
    """log1p when every row is above zero, sqrt when zeros occur; columns with nulls stay."""

    defaults = {"threshold": 1.0, "columns": None, "exclude": []}

    def learn(self, df):
        cols = self["columns"] or numeric_columns(df, self["exclude"])
        s = wide_agg(df, {x: F.struct(adjusted_skewness(dbl(x)), F.min(dbl(x)),
                                      F.count(dbl(x)) == F.count(F.lit(1))) for x in cols})
        kinds, skews = {}, {}
        for x, (skew, low, full) in s.items():
            if skew is not None and abs(skew) > self["threshold"] and full and low >= 0:
                kinds[x] = "log1p" if low > 0 else "sqrt"
                skews[x] = skew
        return SkewFixerModel(kinds=kinds, skews=skews)


class SkewFixerModel(Fitted):
    defaults = {"kinds": {}, "skews": {}}

    def apply(self, df):
        # new data may go below the fitted range: null there, as the function is undefined
        return df.withColumns({
            x: (F.when(dbl(x) > -1, F.log1p(dbl(x))) if k == "log1p" else F.when(dbl(x) >= 0, F.sqrt(dbl(x))))
            for x, k in self["kinds"].items() if x in df.columns})

    def log(self):
        return [("Skew", f"{k} of {x}", f"skew before: {self['skews'][x]:.2f}", "applied")
                for x, k in self["kinds"].items()]


class DatetimeExpander(Step):
    """year, month, day, dayofweek (Monday = 0) and hour; the source column goes.

    A text column is a date if one of DATE_FORMATS reads more than `share` of its rows; that format is kept for new data.
    """

    defaults = {"share": 0.8, "exclude": []}

    def learn(self, df):
        rows = df.count()
        found = date_formats(df, string_columns(df, self["exclude"]))
        formats = {x: how for x, (how, n) in found.items() if n > rows * self["share"]}
        return DatetimeExpanderModel(columns=list(formats) + timestamp_columns(df, self["exclude"]), formats=formats)


class DatetimeExpanderModel(Fitted):
    defaults = {"columns": [], "formats": {}}

    def apply(self, df):
        for x in self["columns"]:
            if x not in df.columns:
                continue
            ts = read_time(c(x), self["formats"].get(x, "")) if x in string_columns(df) else c(x)
            df = df.withColumns({f"{x}_year": F.year(ts), f"{x}_month": F.month(ts),
                                 f"{x}_day": F.day(ts), f"{x}_dayofweek": F.weekday(ts),
                                 f"{x}_hour": F.coalesce(F.hour(ts), F.lit(0))}).drop(x)
        return df

    def log(self):
        return [("Dates", f"parts of {x}", "calendar parts in place of the date", "applied")
                for x in self["columns"]]
