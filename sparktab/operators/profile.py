"""Profiling: wide aggregates over all columns, reshaped to one row per column or pair."""

from __future__ import annotations

import itertools
import math

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktab.functions.aggregate import (COMPILED, WIDTH, adjusted_skewness, exact_quantiles,
                                          gram_matrix, wide_agg)
from sparktab.functions.columns import (c, dbl, long_rows, micros, numeric_columns, rounded, spread,
                                        string_columns, timestamp_columns)
from sparktab.functions.order import SERIES_ROWS, null_safe_join, series_window
from sparktab.functions.staging import stage

CLASS_LIMIT = 10         # distinct values up to which a numeric target is a class
HIGH_CORRELATION = 0.95
IMBALANCE = 0.1
SEVERE_IMBALANCE = 0.05


def _long(df: DataFrame, structs: list[Column], width: int = 60) -> DataFrame:
    parts = []
    for s in range(0, len(structs), width):
        part = structs[s:s + width]
        one = df.agg(*[x.alias(f"r{i}") for i, x in enumerate(part)])
        parts.append(one.select(long_rows([F.col(f"r{i}") for i in range(len(part))])))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def basic_stats(df: DataFrame) -> DataFrame:
    """Rows, columns, types and the planner's size estimate in MB."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows", F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
        F.lit(round(int(str(size)) / 1024 / 1024, 2)).alias("size_mb"),
        F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(v)) for k, v in types.items()))
        .alias("column_types"))


def missing_profile(df: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    rows = [F.struct(F.lit(x).alias("column"), (n - F.count(c(x))).alias("nulls"),
                     rounded((n - F.count(c(x))) * 100.0 / n, 2).alias("null_pct"),
                     (F.round((n - F.count(c(x))) * 100.0 / n, 2) > 30).alias("high_missing"))
            for x in df.columns]
    return _long(df, rows)


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    rows = []
    for x in columns or numeric_columns(df):
        v = dbl(x)
        skew = rounded(adjusted_skewness(v))
        rows.append(F.struct(
            F.lit(x).alias("column"), rounded(F.avg(v)).alias("mean"),
            rounded(F.stddev_samp(v)).alias("std"), rounded(F.min(v)).alias("min"),
            rounded(F.max(v)).alias("max"), skew.alias("skewness"),
            (F.abs(skew) > 1).alias("is_skewed")))
    return _long(df, rows)


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of several columns in one shuffle of partial counts."""
    cells = F.explode(F.array(*[F.struct(F.lit(x).alias("column"), c(x).cast("string").alias("value"))
                                for x in columns]))
    return (df.select(cells.alias("e")).select("e.*").filter("value is not null")
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


def categorical_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    counts = value_counts(df, columns or string_columns(df))
    # smallest value on ties: order by count, then by the value backwards
    top = F.min_by("value", F.struct((-F.col("n")).alias("a"), F.col("value").alias("b")))
    return (counts.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"), top.alias("top"))
            .withColumn("cardinality", F.when(F.col("n_unique") > 100, "high")
                        .when(F.col("n_unique") > 10, "medium").otherwise("low")))


def correlation_pairs(df: DataFrame, columns: list[str] | None = None, high: float = HIGH_CORRELATION) -> DataFrame:
    """Pearson r per pair over rows where both are known, flagged above `high`; null where it isn't defined."""
    cols = columns or numeric_columns(df)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "left string, right string, r double, is_high boolean")
    if len(cols) * (len(cols) - 1) // 2 <= FEW_PAIRS:
        rows = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), _corr(a, b).alias("r"))
                for a, b in itertools.combinations(cols, 2)]
        pairs = _long(df, rows, WIDTH)
    else:
        pairs = masked_correlations(df, cols)
    return pairs.withColumn("is_high", F.abs("r") > high).withColumn("r", rounded(F.col("r")))


def _corr(a: str, b: str) -> Column:
    return F.nullif(F.corr(dbl(a), dbl(b)), F.lit(float("nan")))


FEW_PAIRS = 24  # up to which they are aggregates of one compiled pass
FLAT = 1e-12  # share of a column's squares below which its variance is rounding


def masked_correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """(left, right, r) of all pairs of many columns, each over the rows where both are known, in one pass.

    Each task multiplies matrices of its rows (values, squares and which are known) and sends one row per column: six sums
    for each of its partners. They are added up column by column as a stream, so no task or driver holds more than a column's sums, and the
    coefficients are worked out there. Values are taken relative to the means of the first rows, which only guards digits.
    """
    p = len(cols)
    src = df.select(*[dbl(x).alias(f"v{i}") for i, x in enumerate(cols)])
    near = src.limit(1000).agg(*[F.avg(x).alias(x) for x in src.columns]).first()
    shift = np.array([0.0 if v is None or not math.isfinite(v) else v for v in near])

    def products(batches):
        total = np.zeros((6, p, p))
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype("float64") for i in range(p)]) - shift
            known = ~np.isnan(x)
            x[~known] = 0.0
            m = known.astype("float64")
            square = x * x
            for i, (a, b) in enumerate(((m, m), (x, m), (m, x), (square, m), (m, square), (x, x))):
                total[i] += a.T @ b
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(p), pa.int32()), pa.array([total[:, i, :].ravel() for i in range(p)], pa.list_(pa.float64()))],
                                         names=["i", "s"])

    def told(i: int, s: np.ndarray) -> pa.RecordBatch:
        n, sx, sy, qx, qy, xy = s.reshape(6, p)[:, i + 1:]
        with np.errstate(all="ignore"):
            vx, vy = qx - sx * sx / n, qy - sy * sy / n
            r = (xy - sx * sy / n) / np.sqrt(vx * vy)
        r[~((n > 1) & (vx > FLAT * qx) & (vy > FLAT * qy) & np.isfinite(r))] = np.nan
        r = np.clip(r, -1, 1)
        return pa.RecordBatch.from_arrays([pa.array([cols[i]] * len(r), pa.string()), pa.array(cols[i + 1:], pa.string()), pa.array(r, from_pandas=True)],
                                          names=["left", "right", "r"])

    def added(batches):
        now, total = None, None
        for batch in batches:
            for i, s in zip(batch.column(0).to_pylist(), batch.column(1)):
                if i != now:
                    if now is not None:
                        yield told(now, total)
                    now, total = i, np.zeros(6 * p)
                total += s.values.to_numpy()
        if now is not None:
            yield told(now, total)

    sums = src.mapInArrow(products, "i int, s array<double>")
    return sums.repartition("i").sortWithinPartitions("i").mapInArrow(added, "left string, right string, r double")


def correlation_matrix(df: DataFrame, columns: list[str]) -> dict[tuple[str, str], float | None]:
    """Upper triangle as a result on the driver, for a report; `masked_correlations` keeps it on Spark."""
    return {(r["left"], r["right"]): _known(r["r"]) for r in masked_correlations(df, columns).collect()}


def _known(v):
    return None if v is None or math.isnan(v) else float(v)


def target_types(df: DataFrame, columns: list[str], limit: int = CLASS_LIMIT) -> dict[str, str]:
    """classification for text or at most `limit` distinct values, else regression."""
    text = set(string_columns(df))
    nums = [x for x in columns if x in df.columns and x not in text]
    near = wide_agg(df, {x: F.approx_count_distinct(c(x)) for x in nums})
    close = [x for x in nums if near[x] <= 4 * limit]  # only these are worth an exact count
    exact = wide_agg(df, {x: F.count_distinct(c(x)) for x in close}, width=20)
    out = {}
    for x in columns:
        if x not in df.columns:
            out[x] = "unknown"
        elif x in text or (x in exact and exact[x] <= limit):
            out[x] = "classification"
        else:
            out[x] = "regression"
    return out


def detect_target_type(df: DataFrame, target, limit: int = CLASS_LIMIT) -> str:
    if isinstance(target, (list, tuple)):
        target = target[0] if target else None
    return target_types(df, [target], limit)[target] if target else "unknown"


def class_balance(df: DataFrame, target: str) -> DataFrame:
    return df.filter(c(target).isNotNull()).groupBy(c(target).alias("class")).agg(F.count(F.lit(1)).alias("n"))


MAX_CLASSES = 10_000


def class_sizes(df: DataFrame, target: str) -> dict:
    """Rows per class on the driver; a target with more values than MAX_CLASSES is no class."""
    rows = df.groupBy(c(target)).count().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{target} has too many values for a class")
    return {r[0]: r[1] for r in rows}


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Share of each class, smallest share and the imbalance flag."""
    counts = class_balance(df, target)
    t = counts.agg(F.sum("n"), F.min("n"), F.count(F.lit(1))).first()
    total, least = float(t[0] or 1), float(t[1] or 0)
    return counts.select(
        "class", "n", F.round(F.col("n") / total, 6).alias("share"),
        F.round(F.lit(least) / total, 4).alias("min_share"),
        F.lit(t[2] >= 2 and least / total < IMBALANCE).alias("imbalanced"))


def imbalance_advice(df: DataFrame, target: str) -> DataFrame:
    counts = class_balance(df, target)
    one = counts.agg(F.sum("n").alias("total"), F.min("n").alias("m"), F.count(F.lit(1)).alias("classes"))
    ratio = F.col("m") / F.col("total")
    return one.select(
        "classes", F.round(ratio, 4).alias("min_share"),
        ((F.col("classes") >= 2) & (ratio < IMBALANCE)).alias("imbalanced"),
        F.when(F.col("classes") < 2, "skipped").when(ratio < SEVERE_IMBALANCE, "SMOTE + class_weight")
        .when(ratio < IMBALANCE, "class_weight").otherwise("balanced").alias("advice"))


def target_moments(df: DataFrame, target: str) -> DataFrame:
    v = dbl(target)
    return df.agg(rounded(F.avg(v), 2).alias("target_mean"), rounded(F.stddev_samp(v), 2).alias("target_std"),
                  rounded(F.skewness(v), 2).alias("target_skewness"))


def linearity(df: DataFrame, target: str, include_self: bool = False) -> DataFrame:
    """Mean absolute correlation of the numeric columns with the target."""
    cols = [x for x in numeric_columns(df) if include_self or x != target]
    one = df.agg(*[F.abs(_corr(x, target)).alias(f"r{i}") for i, x in enumerate(cols)])
    known = F.array_compact(F.array(*[F.col(f"r{i}") for i in range(len(cols))]))
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(known), F.lit(0))
    return one.select(rounded(mean).alias("mean_abs_r"),
                      F.when(mean > 0.5, "High").otherwise("Low").alias("linearity"))


def time_frequency(df: DataFrame, ts: str, tie: str, keys: list[str] | None = None, **kw) -> float | None:
    """Exact median gap in microseconds between rows in time order."""
    us = df.select(*[c(k) for k in keys or []], micros(c(ts)).alias("_us"), c(tie).alias("_tie"))
    gaps = series_window(us, keys or [], ["_us", "_tie"], 1, 0,
                         {"gap": lambda w: F.col("_us") - F.lag("_us").over(w)}, **kw)
    return exact_quantiles(stage(gaps.select("gap"), "gaps"), {"gap": [0.5]})["gap"][0]


# fixed values: response surface for the unit-root t statistic with a constant, from
# MacKinnon (1994), Approximate asymptotic distribution functions for unit-root tests
ADF_SMALL = [2.1659, 1.4412, 0.038269]
ADF_LARGE = [1.7339, 0.93202, -0.12745, -0.010368]
ADF_SPLIT, ADF_MIN, ADF_MAX = -1.61, -18.83, 2.74


def unit_root_p(t: float) -> float:
    if t > ADF_MAX:
        return 1.0
    if t < ADF_MIN:
        return 0.0
    z = sum(a * t ** i for i, a in enumerate(ADF_SMALL if t <= ADF_SPLIT else ADF_LARGE))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def adf_stationarity(df: DataFrame, value: str, order_by: list[str], max_lag: int | None = None, **kw) -> dict:
    """Augmented Dickey-Fuller test of one series, with a constant and AIC choice of the lag; of many: adf_by_series.

    Lags come from the ordered helper; the regressions for all lag counts are
    solved on the driver from one matrix of summed products.
    """
    base = wide_agg(df, {"n": F.count(dbl(value)), "m": F.avg(dbl(value))})
    n = base["n"]
    if n < 20:
        return {"verdict": "Unknown", "n": n, "lag": None, "statistic": None, "p_value": None}
    top = math.ceil(12 * (n / 100) ** 0.25) if max_lag is None else max_lag
    top = min(top, n // 2 - 2)
    src = df.filter(dbl(value).isNotNull()).select(
        *[c(o) for o in order_by], (dbl(value) - base["m"]).alias("_y"))
    lags = {f"_l{i}": (lambda w, i=i: F.lag("_y", i).over(w)) for i in range(1, top + 2)}
    ser = spread(series_window(src, [], order_by, top + 1, 0, lags, **kw))
    level = F.col("_l1")
    diffs = [F.col("_y") - level] + [F.col(f"_l{i}") - F.col(f"_l{i + 1}") for i in range(1, top + 1)]

    def gram(k: int) -> np.ndarray:
        x = [diffs[0], F.lit(1.0), level] + diffs[1:k + 1]
        ok = ser.filter(F.col(f"_l{k + 1}").isNotNull())
        return gram_matrix(ok.select(*[v.alias(f"x{i}") for i, v in enumerate(x)]))

    def solve(g: np.ndarray, k: int):
        p = k + 2
        a, b = g[1:p + 1, 1:p + 1], g[1:p + 1, 0]
        beta = np.linalg.solve(a, b)
        rss = float(g[0, 0] - beta @ b)
        m = g[1, 1]
        se = math.sqrt(rss / (m - p) * np.linalg.inv(a)[1, 1])
        aic = m * math.log(rss / m) + 2 * p
        return beta[1] / se, aic

    full = gram(top)
    best = min(range(top + 1), key=lambda k: solve(full, k)[1]) if max_lag is None else top
    t = solve(full if best == top else gram(best), best)[0]
    p = unit_root_p(t)
    return {"verdict": "Stationary" if p < 0.05 else "Non-Stationary", "n": n, "lag": best,
            "statistic": float(t), "p_value": p}


ADF_ROWS = 65_536  # rows whose lag products are formed at once


def adf_of(y: np.ndarray, max_lag: int | None = None) -> tuple:
    """(verdict, n, lag, statistic, p_value) of a series in order, by the same rules as adf_stationarity.

    The lag products of all lag counts are one matrix, summed over pieces of the series; the best lag's own sample only
    has some rows more at the start, which are added to it.
    """
    n = len(y)
    if n < 20:
        return "Unknown", n, None, None, None
    top = min(math.ceil(12 * (n / 100) ** 0.25) if max_lag is None else max_lag, n // 2 - 2)
    y = y - y.mean()
    dy = np.diff(y)

    def products(first: int, last: int, k: int) -> np.ndarray:
        """Over the steps first..last - 1: change, one, level before, k changes before."""
        x = np.column_stack([dy[first:last], np.ones(last - first), y[first:last], *[dy[first - i:last - i] for i in range(1, k + 1)]])
        return x.T @ x

    def solve(g: np.ndarray, k: int) -> tuple[float, float]:
        a, b, m = g[1:k + 3, 1:k + 3], g[1:k + 3, 0], g[1, 1]
        beta = np.linalg.lstsq(a, b, rcond=None)[0]
        rss = max(float(g[0, 0] - beta @ b), 0.0)
        with np.errstate(all="ignore"):
            t = beta[1] / np.sqrt(rss / (m - k - 2) * np.linalg.pinv(a)[1, 1])
            return float(t), float(m * np.log(rss / m) + 2 * (k + 2))

    full = sum(products(i, min(i + ADF_ROWS, n - 1), top) for i in range(top, n - 1, ADF_ROWS))
    best = min(range(top + 1), key=lambda k: solve(full, k)[1]) if max_lag is None else top
    whole = full[:best + 3, :best + 3] + (products(best, top, best) if best < top else 0)
    t = solve(whole, best)[0]
    if not math.isfinite(t):
        return "Unknown", n, best, None, None
    p = unit_root_p(t)
    return "Stationary" if p < 0.05 else "Non-Stationary", n, best, t, p


def adf_by_series(df: DataFrame, keys: list[str], value: str, order_by: list[str], max_lag: int | None = None,
                  limit: int = SERIES_ROWS) -> DataFrame:
    """(keys, verdict, n, lag, statistic, p_value), one row per series: the unit-root test of each.

    A series is sorted and solved in one task while it has at most `limit` rows. Longer ones, at most rows / limit of them, are
    tested one after another with their lag products summed over all tasks (adf_stationarity). A series without values is Unknown, as
    one of fewer than 20 or without any change.
    """
    rows = df.select(*[c(k) for k in keys], *[c(o).alias(f"_o{i}") for i, o in enumerate(order_by)], dbl(value).alias("_v"))
    sizes = stage(rows.groupBy(*[c(k) for k in keys]).agg(F.count("_v").alias("_n")), "adf-sizes")
    long = sizes.filter(F.col("_n") > limit).drop("_n")
    big = long.collect()
    told = "verdict string, n bigint, lag bigint, statistic double, p_value double"
    kind = T.StructType([*rows.select(*[c(k) for k in keys]).schema.fields, *T.StructType.fromDDL(told).fields])

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        own = group.sort_values([f"_o{i}" for i in range(len(order_by))], kind="stable")["_v"].dropna().to_numpy(dtype="float64")
        return pd.DataFrame([(*key, *adf_of(own, max_lag))], columns=kind.names).astype({"lag": "Int64"})

    short = rows
    same = lambda r: reduce(and_, [c(k).eqNullSafe(F.lit(r[k])) for k in keys])
    if big:
        short = null_safe_join(rows, F.broadcast(long.withColumn("_long", F.lit(True))), keys).filter("_long is null").drop("_long")
    out = short.groupBy(*[c(k) for k in keys]).applyInPandas(one, kind)
    for r in big:
        got = adf_stationarity(df.filter(same(r)), value, order_by, max_lag)
        row = (*[r[k] for k in keys], *[got[x] for x in ("verdict", "n", "lag", "statistic", "p_value")])
        out = out.unionByName(df.sparkSession.createDataFrame([row], kind))
    return out


def zscore_outlier_flags(df: DataFrame, columns: list[str], threshold: float = 3.0) -> dict[str, bool]:
    """Does any value lie more than `threshold` deviations from the mean?"""
    s = wide_agg(df, {x: F.struct(F.avg(dbl(x)), F.stddev_samp(dbl(x)), F.min(dbl(x)), F.max(dbl(x)))
                      for x in columns})
    out = {}
    for x in columns:
        mean, std, lo, hi = s[x]
        out[x] = bool(std) and max(hi - mean, mean - lo) / std > threshold
    return out


def heavy_outlier_shares(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Share of rows beyond three interquartile ranges of the quartiles."""
    q = exact_quantiles(df, {x: [0.25, 0.75] for x in columns})
    stats = {"*": F.count(F.lit(1))}
    for x in columns:
        lo, hi = q[x]
        if lo is not None:
            stats[x] = F.count_if((dbl(x) < lo - 3 * (hi - lo)) | (dbl(x) > hi + 3 * (hi - lo)))
    got = wide_agg(df, stats)
    return {x: got.get(x, 0) / max(got["*"], 1) for x in columns}


def histogram(df: DataFrame, columns: list[str] | None = None, target: str | None = None,
              bins: int = 30, most: int | None = None) -> DataFrame:
    """Equal-width bins between min and max of the numeric columns; `most` keeps the first ones only."""
    cols = columns or numeric_columns(df, exclude=[target] if target else [])[:most]
    span = wide_agg(df, {x: F.struct(F.min(dbl(x)), F.max(dbl(x))) for x in cols})
    cells = []
    for x in cols:
        lo, hi = span[x]
        if lo is None:
            continue
        width = (hi - lo) or 1.0
        cells.append(F.struct(F.lit(x).alias("column"),
                              F.least(F.floor((dbl(x) - lo) / width * bins), F.lit(bins - 1)).alias("bin")))
    return (df.select(F.explode(F.array(*cells)).alias("e")).select("e.*").filter("bin is not null")
            .groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n")))


def full_profile(df: DataFrame, target: str | None = None) -> dict:
    """All profile results of one table as driver values: aggregates of COMPILED statistics each and one grouped count."""
    nums, text = numeric_columns(df), string_columns(df)
    stats: dict = {"*": F.count(F.lit(1)), **{(x, "known"): F.count(c(x)) for x in df.columns}}
    for x in nums:
        v = dbl(x)
        stats |= {(x, "mean"): F.avg(v), (x, "std"): F.stddev_samp(v), (x, "min"): F.min(v), (x, "max"): F.max(v),
                  (x, "skewness"): adjusted_skewness(v)}
    pairs = list(itertools.combinations(nums, 2))
    one_pass = len(pairs) <= 400
    if one_pass:
        stats |= {("r", a, b): _corr(a, b) for a, b in pairs}
    got = wide_agg(df, stats, COMPILED)
    n = got["*"]

    def short(v, digits=4):
        return None if v is None else round(float(v), digits)

    out = {"basic_stats": {"total_rows": n, "total_columns": len(df.columns),
                           "column_types": {f.name: f.dataType.simpleString() for f in df.schema}},
           "missing_values": {x: round((n - got[x, "known"]) * 100.0 / max(n, 1), 2) for x in df.columns},
           "numeric_stats": {x: {m: short(got[x, m]) for m in ("mean", "std", "min", "max", "skewness")} for x in nums},
           "categorical_stats": {}, "correlation": {}}
    if text:
        out["categorical_stats"] = {r["column"]: r.asDict() for r in categorical_profile(df).collect()}
    if len(nums) > 1:
        out["correlation"] = ({(a, b): _known(got["r", a, b]) for a, b in pairs} if one_pass
                              else correlation_matrix(df, nums))
    if target:
        out["task_type"] = detect_target_type(df, target)
        if out["task_type"] == "classification":
            out["class_imbalance"] = imbalance_advice(df, target).first().asDict()
    return out


def full_profile_long(df: DataFrame, target: str) -> DataFrame:
    """(section, column, metric, value) rows: one wide aggregate and grouped counts."""
    def section(name, part, cols):
        cells = F.array(*[F.struct(F.lit(m).alias("metric"), c(m).cast("double").alias("value"))
                          for m in cols])
        return part.select(F.lit(name).alias("section"), F.col("column"), F.inline(cells))
    dist = class_distribution(df, target).withColumn("column", F.col("class").cast("string"))
    return (section("missing", missing_profile(df), ["nulls", "null_pct"])
            .unionByName(section("numeric", numeric_profile(df), ["mean", "std", "min", "max", "skewness"]))
            .unionByName(section("categorical", categorical_profile(df), ["n_unique"]))
            .unionByName(section("class", dist, ["n", "share"])))


def dataset_analysis(df: DataFrame, target: str, ts: str | None = None, tie: str | None = None,
                     limit: int = CLASS_LIMIT) -> DataFrame:
    """One row describing a table for the advisor."""
    nums, cats = numeric_columns(df), string_columns(df)
    dates = timestamp_columns(df)
    base = wide_agg(df, {"rows": F.count(F.lit(1)), **{x: F.count(c(x)) for x in df.columns}})
    missing = sum(base["rows"] - base[x] for x in df.columns)
    task = detect_target_type(df, target, limit)
    ts = ts or (dates[0] if dates else None)
    gap = time_frequency(df, ts, tie or ts) if ts else None
    mom = lin = adf = None
    if task == "regression":
        mom, lin = target_moments(df, target).first(), linearity(df, target).first()
        if ts:
            adf = adf_stationarity(df, target, [ts] + ([tie] if tie else []))["verdict"]
    row = (base["rows"], len(df.columns), missing, nums, cats, dates, bool(ts),
           None if gap is None else int(gap), task, mom and mom[0], mom and mom[1], mom and mom[2],
           lin and lin[1], adf)
    return df.sparkSession.createDataFrame([row], (
        "total_rows bigint, total_columns int, missing_values bigint, numerical_columns array<string>,"
        " categorical_columns array<string>, datetime_columns array<string>, is_time_series boolean,"
        " time_gap_us bigint, task_type string, target_mean double, target_std double,"
        " target_skewness double, linearity string, stationarity string"))
