"""Time series: lags, rolling statistics, fills, sequences and forecasts per series."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktab.functions.aggregate import wide_agg
from sparktab.functions.columns import c, dbl, micros
from sparktab.functions.order import fill_series, lookup_series, null_safe_join, series_window
from sparktab.functions.staging import stage


def lag_features(df, keys, order_by, value, lags=(1, 5, 10), **kw) -> DataFrame:
    return series_window(df, keys, order_by, max(lags), 0, {
        f"{value}_lag_{n}": (lambda w, n=n: F.lag(c(value), n).over(w)) for n in lags}, **kw)


def rolling_stats(df, keys, order_by, value, size=7, **kw) -> DataFrame:
    """Mean and sample deviation of the last `size` rows, the current one included."""
    return series_window(df, keys, order_by, size - 1, 0, {
        f"{value}_mean_{size}": lambda w: F.avg(dbl(value)).over(w.rowsBetween(1 - size, 0)),
        f"{value}_std_{size}": lambda w: F.stddev_samp(dbl(value)).over(w.rowsBetween(1 - size, 0))}, **kw)


def differencing(df, keys, order_by, value, lag=1, **kw) -> DataFrame:
    return series_window(df, keys, order_by, lag, 0, {
        f"{value}_diff_{lag}": lambda w: c(value) - F.lag(c(value), lag).over(w)}, **kw)


def seasonal_differencing(df, keys, order_by, value, season=12, **kw) -> DataFrame:
    """(y[t] - y[t-1]) - (y[t-s] - y[t-s-1])"""
    return series_window(df, keys, order_by, season + 1, 0, {
        f"{value}_sdiff": lambda w: (c(value) - F.lag(c(value), 1).over(w))
        - (F.lag(c(value), season).over(w) - F.lag(c(value), season + 1).over(w))}, **kw)


def fourier_features(df, ts, period_us, order=2, prefix="season") -> DataFrame:
    phase = F.lit(2 * math.pi) * (micros(c(ts)) % period_us) / F.lit(float(period_us))
    return df.withColumns({f"{prefix}_{f}{k}": fn(phase * k) for k in range(1, order + 1)
                           for f, fn in (("sin", F.sin), ("cos", F.cos))})


def forward_fill(df, keys, order_by, value, name=None, **kw) -> DataFrame:
    return fill_series(df, keys, order_by, forward={name or value + "_ffill": value}, **kw)


def backward_fill(df, keys, order_by, value, name=None, **kw) -> DataFrame:
    return fill_series(df, keys, order_by, backward={name or value + "_bfill": value}, **kw)


def interpolate_linear(df, keys, order_by, value, time, name=None, **kw) -> DataFrame:
    """Between the known neighbours by time; null before the first and after the last."""
    cols = df.columns
    t = time if not isinstance(df.schema[time].dataType, (T.TimestampType, T.TimestampNTZType)) else None
    df = df.withColumn("_t", c(t).cast("double") if t else micros(c(time)).cast("double"))
    df = df.withColumn("_at", F.when(dbl(value).isNotNull(), F.struct(F.col("_t").alias("t"), dbl(value).alias("v"))))
    df = fill_series(df, keys, order_by, {"_a": "_at"}, {"_b": "_at"}, **kw)
    share = (F.col("_t") - F.col("_a.t")) / F.nullif(F.col("_b.t") - F.col("_a.t"), F.lit(0.0))
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * share
    edge = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.coalesce(line, F.col("_a.v")))
    return df.withColumn(name or value + "_interp", F.coalesce(dbl(value), edge)).select(
        *[c(x) for x in cols], c(name or value + "_interp"))


def moving_average(df, keys, order_by, value, half=2, **kw) -> DataFrame:
    return series_window(df, keys, order_by, half, half, {
        f"{value}_ma": lambda w: F.avg(dbl(value)).over(w.rowsBetween(-half, half))}, **kw)


def median_filter(df, keys, order_by, value, half=2, **kw) -> DataFrame:
    return series_window(df, keys, order_by, half, half, {
        f"{value}_median": lambda w: F.percentile(dbl(value), 0.5).over(w.rowsBetween(-half, half))}, **kw)


def interaction_feature(df, a, b, name="power") -> DataFrame:
    return df if name in df.columns else df.withColumn(name, c(a) * c(b))


def id_column_flags(df, columns, limit=50) -> DataFrame:
    """Text or integer columns with more than `limit` distinct values, and their share of rows."""
    s = wide_agg(df, {"n": F.count(F.lit(1)), **{x: F.approx_count_distinct(c(x)) for x in columns}})
    low = [x for x in columns if s[x] <= 4 * limit]
    exact = wide_agg(df, {x: F.count_distinct(c(x)) for x in low}, width=20)
    rows = [(x, exact.get(x, s[x]) > limit) for x in columns]
    return df.sparkSession.createDataFrame(rows, "column string, is_id_like boolean")


def positive_class_weight(df, label, name="weight") -> DataFrame:
    """negatives / positives on positive rows, 1 on the others."""
    r = df.agg(F.count_if(c(label) == 0), F.count_if(c(label) == 1)).first()
    return df.withColumn(name, F.when(c(label) == 1, F.lit(r[0] / max(r[1], 1))).otherwise(F.lit(1.0)))


def lookback_sequences(df, keys, order_by, value, size=10, **kw) -> DataFrame:
    """The previous `size` values as an array, for rows that have that many."""
    out = series_window(df, keys, order_by, size, 0, {
        "sequence": lambda w: F.collect_list(dbl(value)).over(w.rowsBetween(-size, -1))}, **kw)
    return out.filter(F.size("sequence") == size)


def minmax_target(train: DataFrame, value: str) -> tuple[float, float]:
    """(minimum, range + 1e-8) of the training rows."""
    lo, hi = train.agg(F.min(dbl(value)), F.max(dbl(value))).first()
    return lo, hi - lo + 1e-8


def scale_target(df, value, lo, span, name=None) -> DataFrame:
    return df.withColumn(name or value, (dbl(value) - lo) / span)


def unscale_target(df, value, lo, span, name=None) -> DataFrame:
    return df.withColumn(name or value, dbl(value) * span + lo)


def grouped_gram(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per series the summed products of all column pairs, as one flat array.

    Tasks add up their rows first, so a long series costs one small matrix per
    task. With keys it is one aggregate of the pairs' sums, so many short series cost no more than their rows; null counts as NaN.
    Without keys each task adds up one matrix.
    """
    width = len(columns)
    if keys:
        value = lambda i: F.coalesce(c(f"_x{i}"), F.lit(float("nan")))
        src = df.select(*[c(k) for k in keys], *[c(x).cast("double").alias(f"_x{i}") for i, x in enumerate(columns)])
        src = src.select(*[c(k) for k in keys], *[value(i).alias(f"_x{i}") for i in range(width)])
        sums = src.groupBy(*[c(k) for k in keys]).agg(*[F.sum(c(f"_x{i}") * c(f"_x{j}")).alias(f"_p{i}_{j}") for i in range(width) for j in range(i, width)])
        return sums.select(*[c(k) for k in keys], F.array(*[c(f"_p{min(i, j)}_{max(i, j)}") for i in range(width) for j in range(width)]).alias("gram"))
    src = df.select(*[c(x).cast("double").alias(f"_x{i}") for i, x in enumerate(columns)])

    def partial(batches):
        total = None
        for rows in batches:
            m = rows.to_numpy()
            total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            yield pd.DataFrame({"i": np.arange(width * width, dtype="int32"), "v": total.ravel()})

    cells = src.mapInPandas(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    # a list of width*width cells
    return cells.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("gram"))


def _ridge(gram: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Coefficients of the last column on the others from summed products."""
    p = gram.shape[0] - 1
    return np.linalg.lstsq(gram[:p, :p] + np.diag(penalty), gram[:p, p], rcond=None)[0]


def _solved(grams: np.ndarray, penalty: float) -> np.ndarray:
    """Coefficients of the last column on the others, for a stack of summed products."""
    p = grams.shape[1] - 1
    inverse = np.linalg.pinv(grams[:, :p, :p] + penalty * np.eye(p), rcond=p * np.finfo(float).eps)
    return np.einsum("sij,sj->si", inverse, grams[:, :p, p])


def _steps(rows: pd.DataFrame, keys: list[str], paths: np.ndarray) -> pd.DataFrame:
    """One row per series and step."""
    out = rows.loc[rows.index.repeat(paths.shape[1]), keys].reset_index(drop=True)
    return out.assign(step=np.tile(np.arange(1, paths.shape[1] + 1, dtype="int32"), len(rows)), forecast=paths.ravel())[[*keys, "step", "forecast"]]


def arma_fit(df: DataFrame, keys: list[str], order_by: list[str], value: str, p: int = 1, q: int = 1, d: int = 1, long: int = 20,
             constant: bool = False, **kw) -> DataFrame:
    """ARIMA(p, d, q) of every series by two regressions: keys, level, phi, theta, past, shocks, last.

    First a long autoregression of the d times differenced values gives each row its shock (what it could not tell); then the
    values are regressed on their own p lags and on q lagged shocks. Both are solved from summed products per series, so a series of any
    length is spread over tasks. `past` and `shocks` are the latest differenced values and shocks, newest first, `last` the latest levels of each
    order of difference: what a forecast starts from. A gap keeps out the rows that reach over it; a series that is too short
    or ends in one has null coefficients.
    """
    reach = long + q
    lagged = {f"_y{i}": (lambda w, i=i: F.lag(dbl(value), i).over(w)) for i in range(1, reach + d + 1)}
    wide = series_window(df, keys, order_by, reach + d, 0, lagged, **kw).withColumn("_y0", dbl(value))

    def differenced(i: int, times: int):
        return reduce(add, [F.lit(float((-1) ** j * math.comb(times, j))) * F.col(f"_y{i + j}") for j in range(times + 1)])

    by = [c(k) for k in keys]
    zs = [differenced(i, d) for i in range(reach + 1)]
    rows = stage(wide.select(*by, F.struct(*[c(o) for o in order_by]).alias("_o"), F.array(*zs).alias("_z"),
                             F.array(*[differenced(0, i) for i in range(d)] or [F.lit(None).cast("double")]).alias("_last")), "arma-rows")
    known = rows.filter(F.forall("_z", lambda v: v.isNotNull()))
    one = [F.lit(1.0).alias("_one")] if constant else []
    z = lambda i: F.get("_z", F.lit(i))

    def coefficients(src: DataFrame, parts: list, name: str) -> DataFrame:
        names = [*(["_one"] if constant else []), *[f"_x{i}" for i in range(len(parts))]]
        gram = grouped_gram(src.select(*by, *one, *[x.alias(f"_x{i}") for i, x in enumerate(parts)]), keys, names)
        size = len(names)
        kind = T.StructType([*[gram.schema[k] for k in keys], T.StructField(name, T.ArrayType(T.DoubleType()))])

        def run(batches):
            for b in batches:
                if len(b):
                    beta = _solved(np.stack(b["gram"].to_numpy()).reshape(len(b), size, size), 1e-10)
                    yield b[keys].assign(**{name: list(beta)})

        return stage(gram.mapInPandas(run, kind), name.strip("_"))

    def told(src: DataFrame, table: DataFrame, name: str) -> DataFrame:
        if keys:
            return lookup_series(src, table, keys)
        first = table.first()
        return src.withColumn(name, F.lit(None).cast("array<double>") if first is None else F.array(*[F.lit(float(v)) for v in first[name]]))

    off = 1 if constant else 0
    ahead = coefficients(known, [*[z(i) for i in range(1, long + 1)], z(0)], "_long")

    def shock(i: int):
        guess = [F.get("_long", F.lit(off + j - 1)) * z(i + j) for j in range(1, long + 1)]
        return z(i) - reduce(add, guess + ([F.get("_long", F.lit(0))] if constant else []))

    shocked = told(known, ahead, "_long").withColumn("_e", F.array(*[shock(i) for i in range(q + 1)]))
    e = lambda i: F.get("_e", F.lit(i))
    short = coefficients(shocked, [*[z(i) for i in range(1, p + 1)], *[e(i) for i in range(1, q + 1)], z(0)], "_short")
    last = told(rows, ahead, "_long").withColumn("_e", F.array(*[shock(i) for i in range(max(q, 1))]))
    last = last.groupBy(*by).agg(F.max_by(F.struct("_z", "_e", "_last"), "_o").alias("_s"))
    last = told(last, short, "_short")
    return last.select(*by, (F.get("_short", F.lit(0)) if constant else F.when(F.col("_short").isNotNull(), F.lit(0.0))).alias("level"),
                       F.slice("_short", off + 1, p).alias("phi") if p else F.array().cast("array<double>").alias("phi"),
                       F.slice("_short", off + p + 1, q).alias("theta") if q else F.array().cast("array<double>").alias("theta"),
                       F.slice("_s._z", 1, max(p, 1)).alias("past"), F.slice("_s._e", 1, max(q, 1)).alias("shocks"), F.col("_s._last").alias("last"))


def arma_forecast(fit: DataFrame, keys: list[str], horizon: int, d: int = 1) -> DataFrame:
    """(keys, step, forecast) from arma_fit; null for series without coefficients or that end in a gap."""
    schema = T.StructType([*[fit.schema[k] for k in keys], T.StructField("step", T.IntegerType()), T.StructField("forecast", T.DoubleType())])
    whole = lambda x: F.coalesce(F.forall(x, lambda v: v.isNotNull()), F.lit(False))
    can = F.col("level").isNotNull() & whole("past") & whole("shocks") & (whole("last") if d else F.lit(True))

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            at = {x: np.stack(b[x].to_numpy()).astype("float64") for x in ("phi", "theta", "past", "shocks", "last")}
            past, shocks, last, paths = at["past"], at["shocks"], at["last"], []
            for _ in range(horizon):
                now = b["level"].to_numpy() + (at["phi"] * past[:, :at["phi"].shape[1]]).sum(1) + (at["theta"] * shocks[:, :at["theta"].shape[1]]).sum(1)
                past = np.column_stack([now, past[:, :-1]])
                shocks = np.column_stack([np.zeros(len(b)), shocks[:, :-1]])
                for i in range(d - 1, -1, -1):  # from the difference back to the level
                    now = last[:, i] + now
                    last[:, i] = now
                paths.append(now)
            yield _steps(b, keys, np.column_stack(paths))

    return fit.filter(can).mapInPandas(run, schema).unionByName(_no_forecast(fit.filter(~can), keys, horizon))


def _walk(beta: list[float], tail: list[float], lags: tuple[int, ...], season: int, horizon: int) -> list[float]:
    """Forecasts of one series, step by step, from its last values (oldest first), differenced once and at `season`."""
    y = list(tail)
    for _ in range(horizon):
        step = 0.0
        for b, i in zip(beta[1:], lags):
            d = y[-i] - y[-i - 1]
            step += b * (d - (y[-i - season] - y[-i - season - 1]) if season else d)
        y.append(y[-1] + (y[-season] - y[-season - 1] if season else 0.0) + (beta[0] + step))
    return y[len(tail):]


def ar_forecast(df: DataFrame, keys: list[str], order_by: list[str], value: str, horizon: int,
                lags: tuple[int, ...] = (1, 2, 3, 4, 5), season: int = 0, **kw) -> DataFrame:
    """Difference once (and at `season`), regress on its own lags, forecast step by step.

    Stands in for ARIMA(1,1,1), and with season=12 for its seasonal form: a
    longer autoregression takes the place of the moving-average term. The fit is by
    least squares on summed products, and only the last few values of
    each series meet the coefficients.
    """
    depth = max(lags)
    reach = depth + 1 + season
    lagged = {f"_y{i}": (lambda w, i=i: F.lag(dbl(value), i).over(w)) for i in range(1, reach + 1)}
    wide = series_window(df, keys, order_by, reach, 0, lagged, **kw).withColumn("_y0", dbl(value))

    def z(i):
        d = F.col(f"_y{i}") - F.col(f"_y{i + 1}")
        return d - (F.col(f"_y{i + season}") - F.col(f"_y{i + season + 1}")) if season else d

    order = F.struct(*[c(o) for o in order_by])
    tail = F.max_by(F.array(*[F.col(f"_y{i}") for i in range(reach + 1)]), order)
    last = wide.groupBy(*[c(k) for k in keys]).agg(tail.alias("tail"))
    known = F.forall(F.array(*[F.col(f"_y{i}") for i in range(reach + 1)]), lambda v: v.isNotNull())
    fit = wide.filter(known).select(  # a gap keeps out only the rows that reach over it
        *[c(k) for k in keys], F.lit(1.0).alias("_one"), *[z(i).alias(f"_z{i}") for i in lags], z(0).alias("_z0"))
    gram = grouped_gram(fit, keys, ["_one", *[f"_z{i}" for i in lags], "_z0"])
    both = null_safe_join(last, gram, keys) if keys else last.withColumn("_j", F.lit(1)).join(
        gram.withColumn("_j", F.lit(1)), "_j").drop("_j")
    size = len(lags) + 2
    schema = T.StructType([both.schema[k] for k in keys] + [T.StructField("step", T.IntegerType()),
                                                            T.StructField("forecast", T.DoubleType())])

    def run(batches):
        for rows in batches:
            if not len(rows):
                continue
            beta = _solved(np.stack(rows["gram"].to_numpy()).reshape(len(rows), size, size), 1e-8)
            y = np.stack(rows["tail"].to_numpy()).astype("float64")[:, ::-1]  # oldest first, a row per series
            if horizon > len(rows):  # few series, many steps: an array for each step would cost more than its sums
                yield _steps(rows, keys, np.array([_walk(b, t, lags, season, horizon) for b, t in zip(beta.tolist(), y.tolist())]))
                continue
            paths = []
            for _ in range(horizon):
                def zz(i):
                    d = y[:, -i] - y[:, -i - 1]
                    return d - (y[:, -i - season] - y[:, -i - season - 1]) if season else d
                step = beta[:, 0] + sum(beta[:, j + 1] * zz(i) for j, i in enumerate(lags))
                base = y[:, -1] + (y[:, -season] - y[:, -season - 1] if season else 0.0)
                y = np.column_stack([y[:, -(reach + 1):], base + step])
                paths.append(y[:, -1])
            yield _steps(rows, keys, np.column_stack(paths))

    can = F.coalesce(F.forall("tail", lambda v: v.isNotNull()), F.lit(False)) & F.col("gram").isNotNull()
    return both.filter(can).mapInPandas(run, schema).unionByName(_no_forecast(both.filter(~can), keys, horizon))


def _no_forecast(series: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """Null forecasts of series that are too short or end in a gap: every series has its rows."""
    return series.select(*[c(k) for k in keys], F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"),
                         F.lit(None).cast("double").alias("forecast"))


def recursive_forecast(df: DataFrame, keys: list[str], order_by: list[str], value: str, horizon: int,
                       lookback: int = 10, **kw) -> DataFrame:
    """Linear map from the last `lookback` scaled values to the next, fed back step by step."""
    lo, span = minmax_target(df, value)
    lagged = {f"_y{i}": (lambda w, i=i: F.lag("_y0", i).over(w)) for i in range(1, lookback + 1)}
    base = df.withColumn("_y0", (dbl(value) - lo) / span)
    wide = series_window(base, keys, order_by, lookback, 0, lagged, **kw)
    last = wide.groupBy(*[c(k) for k in keys]).agg(
        F.max_by(F.array(*[F.col(f"_y{i}") for i in range(lookback)]),
                 F.struct(*[c(o) for o in order_by])).alias("tail"))
    known = F.forall(F.array(*[F.col(f"_y{i}") for i in range(lookback + 1)]), lambda v: v.isNotNull())
    fit = wide.filter(known).withColumn("_one", F.lit(1.0))
    names = ["_one", *[f"_y{i}" for i in range(1, lookback + 1)], "_y0"]
    gram = grouped_gram(fit, [], names).first()["gram"]
    size = len(names)
    beta = _ridge(np.array(gram).reshape(size, size), np.full(size - 1, 1e-6))
    schema = T.StructType([last.schema[k] for k in keys] + [T.StructField("step", T.IntegerType()),
                                                            T.StructField("forecast", T.DoubleType())])

    def run(batches):
        for rows in batches:
            if len(rows) == 0:
                continue
            y = np.array(rows["tail"].tolist(), dtype="float64")
            for h in range(1, horizon + 1):
                nxt = beta[0] + y @ beta[1:]
                y = np.column_stack([nxt, y[:, :-1]])
                yield rows[keys].assign(step=np.int32(h), forecast=nxt * span + lo)

    can = F.coalesce(F.forall("tail", lambda v: v.isNotNull()), F.lit(False))
    return last.filter(can).mapInPandas(run, schema).unionByName(_no_forecast(last.filter(~can), keys, horizon))


DAY_US = 86_400_000_000


def _design(ts_us, start, end, hinges, periods, order):
    """Trend, hinges at even places in the first 80 % and Fourier terms, as expressions."""
    t = (ts_us.cast("double") - F.lit(float(start))) / F.lit(float(max(end - start, 1)))
    out = {"_one": F.lit(1.0), "_t": t}
    for i in range(1, hinges + 1):
        out[f"_hinge{i}"] = F.greatest(t - 0.8 * i / (hinges + 1), F.lit(0.0))
    for name, us in periods.items():
        phase = F.lit(2 * math.pi) * (ts_us % us) / F.lit(float(us))
        for k in range(1, order + 1):
            out[f"_{name}s{k}"], out[f"_{name}c{k}"] = F.sin(phase * k), F.cos(phase * k)
    return out


def trend_season_forecast(train: DataFrame, test: DataFrame, ts: str, value: str, keys: list[str] | None = None,
                          hinges: int = 10, periods: dict[str, int] | None = None, order: int = 3,
                          changepoint_scale: float = 0.05, season_scale: float = 10.0) -> DataFrame:
    """Piecewise-linear trend plus seasons by ridge regression, one fit per series.

    After the published additive forecasting model; the penalties play the part of its
    prior scales. Adds `forecast` to the test rows.
    """
    keys = keys or []
    periods = periods or {"day": DAY_US, "week": 7 * DAY_US}
    lo, hi = train.agg(F.min(micros(c(ts))), F.max(micros(c(ts)))).first()
    cols = _design(micros(c(ts)), lo, hi, hinges, periods, order)
    names = list(cols)
    fit = train.filter(dbl(value).isNotNull()).select(*[c(k) for k in keys], *[v.alias(n) for n, v in cols.items()],
                                                      dbl(value).alias("_y"))
    gram = grouped_gram(fit, keys, [*names, "_y"])
    size = len(names) + 1
    pen = np.array([1e-6 if n in ("_one", "_t") else (1 / changepoint_scale if n.startswith("_hinge") else 1 / season_scale)
                    for n in names])
    schema = T.StructType([gram.schema[k] for k in keys] + [T.StructField("_beta", T.ArrayType(T.DoubleType()))])

    def solve(batches):
        for rows in batches:
            if len(rows):
                yield rows[keys].assign(_beta=[_ridge(np.array(g).reshape(size, size), pen) for g in rows["gram"]])

    beta = gram.mapInPandas(solve, schema)
    if not keys:
        b = beta.first()["_beta"]
        line = sum((v * F.lit(float(b[i])) for i, v in enumerate(cols.values())), F.lit(0.0))
        return test.withColumn("forecast", line)
    out = lookup_series(test, beta, keys)
    line = sum((v * F.col("_beta")[i] for i, v in enumerate(cols.values())), F.lit(0.0))
    return out.withColumn("forecast", line).drop("_beta")
