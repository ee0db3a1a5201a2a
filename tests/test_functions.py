"""Quantiles, ordering and lookups: every path against plain computations, with hot groups."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktab.functions import lookup as lk
from sparktab.functions.aggregate import exact_quantiles, gram_matrix, select_ranks
from sparktab.functions.order import (fill_series, prefix_sums, series_index, series_window, with_position)
from sparktab.operators import split


def hot_series(spark, n=3000):
    """A third of all rows belong to one series; times repeat."""
    rng = np.random.default_rng(5)
    keys = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 40, n))
    rows = [(int(k), int(t), i, None if v < 0.4 else float(v)) for i, (k, t, v) in
            enumerate(zip(keys, rng.integers(0, 500, n), rng.random(n)))]
    return spark.createDataFrame(rows, "k int, t int, id int, v double")


@pytest.mark.parametrize("kind", ["normal", "hot", "heavy"])
def test_quantiles_by_radix_selection(spark, kind):
    rng = np.random.default_rng(1)
    x = rng.normal(size=20_000)
    if kind == "hot":
        x[:8000] = 0.25
    if kind == "heavy":
        x = np.exp(x * 20)
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.999, 1.0]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
    want = np.quantile(x, probs)
    assert np.allclose(exact_quantiles(df.repartition(5), {"x": probs})["x"], want, rtol=1e-9)


def test_quantiles_of_nothing(spark):
    assert exact_quantiles(spark.createDataFrame([(None,)], "x double"), {"x": [0.5]})["x"] == [None]


@pytest.mark.parametrize("kind", ["wide", "tiny", "longs"])
def test_ranks_of_any_values(spark, kind):
    rng = np.random.default_rng(9)
    if kind == "longs":
        x = np.unique(np.concatenate([rng.integers(-(1 << 63), (1 << 63) - 1, 400), np.arange(50), [(1 << 63) - 1, -(1 << 63)]])).tolist() + [7] * 30
        df = spark.createDataFrame([(int(v),) for v in x] + [(None,)], "x bigint")
    else:
        x = [0.0, -0.0, float("inf"), float("-inf"), 5e-324, -5e-324, 1.7e308, -1.7e308, 2.0 ** -1022] + [1.0] * 300
        x += (np.exp(rng.normal(size=400) * 150) * rng.choice([-1, 1], 400)).tolist() if kind == "wide" else (rng.integers(-99, 99, 300) * 5e-324).tolist()
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    want = sorted(x)
    ranks = sorted({0, 1, 5, len(x) // 3, len(x) // 2, len(x) - 2, len(x) - 1})
    got = select_ranks(df.repartition(4), {"x": F.col("x")}, lambda _, n: [*ranks, n, n + 5])
    assert {r for _, r in got} == set(ranks)
    for (_, r), p in got.items():
        assert p.value == want[r] and p.below == sum(v < want[r] for v in x) and p.ties == sum(v == want[r] for v in x)


def test_rank_passes_are_compiled(spark, monkeypatch):
    """No function that Spark runs per value outside its compiled code."""
    df = spark.range(5000).select((F.col("id") % 977 * 1.5).alias("x"), F.when(F.col("id") % 3 > 0, F.col("id") * 0.5).alias("y"))
    seen, plain = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: seen.append(self._jdf.queryExecution().executedPlan().toString()) or plain(self))
    got = exact_quantiles(df, {"x": [0.5], "y": [0.5]})
    assert seen and not any("lambda" in p for p in seen)
    assert got == {"x": [float(np.median(np.arange(5000) % 977 * 1.5))], "y": [float(np.median([i * 0.5 for i in range(5000) if i % 3]))]}


def test_key_hashes_are_worked_out_once_for_the_cuts(spark, monkeypatch):
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("y"))
    seen, plain = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: seen.append(self._jdf.queryExecution().executedPlan().toString()) or plain(self))
    out = split.split_stratified(df, "y", "id", 0.25)
    assert seen and not any("md5" in p for p in seen)
    assert sorted((r["y"], r["n"]) for r in out.filter("split = 'test'").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()) == [(0, 250), (1, 250), (2, 250)]


def test_no_quantile_meets_one_task(spark):
    """The picked parts alone reach the driver, and no aggregate without a key holds values."""
    df = spark.range(100_000).select((F.col("id") % 977 * 1.5).alias("x"))
    seen = []
    plain = type(df).collect
    try:
        type(df).collect = lambda self: seen.append((self._jdf.queryExecution().executedPlan().toString(), out := plain(self))) or out
        exact_quantiles(df, {"x": [0.25, 0.5]})
    finally:
        type(df).collect = plain
    assert seen and all("percentile" not in p and len(rows) <= 4 for p, rows in seen)


def test_stratified_split_of_many_classes(spark):
    df = spark.range(30_000).select("id", F.when(F.col("id") % 10 > 0, F.col("id") % 12_000).alias("y"))
    got = split.split_stratified(df, "y", "id", 0.5).groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "test").alias("t")).collect()
    assert len(got) > 10_000 and all(r["t"] == int(r["n"] * 0.5 + 0.5) for r in got)


def test_gram(spark):
    x = np.random.default_rng(2).normal(size=(500, 4))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    assert np.allclose(gram_matrix(df.repartition(7)), x.T @ x)


@pytest.mark.parametrize("block", [7, 100, 10_000])
@pytest.mark.parametrize("keys", [["k"], []])
def test_windows_over_blocks(spark, keys, block):
    df = hot_series(spark).repartition(5)
    exprs = {"lag": lambda w: F.lag("id", 5).over(w), "lead": lambda w: F.lead("id", 3).over(w),
             "avg": lambda w: F.round(F.avg("v").over(w.rowsBetween(-6, 2)), 9)}
    plain = series_window(df, keys, ["t", "id"], 6, 3, exprs)
    cut = series_window(df, keys, ["t", "id"], 6, 3, exprs, limit=0, block=block)
    assert sorted(map(str, plain.collect())) == sorted(map(str, cut.select(plain.columns).collect()))


@pytest.mark.parametrize("keys", [["k"], []])
def test_fills_over_partitions(spark, keys):
    df = hot_series(spark).withColumn("v", F.when(F.col("id") % 50 == 0, F.col("v")))
    for fwd, bwd in (({"f": "v"}, {"b": "v"}), ({"f": "v"}, None), (None, {"b": "v"})):
        plain = fill_series(df, keys, ["t", "id"], fwd, bwd)
        cut = fill_series(df, keys, ["t", "id"], fwd, bwd, limit=0).select(plain.columns)
        assert sorted(map(str, plain.collect())) == sorted(map(str, cut.collect()))


def test_positions_and_sums(spark):
    df = hot_series(spark).repartition(17)
    got = with_position(df, ["k", "t", "id"]).orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(3000))
    assert [(r["k"], r["t"], r["id"]) for r in got] == sorted((r["k"], r["t"], r["id"]) for r in got)
    run = prefix_sums(df.select("id"), ["id"], ["id"]).orderBy("id").collect()
    assert [r["cum_id"] for r in run] == list(np.cumsum(range(3000)))
    a = series_index(df, ["k"], ["t", "id"]).select("id", "idx").collect()
    b = series_index(df, ["k"], ["t", "id"], limit=0).select("id", "idx").collect()
    assert sorted(a) == sorted(b)


def test_lookup_of_many_categories(spark, monkeypatch):
    rows = ["hot"] * 400 + [f"v{i % 150}" for i in range(600)] + [None] * 200
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "id int, cat string")
    shares = df.groupBy(F.col("cat").alias("value")).agg((F.count(F.lit(1)) / 1200.0).alias("share"))
    want = {r["id"]: rows.count(r["cat"]) / 1200 for r in df.collect()}
    for limit in (2, 100_000):
        monkeypatch.setattr(lk, "BROADCAST_ROWS", limit)
        monkeypatch.setattr(lk, "HOT_SHARE", 100)
        out = lk.lookup(df, shares, "cat", ["share"], "share", right_key="value").collect()
        assert len(out) == 1200
        assert all(abs(r["share"] - want[r["id"]]) < 1e-12 for r in out)


@pytest.mark.parametrize("parts", [1, 17])
def test_splits_do_not_depend_on_partitions(spark, parts):
    df = hot_series(spark)
    for fn in (lambda d: split.split_random(d, "id"), lambda d: split.split_stratified(d, "k", "id"),
               lambda d: split.split_time(d, "t", "id"), lambda d: split.kfold(d, "id").withColumnRenamed("fold", "split"),
               lambda d: split.time_series_folds(d, "t", "id").withColumnRenamed("block", "split")):
        a = {r["id"]: r["split"] for r in fn(df).collect()}
        b = {r["id"]: r["split"] for r in fn(df.repartition(parts)).collect()}
        assert a == b and len(a) == 3000


def test_stratified_sizes_with_text_keys(spark):
    df = hot_series(spark).withColumn("name", F.concat(F.lit("row"), "id"))
    got = split.split_stratified(df, "k", "name").groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "test").alias("t")).collect()
    assert all(r["t"] == int(r["n"] * 0.2 + 0.5) for r in got)


def test_time_split_with_one_hot_moment(spark):
    df = spark.createDataFrame([(5 if i < 600 else i, i) for i in range(1000)], "t int, id int")
    got = split.split_time(df, "t", "id", 0.5)
    order = sorted((r["t"], r["id"]) for r in df.collect())
    want = set(order[:500])
    assert {(r["t"], r["id"]) for r in got.filter("split = 'train'").collect()} == want


def test_keys_over_the_whole_64_bits(spark):
    rng = np.random.default_rng(8)
    ids = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, 1500, dtype="int64"))
    df = spark.createDataFrame([(i % 2, 7 if i % 3 else i, int(k)) for i, k in enumerate(ids)], "y int, t int, id long")
    n = df.count()
    got = split.split_time(df, "t", "id", 0.7)
    order = sorted((r["t"], r["id"]) for r in df.collect())
    assert sorted((r["t"], r["id"]) for r in got.filter("split = 'train'").collect()) == order[:int(n * 0.3)]
    for r in split.split_stratified(df, "y", "id").groupBy("y").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "test").alias("t")).collect():
        assert r["t"] == int(r["n"] * 0.2 + 0.5)


def test_products_of_many_short_series(spark):
    """every row of a short series became a matrix of its own in Python, cell by cell."""
    from sparktab.operators.timeseries import grouped_gram
    rng = np.random.default_rng(6)
    rows = [(None if i % 50 == 0 else i % 50, *[float(v) for v in rng.normal(size=3)]) for i in range(400)]
    df = spark.createDataFrame(rows, "s int, a double, b double, c double")
    gram = grouped_gram(df.repartition(5), ["s"], ["a", "b", "c"])
    assert "MapInPandas" not in gram._jdf.queryExecution().toString()
    for r in gram.collect():
        x = np.array([v[1:] for v in rows if v[0] == r["s"]])
        assert np.allclose(np.array(r["gram"]).reshape(3, 3), x.T @ x)
    one = grouped_gram(df.repartition(5), [], ["a", "b", "c"]).first()["gram"]
    x = np.array([v[1:] for v in rows])
    assert np.allclose(np.array(one).reshape(3, 3), x.T @ x)


def test_series_tables_are_not_copied_for_broadcast(spark, monkeypatch):
    """a table of series was multiplied by its shares and then broadcast by its size before that."""
    from sparktab.functions import order
    df = spark.createDataFrame([(None if i % 7 == 0 else i % 7, i) for i in range(100)], "s int, v int")
    per = spark.createDataFrame([(None, 0.5), *[(i, float(i)) for i in range(1, 6)]], "s int, w double")
    for limit, copied in ((order.SERIES_ROWS, False), (3, True)):
        monkeypatch.setattr(order, "SERIES_ROWS", limit)
        out = order.lookup_series(df, per, ["s"])
        plan = out._jdf.queryExecution().toString()
        assert ("Generate" in plan) == copied and not (copied and "BroadcastHashJoin" in plan)
        assert sorted((r["v"], r["w"]) for r in out.collect() if r["w"] is not None) == [(i, 0.5 if i % 7 == 0 else float(i % 7)) for i in range(100) if i % 7 < 6]
        assert out.count() == 100 and out.columns == ["s", "v", "w"]


def test_many_steps_of_one_series():
    """each step of a forecast made arrays of its own; the steps of a long one are plain sums with the same values."""
    from sparktab.operators.timeseries import _walk
    rng = np.random.default_rng(8)
    for lags, season in (((1, 2, 3), 0), ((1, 2, 12, 13), 12)):
        y = rng.normal(size=max(lags) + 2 + season)
        beta, want = rng.normal(size=len(lags) + 1) / 9, list(y)
        for _ in range(40):
            z = np.diff(want) if not season else np.diff(want)[season:] - np.diff(want)[:-season]
            base = want[-1] + (want[-season] - want[-season - 1] if season else 0)
            want.append(base + beta[0] + sum(b * z[-i] for b, i in zip(beta[1:], lags)))
        assert np.allclose(_walk(beta.tolist(), y.tolist(), lags, season, 40), want[len(y):])
