"""No row is lost for a null key, a NaN, a short series or a size limit: both paths of each switch give the same."""
import numpy as np
from pyspark.sql import functions as F

from sparktab.functions.lookup import lookup
from sparktab.functions.order import fill_series, series_index
from sparktab.operators import neighbors, profile, split, timeseries


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_lookup_of_null_on_both_paths(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("b", 3), ("zz", 4), ("", 5)], "k string, n int")
    values = spark.createDataFrame([("a", 1.0, 0.9), (None, 2.0, 0.0), ("b", 3.0, None), ("", 4.0, 0.0)], "k string, v double, w double")
    few = rows(lookup(df, values, "k", ["v"], "w").select("k", "n", "v"))
    many = rows(lookup(df, values, "k", ["v"], "w", limit=0).select("k", "n", "v"))
    assert few == many and (None, 2, 2.0) in few and ("b", 3, 3.0) in few and ("zz", 4, None) in few


def test_null_series_on_both_paths(spark):
    data = [(None if i % 3 == 0 else "s", i, float(i) if i % 4 == 1 else None) for i in range(60)]
    df = spark.createDataFrame(data, "s string, t int, v double").repartition(5)
    for limit in (1_000_000, 0):
        filled = fill_series(df, ["s"], ["t"], {"before": "v"}, {"after": "v"}, limit=limit)
        index = series_index(df, ["s"], ["t"], limit=limit)
        got = rows(filled.select("s", "t", "before", "after")), rows(index.select("s", "t", "idx"))
        if limit:
            want = got
    assert got == want and all(r[2] is not None for r in got[1])


def test_folds_hold_every_row(spark):
    df = spark.createDataFrame([(i if i % 2 else None, float(i)) for i in range(200)], "id bigint, x double")
    folds = {r.fold: r["count"] for r in split.kfold(df, "id", 4).groupBy("fold").count().collect()}
    assert set(folds) == {0, 1, 2, 3} and sum(folds.values()) == 200


def test_histogram_of_all_columns(spark):
    df = spark.range(50).select(*[(F.col("id") * (i + 1)).cast("double").alias(f"c{i:02d}") for i in range(15)])
    assert {r[0] for r in profile.histogram(df, bins=3).select("column").distinct().collect()} == set(df.columns)


def test_broken_queries_come_back(spark):
    data = [(i, [float(i), 1.0]) for i in range(30)]
    corpus = spark.createDataFrame([*data, (90, [float("nan"), 1.0]), (91, None)], "id bigint, v array<double>")
    asks = spark.createDataFrame([(1, [3.2, 1.0]), (2, [float("nan"), 1.0]), (3, None)], "q bigint, v array<double>")
    got = [rows(neighbors.knn_join(asks, corpus, 2, "q", "id", "v", "v", few=few).select("query", "id", "rank")) for few in (1000, 0)]
    assert got[0] == got[1] == sorted([(1, 3, 1), (1, 4, 2), (2, None, None), (3, None, None)], key=repr)


def test_class_of_one_row_is_repeated(spark):
    df = spark.createDataFrame([(i, i % 2, float(i), float(-i)) for i in range(40)] + [(99, 7, 1.5, 2.5)], "id bigint, y int, a double, b double")
    got = neighbors.smote(df, "id", "y", ["a", "b"])
    assert {r.y: r["count"] for r in got.groupBy("y").count().collect()} == {0: 20, 1: 20, 7: 20}
    assert rows(got.filter("y = 7").select("a", "b").distinct()) == [(1.5, 2.5)]


def test_short_and_gappy_series_have_forecasts(spark):
    data = [("long", i, 0.5 * i + np.sin(i)) for i in range(60)] + [("gap", i, None if i == 20 else 2.0 * i) for i in range(60)]
    data += [("short", 1, 1.0), ("tail", 1, None)] + [(None, i, 3.0 * i) for i in range(40)] + [("end", i, None if i == 39 else 1.0 * i) for i in range(40)]
    df = spark.createDataFrame([(s, i, None if v is None else float(v)) for s, i, v in data], "s string, t int, v double")
    for run in (timeseries.ar_forecast(df, ["s"], ["t"], "v", 3, lags=(1, 2)), timeseries.recursive_forecast(df, ["s"], ["t"], "v", 3, lookback=4)):
        got = {}
        for r in run.collect():
            got.setdefault(r.s, []).append(r.forecast)
        assert {s: len(x) for s, x in got.items()} == {s: 3 for s in ("long", "gap", "short", "tail", "end", None)}
        assert all(x is not None for s in ("long", "gap", None) for x in got[s])
        assert all(x is None for s in ("short", "tail", "end") for x in got[s])


def test_csv_with_breaks_in_quotes_and_two_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text,n\n1,"two\nlines",5\n2,"a ""q"" b",6\n', encoding="utf-8")
    (tmp_path / "b.csv").write_bytes("id,text,n\n3,café,x\n4,short\n".encode("iso-8859-1"))
    from sparktab.sources import io
    got = rows(io.read_csv(spark, str(tmp_path)))
    assert got == [(1, "two\nlines", "5"), (2, 'a "q" b', "6"), (3, "café", "x"), (4, "short", None)]
