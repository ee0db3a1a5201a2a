"""Hand-made tables for the rules that decide, and reload of fitted steps."""
import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from sparktab.functions.staging import stage_path
from sparktab.operators import clean, metrics, profile
from sparktab.operators import encode as en
from sparktab.operators.clean import BooleanNormalizer, TypeCorrector, basic_clean, ingest
from sparktab.operators.encode import Encoder
from sparktab.operators.impute import Imputer
from sparktab.operators.scale import Scaler
from sparktab.operators.select import FeatureSelector
from sparktab.operators.transform import DatetimeExpander, OutlierCapper, SkewFixer
from sparktab.plans.auto import AutoPreprocessor


def col(df, name):
    return [r[name] for r in df.collect()]


def test_booleans(spark):
    df = spark.createDataFrame([("yes", 0.0, "Yes", True), ("no", 1.0, "No", False), (None, None, None, None)],
                               "a string, b double, c string, d boolean")
    out = BooleanNormalizer().fit(df).transform(df)
    assert col(out, "a") == [1, 0, None] and col(out, "b") == [0, 1, None] and col(out, "d") == [1, 0, None]
    assert col(out, "c") == ["Yes", "No", None]
    assert col(BooleanNormalizer(ignore_case=True).fit(df).transform(df), "c") == [1, 0, None]
    three = spark.createDataFrame([("yes",), ("no",), ("maybe",), ("only",)], "a string")
    assert BooleanNormalizer().fit(three)["text"] == []


def test_onehot_keeps_fitted_categories(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "x string")
    m = Encoder(strategy="onehot").fit(df)
    new = m.transform(spark.createDataFrame([("c",), ("z",)], "x string"))
    assert new.columns == ["x_a", "x_b", "x_c"] and [tuple(r) for r in new.collect()] == [(0, 0, 1), (0, 0, 0)]


def test_label_many_and_reload(spark, monkeypatch):
    monkeypatch.setattr(en, "LITERAL_MAX", 3)
    df = spark.createDataFrame([(i, f"n{i % 30:02d}") for i in range(90)], "id int, x string")
    for kind in ("label", "frequency"):
        m = Encoder(strategy=kind, columns=["x"]).fit(df)
        assert m["tables"]
        path = stage_path(spark, "test")
        PipelineModel([m]).write().save(path)
        new = spark.createDataFrame([(1, "n00"), (2, "n29"), (3, "??")], "id int, x string")
        got = [r["x"] for r in PipelineModel.load(path).transform(new).orderBy("id").collect()]
        assert got == ([0, 29, -1] if kind == "label" else [3 / 90, 3 / 90, 0.0])


def test_target_encoding_needs_numbers(spark):
    df = spark.createDataFrame([(f"c{i % 20}", float(i % 20), "t") for i in range(60)], "x string, y double, z string")
    assert Encoder(target="y", columns=["x"]).fit(df)["rules"]["x"]["kind"] == "target"
    assert Encoder(target="z", columns=["x"]).fit(df)["rules"]["x"]["kind"] == "frequency"


def test_imputation_bands(spark):
    n = 200
    rows = [(None if i < 4 else float(i), None if i < 40 else float(i % 7), None if i < 120 else 1.0,
             None if i < 20 else "ab"[i % 2], float("nan") if i < 80 else float(i)) for i in range(n)]
    df = spark.createDataFrame(rows, "low double, mid double, most double, cat string, nan double")
    m = Imputer().fit(df)
    assert m["plan"] == {"low": "median", "mid": "knn", "most": "drop", "cat": "mode", "nan": "median"}
    out = m.transform(df).collect()
    low = [r[0] for r in rows if r[0] is not None]
    assert out[0]["low"] == float(np.median(low)) and out[0]["cat"] == "a"
    assert math.isclose(out[0]["mid"], np.mean([i % 7 for i in range(40, n)]))
    assert out[0]["nan"] == float(np.median(range(80, n)))


def test_skew_needs_full_positive_columns(spark):
    x = np.exp(np.random.default_rng(0).normal(size=300) * 1.5)
    rows = [(float(v), float(v) if i else None, float(v) if i else 0.0, float(v) if i else -1.0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "plain double, hole double, zero double, minus double")
    assert SkewFixer().fit(df)["kinds"] == {"plain": "log1p", "zero": "sqrt"}


def test_caps_keep_nulls(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)] + [(1000.0,), (None,)], "x double")
    out = OutlierCapper().fit(df).transform(df)
    vals = col(out, "x")
    assert vals.count(None) == 1 and max(v for v in vals if v is not None) < 100


def test_dates_in_text(spark):
    df = spark.createDataFrame([("2024-01-01 05:00:00", "2024", "x")] * 9 + [(None, "7", "y")], "d string, n string, s string")
    m = DatetimeExpander().fit(df)
    assert m["columns"] == ["d"]
    r = m.transform(df).collect()
    assert (r[0]["d_dayofweek"], r[0]["d_hour"], r[-1]["d_hour"], r[-1]["d_year"]) == (0, 5, 0, None)


def test_types_above_ninety_percent(spark):
    df = spark.createDataFrame([(str(i), "x" if i < 10 else str(i)) for i in range(100)], "a string, b string")
    assert TypeCorrector().fit(df)["columns"] == ["a"]


def test_selector_compares_with_dropped_columns(spark):
    x = np.random.default_rng(1).normal(size=400)
    e = np.random.default_rng(2).normal(size=400)
    rows = [(float(a), float(a + 0.2 * b), float(a + 0.4 * b)) for a, b in zip(x, e)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    r = np.corrcoef(np.array(rows).T)
    assert r[0, 2] < 0.95 < r[1, 2]
    assert FeatureSelector().fit(df)["high_correlation"] == ["b", "c"]


def test_scaler_round_trip_and_constant(spark):
    df = spark.createDataFrame([(float(i), 3.0) for i in range(50)], "x double, k double")
    for kind in ("standard", "minmax", "robust"):
        m = Scaler(strategy=kind).fit(df)
        back = m.inverse(m.transform(df))
        assert np.allclose(sorted(col(back, "x")), range(50), atol=1e-9) and set(col(back, "k")) == {3.0}
        assert set(col(m.transform(df), "k")) == {0.0}


def test_basic_clean_and_ingest(spark):
    df = spark.createDataFrame([(1.0, None, "a"), (None, None, None), (3.0, None, "b"), (3.0, None, "b")],
                               " x  double, e double, s string".replace(" x  ", "` x ` "))
    out = basic_clean(df)
    assert out.columns == ["x", "s"] and sorted(col(out, "x")) == [1.0, 3.0, 3.0, 3.0] and "unknown" in col(out, "s")
    kept, log = ingest(df)
    assert kept.count() == 3 and kept.columns == [" x ", "s"] and log[0][1] == "Removed 1 rows"


@pytest.mark.parametrize("copies, limit, whole", [(0, 100_000, False), (40, 100_000, False), (40, 10, True), (20_000, 100_000, True)])
def test_rows_are_not_moved_to_find_few_copies(spark, monkeypatch, copies, limit, whole):
    """Copies go, null and zero of either sign included, and only hashes are shuffled unless copies are many."""
    plans, plain = [], clean.stage
    monkeypatch.setattr(clean, "stage", lambda d, label: plans.append(d._jdf.queryExecution().executedPlan().toString()) or plain(d, label))
    monkeypatch.setattr(clean, "BROADCAST_ROWS", limit, raising=False)
    df = spark.range(20_000, numPartitions=4).select("id", F.when(F.col("id") % 7 != 0, (F.col("id") % 50).cast("string")).alias("s"),
                                                     F.when(F.col("id") % 5 != 0, F.col("id") % 3 * -0.0).alias("z"), F.lit(None).cast("int").alias("gone"))
    again = df.filter(F.col("id") < copies).withColumn("z", F.col("z") + F.lit(0.0))
    kept, log = ingest(df.unionByName(again).unionByName(again))
    rows = kept.collect()
    assert log[0][1] == f"Removed {2 * copies} rows" and kept.columns == ["id", "s", "z"]
    assert sorted(r["id"] for r in rows) == list(range(20_000))
    assert all(r["s"] == (str(r["id"] % 50) if r["id"] % 7 else None) for r in rows)
    assert all((r["z"] is None) if r["id"] % 5 == 0 else math.copysign(1, r["z"]) == 1 for r in rows)
    if not copies:
        assert not any("hashpartitioning(id" in p for p in plans)
    assert any("hashpartitioning(id" in p and "_digest" not in p for p in plans) == whole


def test_copies_of_rows_with_nested_values(spark):
    df = spark.createDataFrame([(1, [1.0]), (1, [1.0]), (2, None)], "i int, a array<double>")
    assert sorted(r["i"] for r in ingest(df)[0].collect()) == [1, 2]


def test_profile_in_passes_that_are_compiled(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 6))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"x{i} double" for i in range(6)))
    widths, plain = [], type(df).first
    monkeypatch.setattr(type(df), "first", lambda self: widths.append(len(self.columns)) or plain(self))
    got = profile.full_profile(df)
    assert widths and max(widths) <= 15
    assert all(math.isclose(got["correlation"][f"x{a}", f"x{b}"], np.corrcoef(x[:, a], x[:, b])[0, 1], abs_tol=1e-9) for a in range(6) for b in range(a + 1, 6))
    assert all(math.isclose(got["numeric_stats"][f"x{i}"]["std"], x[:, i].std(ddof=1), abs_tol=1e-4) for i in range(6))


def test_targets(spark):
    df = spark.createDataFrame([(i % 10, i % 11, "x", float(i)) for i in range(300)], "ten int, eleven int, s string, v double")
    assert profile.target_types(df, ["ten", "eleven", "s", "v", "none"]) == {
        "ten": "classification", "eleven": "regression", "s": "classification", "v": "regression", "none": "unknown"}


def test_text_labels_in_binary_metrics(spark):
    df = spark.createDataFrame([("no", "no"), ("yes", "yes"), ("yes", "no"), ("no", "no")], "y string, p string")
    v = metrics.classification_values(df, "y", "p", "yes")
    assert v["precision"] == 1.0 and v["recall"] == 0.5 and v["accuracy"] == 0.75


def test_auc_with_one_hot_score(spark):
    rng = np.random.default_rng(4)
    y, s = rng.integers(0, 2, 900), np.where(rng.random(900) < 0.4, 0.5, rng.random(900))
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])
    assert math.isclose(metrics.auc_binary(df, F.col("y") == 1, F.col("s")), want, rel_tol=1e-9)


def test_unit_root_test(spark):
    rng = np.random.default_rng(7)
    noise, walk = rng.normal(size=600), np.cumsum(rng.normal(size=600))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(noise, walk))], "t int, noise double, walk double")
    assert profile.adf_stationarity(df, "noise", ["t"])["verdict"] == "Stationary"
    assert profile.adf_stationarity(df, "walk", ["t"])["verdict"] == "Non-Stationary"
    assert profile.adf_stationarity(df.limit(10), "noise", ["t"])["verdict"] == "Unknown"


def test_unit_root_test_of_each_series(spark):
    rng = np.random.default_rng(8)
    series = {1: rng.normal(size=300), 2: np.cumsum(rng.normal(size=500)), None: rng.normal(size=120).cumsum() * 0.1 + rng.normal(size=120),
              3: rng.normal(size=10), 4: np.ones(50), 5: np.array([np.nan] * 30)}
    rows = [(k, i, float(v), "x") for k, x in series.items() for i, v in enumerate(x)] + [(1, 1000, None, "x"), (1, 1001, float("nan"), "x")]
    rng.shuffle(rows)
    rows = [(None if r[0] is None else int(r[0]), int(r[1]), None if r[2] is None else float(r[2]), "x") for r in rows]
    df = spark.createDataFrame(rows, "k int, t int, v double, lag string")
    for limit, lag in ((1_000_000, None), (200, None), (1_000_000, 2)):
        got = {r["k"]: r for r in profile.adf_by_series(df, ["k"], "v", ["t"], lag, limit).collect()}
        assert set(got) == set(series)
        for k in (1, 2, None):
            one = profile.adf_stationarity(df.filter(F.col("k").eqNullSafe(F.lit(k))), "v", ["t"], lag)
            assert (got[k]["verdict"], got[k]["n"], got[k]["lag"]) == (one["verdict"], one["n"], one["lag"])
            assert math.isclose(got[k]["statistic"], one["statistic"], rel_tol=1e-8) and math.isclose(got[k]["p_value"], one["p_value"], abs_tol=1e-9)
        assert [(got[k]["verdict"], got[k]["n"]) for k in (3, 4, 5)] == [("Unknown", 10), ("Unknown", 50), ("Unknown", 0)]
    assert profile.adf_by_series(df.limit(0), ["k"], "v", ["t"]).count() == 0


def test_auto_preprocess_flow(spark):
    rng = np.random.default_rng(9)
    rows = [(i, float(np.exp(rng.normal() * 2)), "yes" if i % 2 else "no", f"2024-01-{i % 28 + 1:02d}", str(i % 50),
             "abc"[i % 3] if i % 9 else None, int(i % 25 == 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, x double, flag string, day string, num string, cat string, y int")
    p = AutoPreprocessor("y", key="id", apply_smote=True).fit_transform(df.unionByName(df.limit(20)))
    assert p.task_type == "classification" and p.profile["class_imbalance"]["imbalanced"]
    counts = {r["y"]: r["count"] for r in p.train.groupBy("y").count().collect()}
    assert counts[0] == counts[1]
    assert all(not isinstance(f.dataType, type(df.schema["cat"].dataType)) for f in p.train.select(p.features).schema)
    path = stage_path(spark, "auto")
    p.model.write().save(path)
    a = sorted(map(tuple, p.model.transform(df).select("id", *p.features).collect()))
    b = sorted(map(tuple, PipelineModel.load(path).transform(df).select("id", *p.features).collect()))
    assert a == b and len(a) == 600
    seen = p.overview()
    assert seen["rows"]["test"] == p.test.count() and sum(seen["outcome"].values()) == len(p.log)


def test_auto_preprocess_without_key_and_in_time(spark):
    rows = [(f"2024-{i // 28 + 1:02d}-{i % 28 + 1:02d}", float(i), float(i * i % 97)) for i in range(300)]
    df = spark.createDataFrame(rows, "day string, x double, y double").withColumn("day", F.to_timestamp("day"))
    p = AutoPreprocessor("y", is_time_series=True, date_col="day").fit_transform(df)
    assert (p.train.count(), p.test.count()) == (240, 60)


def test_correlations_of_many_columns_with_gaps(spark):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(400, 25)) * rng.choice([1e-3, 1, 1e6], 25) + rng.choice([0, 1e5], 25)
    x[:, 3] = 0.1                                   # constant
    x[:, 4] = x[:, 5] * -2 + 1                      # the same up to scale
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:, 7] = np.nan                                # never known
    x[:, 8] = np.where(np.arange(400) == 5, 1.0, np.nan)
    df = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in r] for r in x], ", ".join(f"`c {i}` double" for i in range(25)))
    got = {(r["left"], r["right"]): r["r"] for r in profile.masked_correlations(df.repartition(6), df.columns).collect()}
    assert len(got) == 300
    for i in range(25):
        for j in range(i + 1, 25):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[both, i], x[both, j]
            want = np.corrcoef(a, b)[0, 1] if both.sum() > 1 and len(set(a)) > 1 and len(set(b)) > 1 else None
            r = got[f"c {i}", f"c {j}"]
            assert (r is None) == (want is None) and (r is None or abs(r - want) < 1e-6), (i, j, r, want)
    high = profile.correlation_pairs(df).filter("is_high").collect()
    assert [(r["left"], r["right"]) for r in high] == [("c 4", "c 5")]
    assert profile.masked_correlations(df.limit(0), df.columns).filter("r is not null").count() == 0


def test_metrics_of_any_number_of_classes(spark):
    from sparktab.operators import balance, metrics
    df = spark.range(60_000).select((F.col("id") % 12_000).alias("y"), (F.col("id") % 11_997).alias("p"))
    rows = [(i % 12_000, i % 11_997) for i in range(60_000)]
    v = metrics.classification_values(df, "y", "p")
    assert abs(v["accuracy"] - sum(a == b for a, b in rows) / 60_000) < 1e-12 and -1 <= v["mcc"] <= 1
    assert metrics.per_class_report(df, "y", "p").count() == 12_000
    assert metrics.confusion_matrix(df, "y", "p", zeros=False).agg(F.sum("n")).first()[0] == 60_000
    assert balance.class_weights(df, "y").agg(F.min("weight"), F.max("weight"), F.count("weight")).first()[:] == (1.0, 1.0, 60_000)
    text = spark.createDataFrame([("a", "a"), ("b", "a"), (None, "b"), ("b", None), ("b", "c")], "y string, p string")
    assert {(r["label"], r["prediction"]): r["n"] for r in metrics.confusion_matrix(text, "y", "p").collect() if r["n"]} == {("a", "a"): 1, ("b", "a"): 1, ("b", "c"): 1}
    assert metrics.classification_values(text, "y", "p")["recall"] == 0.0  # two label classes: of b
    assert metrics.classification_values(text.limit(0), "y", "p")["accuracy"] == 0.0


def test_dates_in_the_column_s_own_format(spark):
    from sparktab.operators import clean
    rows = [("13/02/2024", "02/13/2024", "3.1.2024 4:05", "Jan 3, 2024", "2024/1/3", "01/02/2024", "20240103", "13/02/2024"),
            ("01/12/2023", "12/01/2023", "31.12.2023", "Dec 31, 2023", "2023/12/31", "02/03/2024", "20240104", "no date"),
            (None, None, None, None, None, None, None, "x")]
    names = ["eu_date", "us_date", "dot_date", "word_date", "slash_date", "unsure_date", "number_date", "mixed_date"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    roles = {r["column"]: r["role"] for r in clean.column_roles(df).collect()}
    assert [roles[n] for n in names] == ["date"] * 6 + ["categorical"] * 2
    model = DatetimeExpander(share=0.6).fit(df)
    assert set(model["columns"]) == set(names[:6])
    out = model.transform(df).collect()
    day = lambda r, n: (r[f"{n}_year"], r[f"{n}_month"], r[f"{n}_day"])
    assert [day(out[0], n) for n in names[:6]] == [(2024, 2, 13), (2024, 2, 13), (2024, 1, 3), (2024, 1, 3), (2024, 1, 3), (2024, 1, 2)]
    assert day(out[1], "eu_date") == (2023, 12, 1) and out[0]["dot_date_hour"] == 4 and out[2]["eu_date_year"] is None
    new = model.transform(spark.createDataFrame([("05/06/2025",) + (None,) * 7], df.schema)).first()
    assert day(new, "eu_date") == (2025, 6, 5)  # read as the fitted column is
