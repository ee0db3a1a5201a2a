"""Models against closed forms and naive predictions; explanations add up; saved models agree."""
import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sparktab.functions.staging import stage_path
from sparktab.operators import explain, metrics, models, retrieval, timeseries, tune
from sparktab.sources import io, registry


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(600, 3))
    y = 3 * x[:, 0] - 2 * x[:, 1] + np.sin(3 * x[:, 2]) + rng.normal(size=600) * 0.1
    return x, y, spark.createDataFrame([(i, *map(float, r), float(v), "abc"[int(np.digitize(v, [-1.5, 1.5]))])
                                        for i, (r, v) in enumerate(zip(x, y))],
                                       "id int, a double, b double, c double, y double, cls string").cache()


F3 = ["a", "b", "c"]


def test_ridge_and_lasso_scales(data):
    x, y, df = data
    tr = models.assemble(df, F3, "y")
    m = models.make_estimator("Ridge", "regression", 600, F3, params={"alpha": 50.0}).fit(tr)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 50 * np.eye(3), xc.T @ yc)
    assert np.allclose(m.coefficients.toArray(), want, atol=1e-6)
    m = models.make_estimator("Lasso", "regression", 600, F3, params={"alpha": 0.5}).fit(tr)
    w = m.coefficients.toArray()
    grad = xc.T @ (yc - xc @ w) / 600
    on = np.abs(w) > 1e-9
    assert np.allclose(grad[on], 0.5 * np.sign(w[on]), atol=1e-3) and (np.abs(grad[~on]) <= 0.5 + 1e-3).all()


@pytest.mark.parametrize("name", models.REGRESSORS)
def test_regressors_beat_the_mean(data, spark, name):
    df = data[2]
    r = models.train_many(df.filter("id < 450"), df.filter("id >= 450"), F3, "y", "id", "regression", [name],
                          {name: {"n_estimators": 8, "alpha": 0.1, "max_depth": 5}}, strict=True)
    row = r.results(spark).first()
    assert row["r2"] > 0.4, row


@pytest.mark.parametrize("name", models.CLASSIFIERS)
def test_classifiers_beat_the_largest_class(data, spark, name):
    df = data[2]
    share = df.groupBy("cls").count().agg(F.max("count")).first()[0] / 600
    r = models.train_many(df.filter("id < 450"), df.filter("id >= 450"), F3, "cls", "id", "classification", [name],
                          {name: {"n_estimators": 5, "max_depth": 4}}, strict=True)
    row = r.results(spark).first()
    assert row["accuracy"] > share + 0.05, row
    assert r.labels == ["a", "b", "c"]


def test_failures_become_rows(data, spark):
    df = data[2]
    r = models.train_many(df, df, F3, "y", "id", "regression", ["Ridge", "Nothing"])
    board = metrics.leaderboard(r.results(spark), "regression").orderBy("rank").collect()
    assert [b["model"] for b in board] == ["Ridge", "Nothing"] and board[1]["failed"] and "Nothing" in board[1]["error"]
    assert metrics.best_model(r.results(spark), "Regression").first()["best_model"] == "Ridge"


@pytest.mark.parametrize("name,depth", [("Decision Tree", 14), ("Random Forest", 4), ("Gradient Boosting", 3)])
def test_tree_contributions_add_up(data, spark, name, depth):
    tr = models.assemble(data[2], F3, "y", "id")
    m = models.make_estimator(name, "regression", 600, F3, params={"n_estimators": 4, "max_depth": depth}).fit(tr)
    trees = explain.model_trees(m, spark)
    s = explain.shap_tree(tr, "row_id", F3, trees).groupBy("row_id").agg(F.sum("contribution").alias("s"))
    gap = m.transform(tr).join(s, "row_id").agg(F.max(F.abs(F.col("prediction") - F.col("s") - explain.tree_base(trees)))).first()[0]
    assert gap < 1e-8


def random_tree(rng, depth, features, empty=0.1):
    """Random node arrays: features come again, some splits are sets of categories, some nodes have no cover."""
    tree = explain.Tree([], [], [], [], [], [], [])

    def grow(d, cover):
        at = len(tree.left)
        for x, v in ((tree.left, -1), (tree.right, -1), (tree.feature, -1), (tree.cut, 0.0), (tree.left_set, None), (tree.value, float(rng.normal())), (tree.cover, cover)):
            x.append(v)
        if d and rng.random() < 0.9:
            tree.feature[at] = int(rng.integers(features))
            tree.cut[at] = float(rng.integers(0, 5))
            tree.left_set[at] = sorted(set(map(float, rng.integers(0, 5, 2)))) if rng.random() < 0.3 else None
            part = 0.0 if rng.random() < empty else float(rng.integers(0, int(cover) + 1))
            tree.left[at] = grow(d - 1, part)
            tree.right[at] = grow(d - 1, cover - part)
        return at

    grow(depth, 64.0)
    return tree


def test_tree_contributions_by_definition(spark):
    """Shapley values from the value function over all feature subsets."""
    from itertools import combinations
    rng = np.random.default_rng(11)
    for depth, features in ((0, 2), (1, 1), (2, 2), (5, 3), (8, 4)):
        trees = [random_tree(rng, depth, features) for _ in range(3)]
        x = rng.integers(0, 5, (40, features)).astype(float)

        def value(row, known, tree, node=0):
            if tree.left[node] < 0:
                return tree.value[node]
            a, b = tree.left[node], tree.right[node]
            if tree.feature[node] in known:
                return value(row, known, tree, a if tree.goes_left(node, row[None])[0] else b)
            return tree.share(node, a) * value(row, known, tree, a) + tree.share(node, b) * value(row, known, tree, b)

        want = np.zeros_like(x)
        for r, row in enumerate(x):
            for i in range(features):
                rest = [f for f in range(features) if f != i]
                for n in range(features):
                    for s in combinations(rest, n):
                        w = math.factorial(n) * math.factorial(features - n - 1) / math.factorial(features)
                        want[r, i] += w * sum(value(row, {*s, i}, t) - value(row, set(s), t) for t in trees)
        assert np.allclose(explain.path_contributions(x, trees), want, atol=1e-9)
        assert np.isclose(explain.tree_base(trees), sum(value(x[0], set(), t) for t in trees))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double, d double")
    got = {(r["id"], r["feature"]): r["contribution"] for r in explain.shap_tree(df.repartition(3), "id", list("abcd"), trees).collect()}
    assert np.allclose([[got[i, f] for f in "abcd"] for i in range(len(x))], want)


def test_full_forests_and_categories_add_up(data, spark):
    from pyspark.ml.feature import VectorIndexer
    from pyspark.ml.regression import RandomForestRegressor
    tr = models.assemble(data[2].withColumn("cat", (F.hash("id") % 7 + 7).cast("double")), [*F3, "cat"], "y", "id")
    tr = VectorIndexer(inputCol="features", outputCol="indexed", maxCategories=20).fit(tr).transform(tr)
    m = RandomForestRegressor(featuresCol="indexed", labelCol="label", numTrees=100, maxDepth=30, seed=1).fit(tr)
    rows = tr.select("row_id", "label", "indexed", *[vector_to_array("indexed")[i].alias(f) for i, f in enumerate([*F3, "cat"])])
    trees = explain.model_trees(m, spark)
    assert any(s is not None for t in trees for s in t.left_set)
    total = explain.shap_tree(rows, "row_id", [*F3, "cat"], trees).groupBy("row_id").agg(F.sum("contribution").alias("s"))
    gap = m.transform(rows).join(total, "row_id").agg(F.max(F.abs(F.col("prediction") - F.col("s") - explain.tree_base(trees)))).first()[0]
    assert gap < 1e-8


def test_linear_contributions_of_features_that_vary_together(spark):
    """The average over all orders of what a feature adds to the mean given the features before it."""
    from itertools import permutations
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 3)) @ np.array([[1, 0.8, 0], [0, 1, 0.3], [0, 0, 1]])
    x = np.column_stack([x, x[:, 0]])  # and one feature twice
    beta = [2.0, -1.0, 0.5, 3.0]
    mean, cov = x.mean(axis=0), np.cov(x.T, bias=True)

    def value(row, held):
        held, rest = list(held), [i for i in range(4) if i not in held]
        guess = mean.copy()
        if held:
            guess[held] = row[held]
            guess[rest] = mean[rest] + cov[np.ix_(rest, held)] @ np.linalg.pinv(cov[np.ix_(held, held)]) @ (row[held] - mean[held])
        return float(np.dot(beta, guess))

    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(999, None, 1.0, 1.0, 1.0)], "id int, a double, b double, c double, d double")
    got = {(r["id"], r["feature"]): r["contribution"] for r in explain.shap_linear(df, "id", dict(zip("abcd", beta)), together=True).collect()}
    for i in (0, 7, 100):
        want = np.zeros(4)
        for order in permutations(range(4)):
            for n, f in enumerate(order):
                want[f] += (value(x[i], order[:n + 1]) - value(x[i], order[:n])) / 24
        assert np.allclose([got[i, f] for f in "abcd"], want, atol=1e-8)
    assert got[999, "a"] is None
    wide = explain.conditional_map([1.0] * 14, np.eye(14))
    assert np.allclose(wide, np.eye(14))  # features apart: the plain form, by orders too


def test_kernel_contributions_of_a_linear_model(data):
    tr = models.assemble(data[2], F3, "y", "id")
    m = models.make_estimator("Linear Regression", "regression", 600, F3).fit(tr)
    phi = explain.shap_kernel(tr, tr, "row_id", F3, m, permutations=30)
    lin = explain.shap_linear(tr, "row_id", dict(zip(F3, map(float, m.coefficients)))).withColumnRenamed("contribution", "want")
    r = phi.join(lin, ["row_id", "feature"]).agg(F.corr("contribution", "want")).first()[0]
    assert r > 0.97


def test_kernel_contributions_add_up_over_the_whole_background(data, spark):
    tr = models.assemble(data[2], F3, "y", "id")
    m = models.make_estimator("Decision Tree", "regression", 600, F3, params={"max_depth": 4}).fit(tr)
    some = tr.filter("row_id % 5 = 0")
    back = tr.filter("row_id % 4 = 1").unionByName(tr.filter("row_id % 8 = 1"))  # half of them twice
    phi = explain.shap_kernel(some, back, "row_id", F3, m)
    mean = m.transform(back).agg(F.avg("prediction")).first()[0]
    assert [round(r[0], 6) for r in phi.select("base_value").distinct().collect()] == [round(mean, 6)]
    total = phi.groupBy("row_id").agg(F.sum("contribution").alias("s"), F.count(F.lit(1)).alias("n"))
    gap = m.transform(some).join(total, "row_id").agg(F.count(F.lit(1)), F.max(F.abs(F.col("prediction") - F.col("s") - mean)), F.min("n")).first()
    assert gap[0] == some.count() and gap[1] < 1e-6 and gap[2] == len(F3)


def test_saved_models_agree(data, spark):
    tr = models.assemble(data[2], F3, "y", "id")
    live = {n: models.make_estimator(n, "regression", 600, F3, params={"n_estimators": 3}).fit(tr)
            for n in ("AdaBoost", "Extra Trees", "KNN", "SVM", "Ridge")}
    path = stage_path(spark, "saved")
    io.save_models(spark, live, path)
    assert io.list_saved_models(spark, path) == sorted(live)
    for n, m in io.load_models(spark, path).items():
        a = {r["row_id"]: r["prediction"] for r in live[n].transform(tr).collect()}
        b = {r["row_id"]: r["prediction"] for r in m.transform(tr).collect()}
        assert np.allclose([a[i] for i in a], [b[i] for i in a]), n


def test_tuning_keeps_the_budget_and_the_best(data):
    df = data[2]
    _, r = tune.tune(df.filter("id < 450"), df.filter("id >= 450"), "Decision Tree", "regression", F3, "y", "id", max_trials=6,
                     space={"max_depth": (1, 8, False)}, batch=3)
    assert r["trials"] == 6 and r["params"]["max_depth"] > 2 and r["model"] == "Decision Tree (Tuned)"
    with pytest.raises(RuntimeError):
        tune.tune(df, df, "Ridge", "regression", F3, "y", "id", max_trials=2, space={"alpha": ["bad"]})


def test_forecasts_beat_the_last_value(spark):
    t = np.arange(400)
    y = 0.05 * t + 4 * np.sin(2 * np.pi * t / 12)
    df = spark.createDataFrame([("s", int(i), float(v)) for i, v in zip(t, y)], "k string, t int, y double")
    fit, want = df.filter("t < 376"), y[376:]
    naive = np.sqrt(np.mean((want - y[375]) ** 2))
    for kw in ({"lags": tuple(range(1, 13))}, {"lags": (1, 12, 13), "season": 12}):
        for keys, limit in ((["k"], 10_000), ([], 0)):
            got = timeseries.ar_forecast(fit, keys, ["t"], "y", 24, limit=limit, **kw).orderBy("step").collect()
            assert np.sqrt(np.mean((want - [r["forecast"] for r in got]) ** 2)) < naive / 4
    got = timeseries.recursive_forecast(fit, ["k"], ["t"], "y", 24, lookback=14).orderBy("step").collect()
    assert np.sqrt(np.mean((want - [r["forecast"] for r in got]) ** 2)) < naive / 2


def test_separator_chunks(spark):
    text = "\n\n".join("word%d " % i * (i % 9 + 1) for i in range(60)) + "\n\n" + "x" * 700
    df = spark.createDataFrame([(1, text), (2, ""), (3, "short")], "id int, t string")
    got = retrieval.chunk_by_separator(df, "id", "t").orderBy("id", "chunk").collect()
    one = [r["chunk_text"] for r in got if r["id"] == 1]
    assert all(len(x) <= 500 for x in one[:-1]) and one[-1].endswith("x" * 700)
    assert {w for w in text.split()} == {w for x in one for w in x.split()}
    assert [r["chunk_text"] for r in got if r["id"] == 3] == ["short"] and not [r for r in got if r["id"] == 2]


def test_experiment_life(spark):
    reg = registry.Experiments(spark, stage_path(spark, "reg"))
    assert reg.current().count() == 0
    a, b = reg.create("one.csv", (10, 3)), reg.create("two.csv", (20, 4))
    reg.update(a, status="completed", best_model="Ridge", best_score=1.5, model_results={"Ridge": 1.5}, target_col=["y"])
    reg.add_event(a, "done", "trained", {"n": 1})
    row = reg.load(a).first()
    assert row["best_model"] == "Ridge" and row["dataset_shape"] == [10, 3] and row["model_results"] == {"Ridge": 1.5}
    assert [r["workspace_id"] for r in reg.list().collect()][0] in (a, b) and reg.list().count() == 2
    assert [r["event"] for r in reg.timeline().filter(F.col("workspace_id") == a).orderBy("seq").collect()] == ["workspace_created", "done"]
    reg.delete(spark.createDataFrame([(b,), ("none",)], "workspace_id string"))
    assert [r["workspace_id"] for r in reg.list().collect()] == [a]
    with pytest.raises(KeyError):
        reg.update("none", status="x")


def test_ragged_and_quoted_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'id,name,v\n1,"x,y",2.5\n2,short\n3,long,1,extra\n4,caf\xc3\xa9,\n')
    (tmp_path / "b.csv").write_bytes(b"id,name,v\n5,caf\xe9,7\n")
    out = {r["id"]: (r["name"], r["v"]) for r in io.read_csv(spark, str(tmp_path)).collect()}
    assert out == {1: ("x,y", 2.5), 2: ("short", None), 4: ("café", None), 5: ("café", 7.0)}


def test_chunks_of_a_large_vocabulary_are_told_apart(spark):
    n = 1200
    rows = [(i, " ".join(f"w{i * 7 + j}x" for j in range(7))) for i in range(n)]  # 8,400 words, none shared
    chunks = spark.createDataFrame(rows, "id int, chunk_text string")
    model = retrieval.fit_embedder(chunks)
    asks = chunks.filter("id % 10 = 3").withColumnRenamed("id", "q")
    got = [retrieval.retrieve(asks, chunks, model, "q", "chunk_text", "id", 2, few, block).orderBy("query", "rank").collect()
           for few, block in ((1000, 1000), (50, 500))]
    assert [r["id"] for r in got[0] if r["rank"] == 1] == [r["query"] for r in got[0] if r["rank"] == 1] == list(range(3, n, 10))
    assert all(r["d2"] < 1e-9 for r in got[0] if r["rank"] == 1) and all(r["d2"] > 1.5 for r in got[0] if r["rank"] == 2)
    assert [(r["query"], r["id"], r["rank"]) for r in got[0]] == [(r["query"], r["id"], r["rank"]) for r in got[1]]


def test_arma_gives_its_coefficients_back(spark):
    rng = np.random.default_rng(31)

    def made(n, phi, theta, d):
        u = rng.normal(size=n + 50)
        z = np.zeros(n + 50)
        for i in range(1, n + 50):
            z[i] = phi * z[i - 1] + u[i] + theta * u[i - 1]
        return np.cumsum(z[50:]) if d else z[50:]

    series = {("a", 1): made(6000, 0.6, 0.3, 1), ("b", 1): made(6000, -0.4, -0.5, 1), (None, 1): made(6000, 0.5, 0.7, 1)}
    rows = [(k[0], i, float(v)) for k, x in series.items() for i, v in enumerate(x)] + [("short", i, float(i)) for i in range(5)]
    rows += [("gap", i, None if i == 299 else float(i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "s string, t int, v double").repartition(7)
    for limit in (1_000_000, 3000):
        fit = timeseries.arma_fit(df, ["s"], ["t"], "v", limit=limit)
        got = {r["s"]: r for r in fit.collect()}
        for k, phi, theta in (("a", 0.6, 0.3), ("b", -0.4, -0.5), (None, 0.5, 0.7)):
            assert abs(got[k]["phi"][0] - phi) < 0.05 and abs(got[k]["theta"][0] - theta) < 0.05
        assert got["short"]["phi"] is None
        ahead = {}
        for r in timeseries.arma_forecast(fit, ["s"], 4).orderBy("step").collect():
            ahead.setdefault(r["s"], []).append(r["forecast"])
        assert ahead["short"] == ahead["gap"] == [None] * 4 and len(ahead) == 5
        r = got["a"]
        z, y, want = r["phi"][0] * r["past"][0] + r["theta"][0] * r["shocks"][0], series["a", 1][-1], []
        for _ in range(4):
            y += z
            want.append(y)
            z *= r["phi"][0]
        assert np.allclose(ahead["a"], want)
    one = spark.createDataFrame([(i, float(v)) for i, v in enumerate(made(5000, 0.6, 0.3, 0))], "t int, v double")
    fit = timeseries.arma_fit(one, [], ["t"], "v", d=0, constant=True)
    assert abs(fit.first()["phi"][0] - 0.6) < 0.05 and timeseries.arma_forecast(fit, [], 3, d=0).count() == 3
    pure = timeseries.arma_fit(one, [], ["t"], "v", p=0, q=2, d=2)
    assert timeseries.arma_forecast(pure, [], 3, d=2).filter("forecast is not null").count() == 3


def test_csv_files_of_any_encoding_are_split_where_they_can_be(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id,name\n1,café\n2,plain\n".encode())
    (tmp_path / "b.csv").write_bytes("id,name\n3,café\n".encode("iso-8859-1"))
    (tmp_path / "c.csv").write_bytes("id,name\n4,10 € café\n".encode("windows-1252"))
    (tmp_path / "d.csv").write_bytes("id,name\n5,café € 日本\n".encode("utf-16"))
    (tmp_path / "e.csv").write_bytes('id,name\n6,"two\nlines"\n7,"a ""word"""\n'.encode())
    (tmp_path / "f.csv").write_bytes("id,name\n8,marked\n".encode("utf-8-sig"))
    traits = {f[-5:]: (kind, broken) for f, kind, broken in io.file_traits(spark, str(tmp_path))}
    assert traits == {"a.csv": ("utf-8", False), "b.csv": ("iso-8859-1", False), "c.csv": ("windows-1252", False), "d.csv": ("utf-16", True),
                      "e.csv": ("utf-8", True), "f.csv": ("utf-8", False)}
    out = {r["id"]: r["name"] for r in io.read_csv(spark, str(tmp_path)).collect()}
    assert out == {1: "café", 2: "plain", 3: "café", 4: "10 € café", 5: "café € 日本", 6: "two\nlines", 7: 'a "word"', 8: "marked"}
    assert io.read_csv(spark, str(tmp_path / "a.csv"), encoding="utf-8").count() == 2


def test_text_classes_in_tuning_grids_and_several_targets(data, spark):
    df = data[2].withColumns({"kind": F.when(F.col("a") > 0, "high").otherwise("low"), "sign": F.when(F.col("b") > 0, "+").otherwise("-")})
    train, test = df.filter("id % 4 > 0"), df.filter("id % 4 = 0").withColumn("kind", F.when(F.col("id") == 0, "new").otherwise(F.col("kind")))
    model, result = tune.tune(train, test, "Decision Tree", "classification", F3, "kind", "id", max_trials=2, cv_folds=2, batch=2)
    assert result["labels"] == ["high", "low"] and result["accuracy"] > 0.9
    for name, grid in (("Decision Tree", {"max_depth": [1, 3]}), ("KNN", {"n_neighbors": [1, 5]}), ("AdaBoost", {"n_estimators": [2]})):
        best, scores = tune.custom_grid(train, name, "classification", F3, "kind", "id", grid, cv_folds=2)
        rows = scores.collect()
        assert len(rows) == math.prod(map(len, grid.values())) and all(0.5 < r["cv_metric"] <= 1 for r in rows)
    _, out = models.multi_output(train, test, F3, ["kind", "sign"], "id", "classification", "Decision Tree", {"max_depth": 3})
    good = out.agg(F.avg((F.col("kind") == F.col("prediction_kind")).cast("double")), F.avg((F.col("sign") == F.col("prediction_sign")).cast("double"))).first()
    assert good[0] > 0.9 and good[1] > 0.9 and set(r[0] for r in out.select("prediction_kind").distinct().collect()) <= {"high", "low"}


@pytest.mark.parametrize("name,params", [("Extra Trees", {"n_estimators": 3}), ("SVM", {"C": 2.0}), ("SVM", {"kernel": "linear"})])
def test_repeated_rows_are_fitted_as_cells(spark, monkeypatch, name, params):
    """rows of equal features are handed to the fit once, with the same model and metrics as all rows."""
    df = spark.range(2000).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3 / 2).alias("b"),
                                  (F.col("id") * 37 % 101 + F.col("id") % 7 * 9).cast("double").alias("y"))
    seen = []
    make = models.make_estimator

    def spied(*args, **kw):
        est = make(*args, **kw)
        fit = est._fit
        est._fit = lambda d: (seen.append(d.count()), fit(d))[1]
        return est

    monkeypatch.setattr(models, "make_estimator", spied)
    train, test = df.filter("id % 5 > 0"), df.filter("id % 5 = 0")
    got = models.train_many(train, test, ["a", "b"], "y", "id", "regression", [name], {name: params}, strict=True)
    assert seen == [21]
    monkeypatch.setattr(models, "make_estimator", make)
    rows = models.assemble(train, ["a", "b"], "y", "id")
    pred = make(name, "regression", 1600, ["a", "b"], 2, params).fit(rows).transform(models.assemble(test, ["a", "b"], "y", "id"))
    want, told = models.evaluate(pred, "regression"), got.rows[0]
    assert all(told[k] == pytest.approx(want[k], rel=1e-6) for k in want)
    a, b = ({r.row_id: r.prediction for r in p.collect()} for p in (pred, got.predictions[name]))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-6) for k in a)


def test_cells_keep_null_labels_and_rare_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 5 + [(1.0, None)] + [(2.0, 4.0), (2.0, 6.0)] * 3, "a double, label double")
    out, rows = models.cells(df, ["a"], "regression")
    assert rows == 12 and sorted((r.a, r.label, r[models.WEIGHT]) for r in out.collect()) == [(1.0, None, 6.0), (2.0, 5.0, 6.0)]
    assert out.filter("a = 2").first()[models.REST] == pytest.approx(6.0)
    own = df.filter("label is not null").withColumn("a", F.rand(1))
    assert models.cells(own, ["a"], "regression")[0] is own
    whole = df.filter("label is not null")
    classes, _ = models.cells(whole.union(whole), ["a"], "classification")
    assert sorted((r.a, r.label, r[models.WEIGHT]) for r in classes.collect()) == [(1.0, 2.0, 10.0), (2.0, 4.0, 6.0), (2.0, 6.0, 6.0)]


def test_tuning_on_cells_equals_tuning_on_rows(spark, monkeypatch):
    """Rows that repeat go through the folds as weighted cells, with the scores of all rows."""
    df = spark.range(1500).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3 / 2).alias("b"),
                                  (F.col("id") * 37 % 101 + F.col("id") % 7 * 9).cast("double").alias("y"), (F.col("id") * 37 % 101 > 20 + F.col("id") % 7 * 9).cast("int").alias("big"))
    train, test, made = df.filter("id % 5 > 0"), df.filter("id % 5 = 0"), models.cells

    monkeypatch.setattr(tune, "TREE_ROWS", 1)

    def both(run):
        sizes = []
        monkeypatch.setattr(models, "cells", lambda *a: (lambda got: (sizes.append(got[0].count()), got)[1])(made(*a)))
        packed = run()
        monkeypatch.setattr(models, "cells", lambda d, *a: (d, d.count()))
        rows = run()
        assert sizes and max(sizes) <= 21 * 2 * 2
        return packed, rows

    a, b = both(lambda: tune.tune(train, test, "Ridge", "regression", ["a", "b"], "y", "id", max_trials=2, cv_folds=2, batch=2, time_budget=600)[1])
    assert a["params"] == b["params"] and all(a[k] == pytest.approx(b[k], rel=1e-7) for k in ("rmse", "mae", "cv_score"))
    for name, task, label, grid in (("Decision Tree", "regression", "y", {"max_depth": [1, 4]}), ("Decision Tree", "classification", "big", {"max_depth": [1, 4]}),
                                    ("SVM", "regression", "y", {"C": [1.0]})):
        a, b = both(lambda: {str(r["params"]): r["cv_metric"] for r in tune.custom_grid(train, name, task, ["a", "b"], label, "id", grid, cv_folds=2)[1].collect()})
        assert a == pytest.approx(b, rel=1e-7) and len(a) == math.prod(map(len, grid.values()))
