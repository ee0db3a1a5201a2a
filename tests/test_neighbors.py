"""Neighbour search against brute force, also where a third of the rows are copies."""
import re
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktab.operators import neighbors as nb


def points(spark, n=300, copies=100, d=5, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, d))
    x[:copies] = x[0]
    return x, spark.createDataFrame([(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)],
                                    "id int, vec array<double>, label int")


def brute(q, x, k, same):
    out = set()
    for i, a in enumerate(q):
        d = [(float(((a - b) ** 2).sum()), j) for j, b in enumerate(x) if not (same and i == j)]
        out |= {(i, j, r + 1) for r, (_, j) in enumerate(sorted(d)[:k])}
    return out


@pytest.mark.parametrize("few,block,pivots", [(10_000, 1, 1), (0, 40, 8), (0, 10_000, 1), (0, 7, 64)])
@pytest.mark.parametrize("same", [True, False])
def test_knn_join(spark, few, block, pivots, same):
    x, df = points(spark)
    got = nb.knn_join(df, df.repartition(6), 4, "id", "id", "vec", "vec", "label", skip_same=same, few=few, block=block,
                      pivots=pivots)
    assert {(r["query"], r["id"], r["rank"]) for r in got.collect()} == brute(x, x, 4, same)


def vectors_of_kind(kind, rng, n=2600, q=90):
    x, asks = rng.normal(size=(n, 16)), rng.normal(size=(q, 16))
    if kind == "far":       # norms far above the distances
        x, asks = x + 1e4, asks + 1e4
    if kind == "grid":      # many equal distances
        x, asks = rng.integers(0, 3, size=(n, 4)).astype(float), rng.integers(0, 3, size=(q, 4)).astype(float)
    if kind == "copies":
        x[:1500] = asks[0]
    if kind == "outlier":
        x[7] *= 1e9
    if kind == "large":
        x, asks = x * 1e19, asks * 1e19
    if kind == "tiny":
        x, asks = x * 1e-25, asks * 1e-25
    return x, asks


@pytest.mark.parametrize("kind", ["plain", "far", "grid", "copies", "outlier", "large", "tiny"])
@pytest.mark.parametrize("same", [True, False])
def test_candidates_of_single_precision_lose_nothing(monkeypatch, kind, same):
    x, asks = vectors_of_kind(kind, np.random.default_rng(8))
    ids = np.arange(len(x)) // 2
    held = pd.DataFrame({"query": np.arange(len(asks)) if same else np.arange(len(asks)) + 10**6})
    rows = pd.DataFrame({"id": ids, "vec": list(x), "label": np.arange(len(x)) % 7})
    monkeypatch.setattr(nb, "TILE", 1024)  # several tiles, the last one not full
    doubles, nearest = [], nb._nearest
    monkeypatch.setattr(nb, "_nearest", lambda *a: doubles.append(1) or nearest(*a))
    got = nb._topk(held, asks, rows, 5, same)
    want = []
    for i, a in zip(held["query"], asks):
        d2 = ((a - x) ** 2).sum(1)
        best = sorted((d, j) for d, j in zip(d2, ids) if not (same and j == i))[:5]
        want += [(i, j, d) for d, j in best]
    assert list(zip(got["query"], got["id"], got["d2"])) == sorted(want, key=lambda r: (r[0], r[2], r[1]))
    if kind in ("plain", "far", "grid"):
        assert not doubles


def test_distances_to_pivots_need_no_copy_of_the_rows():
    rng = np.random.default_rng(9)
    x, p = rng.normal(size=(20_001, 64)), rng.normal(size=(3, 64))
    tracemalloc.start()
    got = nb._spans(x, p)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < x.nbytes / 4
    for j in range(3):
        gap = x - p[j]
        assert np.array_equal(got[:, j], np.sqrt(np.einsum("ij,ij->i", gap, gap)))
    assert nb._spans(x[:0], p).shape == (0, 3)


def test_vectors_move_as_bytes(spark):
    x, df = points(spark)
    cells = df.select("id", "vec", F.lit(None).cast("double").alias("label"), F.lit(0).alias("cell"))
    asks = df.select(F.col("id").alias("query"), F.col("vec").alias("qvec"), F.array(F.lit(0)).alias("cells"))
    schema = T.StructType([T.StructField(n, t) for n, t in (("query", T.IntegerType()), ("id", T.IntegerType()), ("d2", T.DoubleType()), ("label", T.DoubleType()))])
    found = nb._meet(cells, asks, 4, schema, True, 100)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"ArrowEvalPython \[pack\(", plan)) == 2
    best = {}
    for r in found.collect():
        best.setdefault(r["query"], []).append((r["d2"], r["id"]))
    assert {(q, i, n + 1) for q, held in best.items() for n, (_, i) in enumerate(sorted(held)[:4])} == brute(x, x, 4, True)


def test_fewer_rows_than_k(spark):
    x, df = points(spark, 3, 1)
    for few in (10, 0):
        got = nb.knn_join(df, df, 5, "id", "id", "vec", "vec", skip_same=True, few=few)
        assert got.count() == 6


def test_smote_rows_lie_between_parents(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(i < 37), float(rng.normal()), float(rng.normal())) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, y int, a double, b double")
    out = nb.smote(df, "id", "y", ["a", "b"])
    new = out.filter("synthetic").collect()
    assert len(new) == 163 - 37 and all(r["y"] == 1 for r in new)
    old = np.array([r[2:] for r in rows if r[1] == 1])
    for r in new:
        p = np.array([r["a"], r["b"]])
        gaps = [np.linalg.norm(p - u) + np.linalg.norm(p - v) - np.linalg.norm(u - v) for u in old for v in old]
        assert min(gaps) < 1e-9
    again = nb.smote(df.repartition(9), "id", "y", ["a", "b"]).filter("synthetic").collect()
    assert sorted((r["a"], r["b"]) for r in new) == sorted((r["a"], r["b"]) for r in again)
    assert out.filter("not synthetic").count() == 200


def test_approximate_neighbours(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 8)) * 20
    x = np.concatenate([centres[rng.integers(30, size=900)] + rng.normal(size=(900, 8)), np.repeat(centres[:1], 300, axis=0)])  # a third are copies
    rows = [(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)] + [(5000, None, 1), (5001, [float("nan")] * 8, 1), (5002, [None] * 8, 1)]
    df = spark.createDataFrame(rows, "id int, vec array<double>, label int")
    exact = nb.knn_join(df, df, 4, "id", "id", "vec", "vec", skip_same=True)
    for block in (20_000, 50):
        got = nb.knn_approx(df, df.repartition(5), 4, "id", "id", "vec", "vec", "label", skip_same=True, cell_rows=30, block=block)
        r = nb.recall(got, exact).first()
        assert r["queries"] == 1200 and r["recall"] >= 0.9
        found = got.collect()
        assert all(abs(f["d2"] - ((x[f["query"]] - x[f["id"]]) ** 2).sum()) < 1e-9 and f["query"] != f["id"] and f["label"] == f["id"] % 3 for f in found)
        assert max(f["rank"] for f in found) == 4 and len({(f["query"], f["id"]) for f in found}) == len(found)
    whole = nb.knn_approx(df, df, 4, "id", "id", "vec", "vec", skip_same=True, cell_rows=30, probes=10**6)
    assert nb.recall(whole, exact).first()["recall"] == 1.0
    assert nb.knn_approx(df.limit(0), df, 3, "id", "id", "vec", "vec").count() == 0
    assert nb.knn_approx(df, df.limit(0), 3, "id", "id", "vec", "vec").count() == 0


@pytest.mark.parametrize("few", [10_000, 0])
def test_gaps_in_several_columns(spark, few):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 3)).round(2)
    x[rng.random(x.shape) < 0.25] = np.nan
    x[0] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], "z") for i, r in enumerate(x)]
    got = nb.gap_impute(spark.createDataFrame(rows, "id int, a double, b double, c double, other string").repartition(4), "id", ["a", "b", "c"], 3, few)
    assert got.columns == ["id", "a", "b", "c", "other"]
    want = x.copy()
    for i, j in zip(*np.nonzero(np.isnan(x))):
        near = []
        for r in range(len(x)):
            both = ~np.isnan(x[i]) & ~np.isnan(x[r])
            if not np.isnan(x[r, j]) and both.any():
                near.append((round(3 / both.sum() * ((x[i] - x[r])[both] ** 2).sum(), 9), r))
        own = [x[r, j] for _, r in sorted(near)[:3]]
        want[i, j] = np.mean(own) if own else np.nanmean(x[:, j])
    assert np.allclose([r[1:4] for r in sorted(got.collect())], want)


def copies(monkeypatch):
    """How many times each query is sent to blocks of rows, and the rows of a block, of every search."""
    seen, meet = [], nb._meet

    def spy(placed, visits, k, schema, skip_same, block):
        sent = sum(len(r["cells"]) for r in visits.select("cells").collect()) / visits.count()
        seen.append((sent * max(1, placed.count() / block / placed.select("cell").distinct().count()), block))
        return meet(placed, visits, k, schema, skip_same, block)

    monkeypatch.setattr(nb, "_meet", spy)
    return seen


@pytest.mark.parametrize("apart", [0, 500])
def test_queries_are_copied_a_bounded_number_of_times(spark, monkeypatch, apart):
    """without clusters each query met every cell and every share of it; with clusters it meets its own cells."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(800, 24)) + apart * rng.integers(0, 2, size=(4, 24))[rng.integers(4, size=800)]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, vec array<double>")
    seen = copies(monkeypatch)
    got = nb.knn_join(df, df, 3, "id", "id", "vec", "vec", skip_same=True, few=0, block=2, pivots=16)
    assert {(r["query"], r["id"], r["rank"]) for r in got.collect()} == brute(x, x, 3, True)
    assert len(seen) == 1 and seen[0][0] <= nb.SHARES
    assert nb._block(100_000, 64) == 6_250 and nb._block(10**8, 64) == nb.BLOCK_MOST


def test_many_rows_have_many_cells(spark, monkeypatch):
    """cells keep their size as a table grows, where they were 128 of any size."""
    monkeypatch.setattr(nb, "CELL_ROWS", 20)
    x = np.random.default_rng(12).normal(size=(600, 1))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, vec array<double>")
    cells, meet = [], nb._meet
    monkeypatch.setattr(nb, "_meet", lambda placed, *a: cells.append(placed.select("cell").distinct().count()) or meet(placed, *a))
    got = nb.knn_join(df, df, 3, "id", "id", "vec", "vec", skip_same=True, few=0, pivots=2)
    assert {(r["query"], r["id"], r["rank"]) for r in got.collect()} == brute(x, x, 3, True)
    assert cells == [30]


def test_approximate_search_copies_queries_a_bounded_number_of_times(spark, monkeypatch):
    """a query was sent to each of its cells, of which there were a fixed share of the rows."""
    x = np.random.default_rng(13).normal(size=(900, 24))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, vec array<double>")
    seen = copies(monkeypatch)
    got = nb.knn_approx(df, df, 3, "id", "id", "vec", "vec", skip_same=True, cell_rows=4)
    assert got.count() == 2700 and seen[0][0] <= nb.SHARES


def test_approximate_search_of_few_cells(spark):
    """Fewer cells than groups of them, and cells without rows."""
    x = np.random.default_rng(14).normal(size=(120, 3))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, vec array<double>")
    exact = nb.knn_join(df, df, 3, "id", "id", "vec", "vec", skip_same=True)
    for cell_rows in (30, 1000):
        got = nb.knn_approx(df, df, 3, "id", "id", "vec", "vec", skip_same=True, cell_rows=cell_rows)
        assert nb.recall(got, exact).first()["recall"] >= 0.9
