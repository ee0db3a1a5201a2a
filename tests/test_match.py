"""Band and containment joins against loops, with keys cut into shares of any size, and their plans."""
import random
import re

import pytest
from pyspark.sql import functions as F

from sparktab.operators import advise, match
from sparktab.plans import load_all
from sparktab.plans.catalog import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("share", [1, 7, 50_000])
def test_band_join_equals_a_loop(spark, share):
    rng = random.Random(1)
    numbers = [0, 0.4, 0.5, 1, 1.5, 2, 3, 1e300, -1, None] + [round(10 ** rng.uniform(-2, 6), rng.randrange(3)) for _ in range(150)] + [1000.0] * 40
    rows = [(i, rng.choice("ab"), None if v is None else float(v)) for i, v in enumerate(numbers)]
    asks = [(i, rng.choice("ab"), None if v is None else float(v)) for i, v in enumerate([0, 0.5, 1, 2, 1000.0, None] + [10 ** rng.uniform(-1, 6) for _ in range(60)])]
    got = match.band_join(spark.createDataFrame(rows, "i int, k string, v double"), spark.createDataFrame(asks, "j int, k string, w double"),
                          "v", "w", 0.5, ["k"], share)
    want = [(i, j) for i, k, v in rows for j, k2, w in asks if k == k2 and v is not None and w is not None and abs(v - w) / max(w, 1) < 0.5]
    assert sorted((r.i, r.j) for r in got.collect()) == sorted(want)
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)


def test_similar_runs_by_rows_or_columns_once(spark):
    schema = "dataset_name string, best_model string, best_score double, task_type string, profile_summary struct<total_rows: bigint, total_columns: bigint>"
    runs = [("a", "X", 1.0, "regression", (100, 10)), ("b", "X", 1.0, "Regression", (149, 50)), ("c", None, 1.0, "regression", (100, 10)),
            ("d", "X", None, "classification", (100, 10)), ("e", "X", 1.0, "regression", (0, 10)), ("f", "X", 1.0, "regression", (5000, 12)),
            ("g", "X", 1.0, "regression", None), ("h", "X", 1.0, None, (100, 10)), ("a", "X", 1.0, "regression", (100, 10))]
    profiles = spark.createDataFrame([(1, 100, 10, "REGRESSION"), (2, None, 10, "regression"), (3, 10**6, 10**3, "regression"), (4, 0, 0, "regression")],
                                     "id int, total_rows bigint, total_columns bigint, task_type string")
    got = match.similar_runs(spark.createDataFrame(runs, schema), profiles, "id")
    pairs = sorted((r.id, r.dataset) for r in got.collect())
    assert [p for p in pairs if p[0] == 1] == [(1, "a"), (1, "a"), (1, "b"), (1, "f")]
    assert [p for p in pairs if p[0] == 2] == [(2, "a"), (2, "a"), (2, "f")] and not [p for p in pairs if p[0] > 2]
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    assert match.similar_runs(spark.createDataFrame([], schema), profiles, "id").count() == 0


def test_similar_runs_query_lists_every_pair(spark, tmp_path):
    spark.createDataFrame([(1, "a", 2.0, 1), (2, "b", 2.0, 1), (3, "c", 2.0, 4), (4, "d", 2.0, 3), (5, "e", -1.0, 1), (6, "f", 2.0, 10)],
                          "c_custkey long, c_name string, c_acctbal double, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("select id as o_orderkey, id % 6 + 1 as o_custkey, double(id) as o_totalprice, timestamp'2020-01-01' as o_orderdate from range(60)"
              ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("select id as l_orderkey, id % 4 as l_suppkey, int(id div 4 % 7) as l_linenumber from range(2000)").write.parquet(f"{tmp_path}/lineitem.parquet")
    load_all()
    got = QUERIES["similar_runs"](spark, str(tmp_path))
    assert got.columns == ["l_suppkey", "dataset", "best_model", "best_score", "total_rows", "features"]
    runs = [("a", 54.0, 10, 2, "classification"), ("b", 55.0, 10, 2, "classification"), ("c", 56.0, 10, 5, "regression"), ("f", 59.0, 10, 11, "regression")]
    want = [(s, d, "Ridge", score, n, k) for s in range(4) for d, score, n, k, task in runs
            if task == ("classification" if s % 2 == 0 else "regression") and (abs(n - 10) / 10 < 0.5 or abs(k - 7 - s) / (7 + s) < 0.3)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 8


@pytest.mark.parametrize("share", [3, 50_000])
def test_similar_classes_stand_for_all_pairs(spark, share):
    rng = random.Random(5)
    schema = "dataset_name string, best_model string, best_score double, task_type string, profile_summary struct<total_rows: bigint, total_columns: bigint>"
    runs = [(f"d{i % 70}", rng.choice(["X", "X", None]), rng.choice([1.0, None]), rng.choice(["regression", "Regression", "other", None]),
             (rng.choice([None, 0, 1, 9, 10, 14, 100]), rng.choice([None, 3, 4, 9]))) for i in range(200)]
    profiles = [(rng.choice([None, i]), rng.choice([None, 0.5, 7.0, 10.0, 99.0]), rng.choice([None, 0, 3, 8]), rng.choice(["REGRESSION", "other", None])) for i in range(90)]
    tables = spark.createDataFrame(runs, schema), spark.createDataFrame(profiles, "id int, total_rows double, total_columns bigint, task_type string")
    want = match.similar_runs(*tables, "id", share)
    got = match.similar_classes(*tables, "id", share).localCheckpoint()
    part = lambda name, *cols: got.filter(F.col("part") == name).select(*cols)
    links = part("link", "task", "profile_rows", "profile_columns", "total_rows", "features", "pairs")
    asked, finished = part("profile", "id", "task", "profile_rows", "profile_columns"), part("run", "dataset", "best_model", "best_score", "task", "total_rows", "features")
    said = asked.toDF("id", "t", "r", "c"), finished.toDF("dataset", "best_model", "best_score", "u", "n", "f")
    pairs = (links.join(said[0], (F.col("task") == F.col("t")) & F.col("profile_rows").eqNullSafe(F.col("r")) & F.col("profile_columns").eqNullSafe(F.col("c")))
             .join(said[1], (F.col("task") == F.col("u")) & F.col("total_rows").eqNullSafe(F.col("n")) & F.col("features").eqNullSafe(F.col("f")))
             .select("id", "dataset", "best_model", "best_score", "total_rows", "features"))
    rows = lambda df: sorted(map(repr, map(tuple, df.collect())))
    assert rows(pairs) == rows(want) and rows(want)
    assert links.agg(F.sum("pairs")).first()[0] == want.count() > links.count()
    assert asked.count() == len(profiles)
    again = match.similar_classes(tables[0].union(tables[0]), tables[1].union(tables[1]), "id", share).filter("part = 'link'")
    assert again.count() == links.count() and again.agg(F.sum("pairs")).first()[0] == 4 * want.count()


def loop(free, known):
    """The rule for one name: exact, cleaned, first known name in either direction."""
    table = {}
    for k in known:
        table[k.lower().replace(" ", "")] = k
    if free is None:
        return None, None
    if free in known:
        return free, "exact"
    clean = free.lower().replace(" ", "")
    if clean in table:
        return table[clean], "normalized"
    return next(((v, "partial") for k, v in table.items() if k in clean or clean in k), (None, None))


@pytest.mark.parametrize("share", [1, 50_000])
def test_names_equal_a_loop(spark, share):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abC ") for _ in range(n))
    for extra in ([], [""], [" "]):
        known = list(dict.fromkeys([word(rng.randrange(1, 9)) for _ in range(30)] + ["Random Forest", "random forest", "é日本"] + extra))
        free = [word(rng.randrange(0, 12)) for _ in range(150)] + [None, "", "The RandomForest model", "x日本", "日本", "zzz"] * 3
        df = spark.createDataFrame(list(enumerate(free)), "i int, free string")
        table = spark.createDataFrame(list(enumerate(known)), "p int, known string")
        got = match.match_names(df, "free", table, "known", "p", share)
        assert sorted((r.i, r.match, r.kind) for r in got.collect()) == [(i, *loop(x, known)) for i, x in enumerate(free)]
        assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)


def test_pairs_of_names_are_summed_up_without_a_sort(spark, monkeypatch):
    """the pairs meet in a hash aggregate of numbers, known names that repeat are taken once."""
    plans, write = {}, match.stage
    monkeypatch.setattr(match, "stage", lambda df, label: (plans.update({label: plan(df)}), write(df, label))[1])
    known = spark.createDataFrame([("b x", 2), ("a x y", 1), ("B X", 3)] * 50, "known string, p int")
    df = spark.createDataFrame([("x",), ("bx!",), ("b X",), ("q",)] * 20, "free string")
    got = {(r.free, r.match, r.kind) for r in match.match_names(df, "free", known, "known", "p").collect()}
    assert got == {("x", "a x y", "partial"), ("bx!", "B X", "partial"), ("b X", "B X", "normalized"), ("q", None, None)}
    assert re.search(r"HashAggregate\(keys=\[clean#\d+\], functions=\[(partial_)?min\(place", plans["partial-names"])
    assert "SortAggregate(key=[clean" not in plans["partial-names"] and "SortAggregate(keys=[clean" not in plans["partial-names"]


def test_names_without_known_ones(spark):
    df = spark.createDataFrame([(1, "a"), (2, ""), (3, None)], "i int, free string")
    assert {r.match for r in match.match_names(df, "free", spark.createDataFrame([], "k string"), "k").collect()} == {None}
    assert {r.match for r in advise.match_names(df, "free", []).collect()} == {None}
    many = [f"name {i}" for i in range(3000)]
    got = advise.match_names(spark.createDataFrame([("the name 2999 of all",)], "free string"), "free", many).first()
    assert got.match == "name 2" and got.kind == "partial"
    assert [r.match for r in advise.matched_names(df, "free", ["A"]).collect()] != []


def test_contained_drops_what_has_no_run(spark):
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "t string").filter(F.length("t") > 0)
    got = match.contained(one(["ab", "abc", "abcd", "q", "xyz"]), one(["zabcx", "abq", "xy"]))
    assert sorted(map(tuple, got.collect())) == [("ab", "abq"), ("ab", "zabcx"), ("abc", "zabcx"), ("q", "abq")]
