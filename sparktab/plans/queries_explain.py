"""Checked queries: explanations (section H) and tuning (section I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktab.operators import explain, models, split, tune
from sparktab.plans.catalog import query
from sparktab.plans.queries_models import LI, lineitem_table, vectors, VEC
from sparktab.plans.queries_profile import union
from sparktab.plans.queries_transform import rounds

COEF = {"l_quantity": 1450.0, "l_discount": -300.0, "l_tax": 120.5}
LONG = "with s as (" + union(
    f"""select l_orderkey, l_linenumber, l_partkey, '{f}' as feature, {f} as value,
    {w} * ({f} - (select avg({f}) from lineitem)) as contribution from lineitem""" for f, w in COEF.items()) + ")"


def linear(t):
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return explain.shap_linear(t.lineitem.withColumn("key", key), "key", COEF)


@query("shap_linear", LONG.replace("l_orderkey, l_linenumber, l_partkey,", "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as key,")
       + " select key, feature, value, round(contribution, 4) + 0.0 as contribution from s")
def _(t):
    return rounds(linear(t), "contribution", digits=4)


@query("shap_importance", LONG + " select feature, round(avg(abs(contribution)), 4) as importance from s group by 1")
def _(t):
    return rounds(explain.shap_importance(linear(t)), "importance", digits=4)


@query("shap_beeswarm", LONG.replace("l_orderkey, l_linenumber, l_partkey,", "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as key,") + """,
m as (select feature, min(value) as lo, max(value) as hi, row_number() over (order by avg(abs(contribution)) desc) as r from s group by 1)
select key, feature, value, round(contribution, 4) + 0.0 as contribution, round((value - lo) / (hi - lo + 1e-8), 5) as value_norm
from s join m using (feature) where r <= 2""")
def _(t):
    out = explain.shap_beeswarm(linear(t), 2)
    return rounds(rounds(out, "contribution", digits=4), "value_norm", digits=5)


PC = {"p_size": 2.5, "p_retailprice": -0.75}


@query("shap_waterfall", "with s as (" + union(
    f"select p_partkey, '{f}' as feature, {f}::double as value, {w} * ({f} - (select avg({f}) from part)) as contribution from part"
    for f, w in PC.items()) + """)
select p_partkey, 10.0::double as base_value, list(feature order by abs(contribution) desc) as features,
 round(10 + sum(contribution), 6) as prediction from s group by 1""")
def _(t):
    lin = explain.shap_linear(t.part, "p_partkey", PC)
    return rounds(explain.shap_waterfall(lin, "p_partkey", 10.0), "prediction").drop("feature_values", "contributions")


@query("shap_dependence", LONG + " select value, round(contribution, 4) + 0.0 as contribution from s where feature = 'l_tax'")
def _(t):
    return rounds(explain.shap_dependence(linear(t), "l_tax"), "contribution", digits=4)


@query("lowess_trend")
def _(t):
    return explain.lowess_trend(t.lineitem, "l_quantity", "l_extendedprice")


def fitted(t, name, params, label="l_extendedprice", task="regression"):
    data = models.assemble(lineitem_table(t), LI, label, "row")
    return data, models.make_estimator(name, task, data.count(), LI, 2, params).fit(data)


@query("feature_importance")
def _(t):
    return explain.feature_importance(fitted(t, "Random Forest", {"n_estimators": 5, "max_depth": 5})[1], LI, t.spark)


def additivity(data, phi, base, out):
    """Largest gap between prediction and base plus contributions."""
    total = phi.groupBy("row_id").agg(F.sum("contribution").alias("s"))
    gap = data.join(total, "row_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(out - F.col("s") - base)).alias("gap"))
    return gap.select("n", (F.col("gap") < 1e-6).alias("additive"))


@query("shap_tree", "select count(*) as n, true as additive from (select distinct * from lineitem)")
def _(t):
    data, model = fitted(t, "Random Forest", {"n_estimators": 5, "max_depth": 5})
    trees = explain.model_trees(model, t.spark)
    data = data.dropDuplicates(["row_id"])
    phi = explain.shap_tree(data, "row_id", LI, trees)
    return additivity(model.transform(data), phi, explain.tree_base(trees), F.col("prediction"))


@query("shap_tree_classifier", "select count(*) as n, true as additive from embeddings")
def _(t):
    data = models.assemble(vectors(t), VEC, "odd", "vec_id")
    model = models.make_estimator("Random Forest", "classification", 0, VEC, 2, {"n_estimators": 5, "max_depth": 4}).fit(data)
    trees = explain.model_trees(model, t.spark)
    pred = model.transform(data)
    phi = explain.shap_tree(data, "row_id", VEC, trees)
    return additivity(pred, phi, explain.tree_base(trees), explain.output_column(pred, True))


@query("shap_linear_together", """with m as (select avg(p_size) as ms, avg(p_retailprice) as mp, var_pop(p_size) as vs, var_pop(p_retailprice) as vp,
 covar_pop(p_size, p_retailprice) as v from part)
select p_partkey, 'p_size' as feature, p_size::double as value, round((2 * 2.5 + -0.75 * v / vs) / 2 * (p_size - ms) - 2.5 * v / vp / 2 * (p_retailprice - mp), 6) + 0.0 as contribution
 from part, m union all select p_partkey, 'p_retailprice', p_retailprice, round((2 * -0.75 + 2.5 * v / vp) / 2 * (p_retailprice - mp) + 0.75 * v / vs / 2 * (p_size - ms), 6) + 0.0
 from part, m""")
def _(t):
    return rounds(explain.shap_linear(t.part, "p_partkey", PC, together=True), "contribution", digits=6)


def grown(t):
    """A tree of depth 2 with given cuts; covers and values from the rows."""
    side, low = F.col("l_quantity") <= 25, F.col("l_quantity") > 25
    leaf = (F.when(side & (F.col("l_discount") <= 0.05), 3).when(side, 4).when(low & (F.col("l_tax") <= 0.04), 5).otherwise(6))
    at = {r["leaf"]: r for r in t.lineitem.groupBy(leaf.alias("leaf")).agg(F.count(F.lit(1)).alias("n"), F.avg("l_extendedprice").alias("v")).collect()}
    n = [float(at[i]["n"]) for i in (3, 4, 5, 6)]
    return [explain.Tree([1, 3, 5, -1, -1, -1, -1], [2, 4, 6, -1, -1, -1, -1], [0, 1, 2, -1, -1, -1, -1], [25.0, 0.05, 0.04, 0, 0, 0, 0], [None] * 7,
                         [0.0, 0.0, 0.0, *(at[i]["v"] for i in (3, 4, 5, 6))], [sum(n), n[0] + n[1], n[2] + n[3], *n])]


TREE = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


@query("shap_tree_parts", f"""with s as (select distinct {TREE} as key, l_quantity as q, l_discount as d, l_tax as x from lineitem),
n as (select avg((l_quantity <= 25)::int) as p, count(*) filter (where l_quantity <= 25 and l_discount <= 0.05) / count(*) filter (where l_quantity <= 25)::double as a,
 count(*) filter (where l_quantity > 25 and l_tax <= 0.04) / count(*) filter (where l_quantity > 25)::double as b,
 avg(l_extendedprice) filter (where l_quantity <= 25 and l_discount <= 0.05) as v3, avg(l_extendedprice) filter (where l_quantity <= 25 and l_discount > 0.05) as v4,
 avg(l_extendedprice) filter (where l_quantity > 25 and l_tax <= 0.04) as v5, avg(l_extendedprice) filter (where l_quantity > 25 and l_tax > 0.04) as v6 from lineitem),
f as (select *, (q <= 25)::int as o, (d <= 0.05)::int as e, (x <= 0.04)::int as g from s, n)
select key, 'l_quantity' as feature, q as value, round((o - p) * (v3 * (a + e) + v4 * (1 - a + 1 - e)) / 2 - (o - p) * (v5 * (b + g) + v6 * (1 - b + 1 - g)) / 2, 4) + 0.0 as contribution from f
union all select key, 'l_discount', d, round((e - a) * (v3 - v4) * (p + o) / 2, 4) + 0.0 from f
union all select key, 'l_tax', x, round((g - b) * (v5 - v6) * (1 - p + 1 - o) / 2, 4) + 0.0 from f""")
def _(t):
    rows = t.lineitem.select(F.expr(TREE).alias("key"), "l_quantity", "l_discount", "l_tax").distinct()
    return rounds(explain.shap_tree(rows, "key", ["l_quantity", "l_discount", "l_tax"], grown(t)), "contribution", digits=4)


@query("shap_forest", "select count(*) as n, true as additive from supplier")
def _(t):
    """A forest of 100 trees without a limit on their depth."""
    data = models.assemble(t.supplier, ["s_suppkey", "s_nationkey"], "s_acctbal", "s_suppkey")
    model = models.make_estimator("Random Forest", "regression", 0, ["s_suppkey", "s_nationkey"], 2, {"n_estimators": 100, "max_depth": 30}).fit(data)
    trees = explain.model_trees(model, t.spark)
    return additivity(model.transform(data), explain.shap_tree(data, "row_id", ["s_suppkey", "s_nationkey"], trees), explain.tree_base(trees), F.col("prediction"))


@query("shap_kernel")
def _(t):
    df = t.part.select("p_partkey", "p_size", F.length("p_name").alias("name_length"), "p_retailprice")
    data = models.assemble(df, ["p_size", "name_length"], "p_retailprice", "p_partkey")
    model = models.make_estimator("Decision Tree", "regression", 0, [], params={"max_depth": 4}).fit(data)
    return explain.shap_kernel(data, data, "row_id", ["p_size", "name_length"], model)


def halves(t):
    df = split.split_random(lineitem_table(t), "row")
    return df.filter("split = 'train'"), df.filter("split = 'test'")


def flat(t, r):
    return t.spark.createDataFrame([(r["model"], r.get("rmse"), r.get("accuracy"), r["trials"], {k: str(v) for k, v in r["params"].items()})],
                                   "model string, rmse double, accuracy double, trials int, params map<string,string>")


@query("tune")
def _(t):
    _, r = tune.tune(*halves(t), "Ridge", "regression", LI, "l_extendedprice", "row", max_trials=8, time_budget=600)
    return flat(t, r)


@query("tune_classifier")
def _(t):
    df = vectors(t)
    _, r = tune.tune(df.filter("split = 'train'"), df.filter("split = 'test'"), "Decision Tree", "classification", VEC, "odd",
                     "vec_id", max_trials=4, time_budget=600)
    return flat(t, r)


@query("tune_time_series")
def _(t):
    ev = t.events.select("event_id", "ts", "user_id", F.hour("ts").alias("hour"), "value")
    df = split.split_time(ev, "ts", "event_id")
    _, r = tune.tune(df.filter("split = 'train'"), df.filter("split = 'test'"), "Ridge", "regression", ["user_id", "hour"], "value",
                     "event_id", max_trials=4, time_budget=600, time_col="ts")
    return flat(t, r)


@query("custom_grid")
def _(t):
    return tune.custom_grid(halves(t)[0], "Decision Tree", "regression", LI, "l_extendedprice", "row", {"max_depth": [2, 5, 8]})[1]


@query("tune_trend_model")
def _(t):
    df = split.split_time(t.events.select("event_id", "ts", "value"), "ts", "event_id")
    _, r = tune.tune_trend_model(df.filter("split = 'train'").drop("split"), df.filter("split = 'test'"), "ts", "value", "event_id",
                                 max_trials=4, time_budget=600, hinges=3)
    return t.spark.createDataFrame([(r["model"], r["holdout_rmse"], r["trials"])], "model string, holdout_rmse double, trials int")


@query("tune_ar_order")
def _(t):
    df = t.events.select("event_id", "ts", "value")
    return tune.tune_ar_order(df, "ts", "value", "event_id", orders=(1, 5))
