"""Checked queries: evaluation (section G). Predictions come from fixed formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktab.operators import balance, metrics
from sparktab.plans.catalog import query
from sparktab.plans.queries_profile import union

PRED = "1000 + 1450 * l_quantity"


def fixed(t):
    return t.lineitem.select(F.col("l_extendedprice").alias("y"), F.expr(PRED).alias("p"))


REG = """round(sqrt(avg(pow(y - p, 2))), 4) as rmse, round(avg(abs(y - p)), 4) as mae,
 round(1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)), 4) + 0.0 as r2"""


@query("regression_metrics", f"""with s as (select l_extendedprice as y, {PRED} as p from lineitem)
select {REG}, round(avg(abs((y - p) / y)) filter (where abs(y) > 1e-8) * 100, 4) as mape from s""")
def _(t):
    return metrics.regression_metrics(fixed(t), "y", "p")


@query("regression_metrics_by_group", f"""with s as (select l_returnflag, l_extendedprice as y, {PRED} as p from lineitem)
select l_returnflag, {REG}, round(avg(abs((y - p) / y)) filter (where abs(y) > 1e-8) * 100, 4) as mape from s group by 1""")
def _(t):
    df = t.lineitem.select("l_returnflag", F.col("l_extendedprice").alias("y"), F.expr(PRED).alias("p"))
    return metrics.regression_metrics(df, "y", "p", ["l_returnflag"])


@query("mape", f"""select round(avg(abs((l_extendedprice - ({PRED})) / l_extendedprice)) * 100, 4) as mape from lineitem""")
def _(t):
    return metrics.regression_metrics(fixed(t), "y", "p").select("mape")


# three classes by thresholds of the price, never predicting the rare fourth
CLS = """case when o_totalprice > 300000 then 'O' when o_totalprice > 150000 then 'F' else 'P' end"""


def classes(t):
    return t.orders.select(F.col("o_orderstatus").alias("y"), F.expr(CLS).alias("p"))


BASE = f"with s as (select o_orderstatus as y, {CLS} as p from orders)"


@query("confusion_matrix", BASE + """, k as (select y as k from s union select p from s)
select a.k as label, b.k as prediction, (select count(*) from s where y = a.k and p = b.k) as n from k a, k b""")
def _(t):
    return metrics.confusion_matrix(classes(t), "y", "p")


REPORT = """, k as (select distinct y as k from s), r as (select k as class,
 count(*) filter (where y = k and p = k) as tp, count(*) filter (where y = k) as sup, count(*) filter (where p = k) as cho
 from k, s group by k), f as (select *, coalesce(tp / nullif(cho, 0), 0)::double as pr, coalesce(tp / nullif(sup, 0), 0)::double as re from r),
 g as (select *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) as f1 from f)"""


@query("per_class_report", BASE + REPORT + """ select class, round(pr, 4) as precision, round(re, 4) as recall,
 round(f1, 4) as f1, sup as support from g""")
def _(t):
    return metrics.per_class_report(classes(t), "y", "p")


MULTI = """ select round(sum(tp) / sum(sup)::double, 4) as accuracy, round(sum(f1 * sup) / sum(sup), 4) as f1,
 round(sum(pr * sup) / sum(sup), 4) as precision, round(sum(re * sup) / sum(sup), 4) as recall,
 round((sum(tp)::double * sum(sup) - sum(sup::double * cho)) / sqrt((pow(sum(sup), 2) - sum(pow(cho, 2))) * (pow(sum(sup), 2) - sum(pow(sup, 2)))), 4) as mcc,
 round((sum(tp) / sum(sup)::double - sum(sup::double * cho) / pow(sum(sup), 2)) / (1 - sum(sup::double * cho) / pow(sum(sup), 2)), 4) as kappa from g"""


@query("classification_metrics", BASE + REPORT + MULTI)
def _(t):
    return metrics.classification_metrics(classes(t), "y", "p")


@query("accuracy", BASE + " select round(avg((y = p)::int), 4) as accuracy from s")
def _(t):
    return metrics.classification_metrics(classes(t), "y", "p").select("accuracy")


@query("mcc", BASE + REPORT + MULTI.replace(" select ", " select mcc from (select ", 1) + ")")
def _(t):
    return metrics.classification_metrics(classes(t), "y", "p").select("mcc")


@query("cohen_kappa", BASE + REPORT + MULTI.replace(" select ", " select kappa from (select ", 1) + ")")
def _(t):
    return metrics.classification_metrics(classes(t), "y", "p").select("kappa")


BIN = "with s as (select (l_returnflag = 'R')::int as y, (l_discount >= 0.05)::int as p, l_discount * 10 as score from lineitem)"


def binary(t):
    return t.lineitem.select((F.col("l_returnflag") == "R").cast("int").alias("y"),
                             (F.col("l_discount") >= 0.05).cast("int").alias("p"),
                             (F.col("l_discount") * 10).alias("score"))


@query("f1_precision_recall_binary", BIN + """, r as (select count(*) filter (where y = 1 and p = 1)::double as tp,
 sum(y)::double as sup, sum(p)::double as cho from s) select round(2 * tp / (sup + cho), 4) as f1, round(tp / cho, 4) as precision,
 round(tp / sup, 4) as recall from r""")
def _(t):
    return metrics.classification_metrics(binary(t), "y", "p", 1).select("f1", "precision", "recall")


PARTKEYS = """with s as (select l_partkey as y, case when l_linenumber % 3 = 0 then l_partkey + 1 else l_partkey end as p from lineitem)"""


def part_guesses(t):
    """As many classes as there are parts."""
    return t.lineitem.select(F.col("l_partkey").alias("y"), F.expr("case when l_linenumber % 3 = 0 then l_partkey + 1 else l_partkey end").alias("p"))


@query("confusion_matrix_many", PARTKEYS + " select y as label, p as prediction, count(*) as n from s group by 1, 2")
def _(t):
    return metrics.confusion_matrix(part_guesses(t), "y", "p", zeros=False)


@query("per_class_report_many", PARTKEYS + """, a as (select y as class, count(*) as sup, count(*) filter (where y = p) as tp from s group by 1),
b as (select p as class, count(*) as cho from s group by 1), f as (select class, coalesce(sup, 0) as sup, coalesce(tp / nullif(cho, 0), 0)::double as pr,
 coalesce(tp / nullif(sup, 0), 0)::double as re from a full join b using (class))
select class, round(pr, 4) as precision, round(re, 4) as recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 4) as f1, sup::bigint as support from f""")
def _(t):
    return metrics.per_class_report(part_guesses(t), "y", "p")


@query("classification_metrics_many", PARTKEYS + """, a as (select y as class, count(*) as sup, count(*) filter (where y = p) as tp from s group by 1),
b as (select p as class, count(*) as cho from s group by 1), f as (select coalesce(sup, 0) as sup, coalesce(cho, 0) as cho, coalesce(tp, 0) as tp, coalesce(tp / nullif(cho, 0), 0)::double as pr,
 coalesce(tp / nullif(sup, 0), 0)::double as re from a full join b using (class)), g as (select *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) as f1 from f)""" + MULTI)
def _(t):
    return metrics.classification_metrics(part_guesses(t), "y", "p")


@query("class_weights_many", """with c as (select l_partkey, count(*) as n from lineitem group by 1)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round((select sum(n) from c) / ((select count(*) from c) * n)::double, 6) as weight from lineitem join c using (l_partkey)""")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return balance.class_weights(df, "l_partkey").withColumn("weight", F.round("weight", 6))


RANKS = """select avg(r) filter (where y = 1) as m, count(*) filter (where y = 1)::double as p, count(*) filter (where y = 0)::double as n
 from (select y, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as r from s)"""


@query("auc_binary", BIN + f" select round((m - (p + 1) / 2) / n, 4) as auc from ({RANKS})")
def _(t):
    auc = metrics.auc_binary(binary(t), F.col("y") == 1, F.col("score"))
    return t.spark.createDataFrame([(round(auc, 4),)], "auc double")


OVR = {"F": "o_totalprice", "O": "-o_totalprice", "P": "o_totalprice % 1000"}


@query("auc_ovr_weighted", "with a as (" + union(f"""select round((m - (p + 1) / 2) / n, 12) as auc, p from (with s as (
 select (o_orderstatus = '{k}')::int as y, {e} as score from orders) {RANKS})""" for k, e in OVR.items())
       + ") select round(sum(auc * p) / sum(p), 4) as auc from a")
def _(t):
    df = t.orders.select("o_orderstatus", *[F.expr(e).alias("s" + k) for k, e in OVR.items()])
    auc = metrics.auc_ovr_weighted(df, "o_orderstatus", {k: "s" + k for k in OVR})
    return t.spark.createDataFrame([(round(auc, 4),)], "auc double")


ROC = """ select distinct score as threshold, round(sum(1 - y) over (order by score desc) / (select sum(1 - y) from s)::double, 6) as fpr,
 round(sum(y) over (order by score desc) / (select sum(y) from s)::double, 6) as tpr from s"""


@query("roc_curve", BIN + ROC)
def _(t):
    return metrics.roc_curve(binary(t), F.col("y") == 1, F.col("score"))


@query("roc_curve_micro", "with s as (" + union(
    f"select (l_returnflag = '{k}')::int as y, {e} as score from lineitem"
    for k, e in [("A", "l_discount"), ("N", "l_tax"), ("R", "l_quantity / 100")]) + ")" + ROC)
def _(t):
    df = t.lineitem.select("l_returnflag", "l_discount", "l_tax", (F.col("l_quantity") / 100).alias("q"))
    return metrics.roc_micro(df, "l_returnflag", {"A": "l_discount", "N": "l_tax", "R": "q"})


@query("multi_output_metrics", f"""with a as (select l_extendedprice as y, {PRED} as p from lineitem),
b as (select l_quantity as y, l_extendedprice / 1450 as p from lineitem),
m as (select 'price' as target, {REG} from a union all select 'quantity', {REG} from b)
select * from m union all select 'mean', round(avg(rmse), 4), round(avg(mae), 4), round(avg(r2), 4) from m""")
def _(t):
    df = t.lineitem.select(F.col("l_extendedprice").alias("y1"), F.expr(PRED).alias("p1"),
                           F.col("l_quantity").alias("y2"), F.expr("l_extendedprice / 1450").alias("p2"))
    return metrics.multi_output_metrics(df, {"price": ("y1", "p1"), "quantity": ("y2", "p2")})


@query("predicted_vs_actual", f"""with s as (select l_extendedprice as actual, ({PRED})::double as predicted from lineitem)
select *, (select least(min(actual), min(predicted)) from s) as low, (select greatest(max(actual), max(predicted)) from s) as high from s""")
def _(t):
    return metrics.predicted_vs_actual(fixed(t), "y", "p")


@query("residual_histogram", f"""with s as (select l_extendedprice - ({PRED}) as r from lineitem), m as (select min(r) as a, max(r) as b from s)
select 'residual' as "column", least(floor((r - a) / (b - a) * 30), 29)::bigint as bin, count(*) as n from s, m group by 2""")
def _(t):
    return metrics.residual_histogram(fixed(t), "y", "p")


# one "model" per brand: scores of constant guesses on the part table, some of them failed
def scores(t):
    return t.part.groupBy(F.col("p_brand").alias("model")).agg(
        F.when(F.max("p_size") >= 48, F.round(F.avg("p_retailprice"), 4)).alias("rmse"),
        F.round(F.avg((F.col("p_size") > 25).cast("int")), 4).alias("accuracy"),
        F.round(F.avg("p_size"), 1).alias("seconds"))


SCORES = """with s as (select p_brand as model, case when max(p_size) >= 48 then round(avg(p_retailprice), 4) end as rmse,
 round(avg((p_size > 25)::int), 4) as accuracy, round(avg(p_size), 1) as seconds from part group by 1)"""


@query("leaderboard", SCORES + """ select *, rmse is null as failed,
 row_number() over (order by rmse asc nulls last, model)::int as rank from s""")
def _(t):
    return metrics.leaderboard(scores(t), "regression")


@query("best_model", SCORES + " select model as best_model, accuracy as best_score from s order by accuracy desc, model limit 1")
def _(t):
    return metrics.best_model(scores(t), "Classification")


@query("metric_comparison", SCORES + " select model, 'accuracy' as metric, accuracy as value from s union all select model, 'seconds', seconds from s")
def _(t):
    return metrics.metric_comparison(scores(t), ["accuracy", "seconds"])


@query("rank_models", SCORES + """ select *, row_number() over (order by round(accuracy, 1) desc nulls last, seconds nulls last, rmse nulls last, model)::int as rank
 from (select model, rmse, round(accuracy, 1) as accuracy, seconds from s)""")
def _(t):
    return metrics.rank_models(scores(t).withColumn("accuracy", F.round("accuracy", 1)), "accuracy", True,
                               ["seconds", "rmse"])
