"""Checked queries: time series (sections J and M) and neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktab.functions.columns import c, unit_hash
from sparktab.functions.order import series_window
from sparktab.operators import neighbors as nb
from sparktab.operators import split
from sparktab.operators import timeseries as ts
from sparktab.plans.catalog import query
from sparktab.plans.queries_profile import union
from sparktab.plans.queries_transform import SLOT, rounds

KEY, ORD = ["user_id"], ["ts", "event_id"]
WIN = "partition by user_id order by ts, event_id"


def ev(t, *cols):
    return t.events.select("event_id", "user_id", "ts", "value", *cols)


def gappy(t):
    return ev(t).withColumn("value", F.expr("case when value < 2 then null else value end"))


GAPPY = "with g as (select event_id, user_id, ts, case when value < 2 then null else value end as value from events)"


@query("lag_features", f"""select event_id, lag(value, 1) over (w) as value_lag_1, lag(value, 5) over (w) as value_lag_5,
 lag(value, 10) over (w) as value_lag_10 from events window w as ({WIN})""")
def _(t):
    return ts.lag_features(ev(t), KEY, ORD, "value").drop("user_id", "ts", "value")


@query("lag_features_one_series", """select event_id, lag(value, 1) over (w) as value_lag_1, lag(value, 5) over (w) as value_lag_5,
 lag(value, 10) over (w) as value_lag_10 from events window w as (order by ts, event_id)""")
def _(t):
    return ts.lag_features(ev(t), [], ORD, "value", limit=0, block=1000).drop("user_id", "ts", "value")


@query("rolling_stats", f"""select event_id, round(avg(value) over (w rows between 6 preceding and current row), 6) as value_mean_7,
 round(stddev_samp(value) over (w rows between 6 preceding and current row), 6) as value_std_7 from events window w as ({WIN})""")
def _(t):
    return rounds(ts.rolling_stats(ev(t), KEY, ORD, "value").drop("user_id", "ts", "value"), "value_mean_7", "value_std_7")


@query("differencing", f"select event_id, round(value - lag(value) over ({WIN}), 6) + 0.0 as value_diff_1 from events")
def _(t):
    return rounds(ts.differencing(ev(t), KEY, ORD, "value").drop("user_id", "ts", "value"), "value_diff_1")


@query("seasonal_differencing", f"""select event_id, round((value - lag(value) over (w)) - (lag(value, 12) over (w) - lag(value, 13) over (w)), 6) + 0.0
 as value_sdiff from events window w as ({WIN})""")
def _(t):
    return rounds(ts.seasonal_differencing(ev(t), KEY, ORD, "value").drop("user_id", "ts", "value"), "value_sdiff")


PH = "(2 * pi() * (epoch_us(ts) % 86400000000) / 86400000000.0::double)"


@query("fourier_features", "select event_id, " + ", ".join(
    f"round({f}({PH} * {k}), 6) + 0.0 as season_{f}{k}" for k in (1, 2) for f in ("sin", "cos")) + " from events")
def _(t):
    df = ts.fourier_features(t.events.select("event_id", "ts"), "ts", 86_400_000_000).drop("ts")
    return rounds(df, *[x for x in df.columns if x != "event_id"])


@query("forward_fill", GAPPY + f" select event_id, last_value(value ignore nulls) over ({WIN} rows unbounded preceding) as value_ffill from g")
def _(t):
    return ts.forward_fill(gappy(t), KEY, ORD, "value").select("event_id", "value_ffill")


@query("forward_fill_one_series", GAPPY + " select event_id, last_value(value ignore nulls) over (order by ts, event_id rows unbounded preceding) as value_ffill from g")
def _(t):
    return ts.forward_fill(gappy(t), [], ORD, "value", limit=0).select("event_id", "value_ffill")


@query("backward_fill", GAPPY + f""" select event_id, first_value(value ignore nulls) over ({WIN} rows between current row and unbounded following)
 as value_bfill from g""")
def _(t):
    return ts.backward_fill(gappy(t), KEY, ORD, "value").select("event_id", "value_bfill")


@query("interpolate_linear", GAPPY + f""", f as (select event_id, value, epoch_us(ts)::double as t,
 last_value(value ignore nulls) over ({WIN} rows unbounded preceding) as av,
 last_value(case when value is not null then epoch_us(ts)::double end ignore nulls) over ({WIN} rows unbounded preceding) as ta,
 first_value(value ignore nulls) over ({WIN} rows between current row and unbounded following) as bv,
 first_value(case when value is not null then epoch_us(ts)::double end ignore nulls) over ({WIN} rows between current row and unbounded following) as tb from g)
select event_id, round(coalesce(value, av + (bv - av) * (t - ta) / nullif(tb - ta, 0)), 6) as value_interp from f""")
def _(t):
    return rounds(ts.interpolate_linear(gappy(t), KEY, ORD, "value", "ts").select("event_id", "value_interp"), "value_interp")


@query("moving_average", f"select event_id, round(avg(value) over ({WIN} rows between 2 preceding and 2 following), 6) as value_ma from events")
def _(t):
    return rounds(ts.moving_average(ev(t), KEY, ORD, "value").select("event_id", "value_ma"), "value_ma")


@query("median_filter", f"""select event_id, round(quantile_cont(value, 0.5) over ({WIN} rows between 2 preceding and 2 following), 6)
 as value_median from events""")
def _(t):
    return rounds(ts.median_filter(ev(t), KEY, ORD, "value").select("event_id", "value_median"), "value_median")


@query("interaction_feature", "select l_orderkey, l_linenumber, l_quantity, l_tax, round(l_quantity * l_tax, 6) as power from lineitem")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return rounds(ts.interaction_feature(df, "l_quantity", "l_tax"), "power")


IDS = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]


@query("id_column_flag", union(f"""select '{x}' as "column", count(distinct {x}) > 50 as is_id_like from customer""" for x in IDS))
def _(t):
    return ts.id_column_flags(t.customer, IDS)


@query("positive_class_weight", """with s as (select doc_id, toxic from labels)
select doc_id, toxic, round(case when toxic = 1 then (select count(*) filter (where toxic = 0) / count(*) filter (where toxic = 1)::double from s) else 1 end, 6) as weight from s""")
def _(t):
    return rounds(ts.positive_class_weight(t.labels.select("doc_id", "toxic"), "toxic"), "weight")


@query("lookback_sequences", f"""select event_id, value, s as sequence from (select event_id, value,
 list(value) over ({WIN} rows between 10 preceding and 1 preceding) as s from events) where len(s) = 10""")
def _(t):
    return ts.lookback_sequences(ev(t), KEY, ORD, "value").select("event_id", "value", "sequence")


@query("minmax_target", """with m as (select min(value) as lo, max(value) - min(value) + 1e-8::double as span from events)
select event_id, round((value - lo) / span, 6) as scaled, round(value, 4) as value from events, m""")
def _(t):
    df = t.events.select("event_id", "value")
    lo, span = ts.minmax_target(df, "value")
    out = ts.scale_target(df, "value", lo, span, "scaled")
    return rounds(rounds(ts.unscale_target(out, "scaled", lo, span, "value"), "scaled"), "value", digits=4)


@query("ar_forecast")
def _(t):
    return ts.ar_forecast(ev(t), KEY, ORD, "value", 5)


@query("ar_forecast_one_series")
def _(t):
    return ts.ar_forecast(ev(t), [], ORD, "value", 10, limit=0)


@query("seasonal_ar_forecast")
def _(t):
    return ts.ar_forecast(ev(t), KEY, ORD, "value", 5, lags=(1, 12, 13), season=12)


@query("arma_forecast")
def _(t):
    return ts.arma_forecast(ts.arma_fit(ev(t), KEY, ORD, "value", long=8), KEY, 5)


@query("arma_coefficients", "select true as phi_found, true as theta_found")
def _(t):
    """Shocks from a hash of the events' ids make a series with known coefficients 0.5 and 0.4, which the fit gives back."""
    e = t.events.select("event_id", (unit_hash(F.col("event_id"), "shock") - 0.5).alias("u"))
    w = lambda x: x.rowsBetween(-40, 0)
    made = series_window(e, [], ["event_id"], 40, 0, {"us": lambda x: F.collect_list("u").over(w(x))})
    at = lambda i: F.coalesce(F.get(F.reverse("us"), F.lit(i)), F.lit(0.0))
    y = sum((0.5 ** k * (at(k) + 0.4 * at(k + 1)) for k in range(30)), F.lit(0.0))
    r = ts.arma_fit(made.select("event_id", y.alias("y")), [], ["event_id"], "y", d=0).first()
    return t.spark.createDataFrame([(abs(r["phi"][0] - 0.5) < 0.05, abs(r["theta"][0] - 0.4) < 0.05)], "phi_found boolean, theta_found boolean")


@query("trend_season_forecast")
def _(t):
    df = split.split_time(ev(t), "ts", "event_id")
    return ts.trend_season_forecast(df.filter("split = 'train'"), df.filter("split = 'test'"), "ts", "value")


@query("trend_season_forecast_by_series")
def _(t):
    df = split.split_time(ev(t), "ts", "event_id")
    return ts.trend_season_forecast(df.filter("split = 'train'"), df.filter("split = 'test'"), "ts", "value", KEY, hinges=3)


@query("recursive_forecast")
def _(t):
    return ts.recursive_forecast(ev(t), KEY, ORD, "value", 5)


D2 = "round(pow(list_distance(a.embedding::double[], b.embedding::double[]), 2), 6)"
TOP = f"""(select a.vec_id as query, b.vec_id as id, b.label, {D2} as d2, row_number() over (partition by a.vec_id
 order by pow(list_distance(a.embedding::double[], b.embedding::double[]), 2), b.vec_id)::int as rank from {{}} a, {{}} b where a.vec_id <> b.vec_id)"""


@query("vector_topk", f"select query, id, d2, rank from {TOP.format('embeddings', 'embeddings')} where rank <= 3")
def _(t):
    e = t.embeddings
    out = nb.knn_join(e, e, 3, "vec_id", "vec_id", "embedding", "embedding", skip_same=True)
    return rounds(out.drop("label"), "d2")


@query("vector_topk_by_cells", f"select query, id, d2, rank from {TOP.format('embeddings', 'embeddings')} where rank <= 3")
def _(t):
    e = t.embeddings
    out = nb.knn_join(e, e, 3, "vec_id", "vec_id", "embedding", "embedding", skip_same=True, few=0, block=64, pivots=16)
    return rounds(out.drop("label"), "d2")


@query("vector_topk_approx", "select count(*) as queries, true as found from embeddings")
def _(t):
    """Neighbours from a two-level index: at least nine of ten of the exact ones, over all rows as queries."""
    e = t.embeddings
    near = nb.knn_approx(e, e, 3, "vec_id", "vec_id", "embedding", "embedding", skip_same=True, cell_rows=40)
    exact = nb.knn_join(e, e, 3, "vec_id", "vec_id", "embedding", "embedding", skip_same=True)
    return nb.recall(near, exact).select("queries", (F.col("recall") >= 0.9).alias("found"))


PARTS = f"""with s as (select *, {SLOT.format('vec_id::varchar')} % 100 < 20 as is_test from embeddings),
te as (select * from s where is_test), tr as (select * from s where not is_test), n as (select * from {TOP.format('te', 'tr')} where rank <= 5)"""


def parts(t):
    e = split.split_random(t.embeddings, "vec_id")
    return e.filter("split = 'test'"), e.filter("split = 'train'")


@query("knn_classify", PARTS + """, v as (select query, label, count(*) as n from n group by 1, 2)
select query as vec_id, label as prediction from (select *, row_number() over (partition by query order by n desc, label) as r from v) where r = 1""")
def _(t):
    return nb.knn_classify(*parts(t), "vec_id", "embedding", "label")


@query("knn_regress", PARTS + " select query as vec_id, round(avg(label), 6) as prediction from n group by 1")
def _(t):
    return rounds(nb.knn_regress(*parts(t), "vec_id", "embedding", "label"), "prediction")


@query("impute_knn", """with s as (select o.p_partkey, case when p_size <= 5 then null else p_size::double end as p_size, p_retailprice from part o),
n as (select a.p_partkey, b.p_size, row_number() over (partition by a.p_partkey order by pow(a.p_retailprice - b.p_retailprice, 2), b.p_partkey) as r
 from s a, s b where a.p_size is null and b.p_size is not null)
select p_partkey, p_retailprice, round(coalesce(p_size, (select avg(n.p_size) from n where n.p_partkey = s.p_partkey and r <= 5)), 6) as p_size from s""")
def _(t):
    df = t.part.select("p_partkey", F.expr("case when p_size <= 5 then null else double(p_size) end").alias("p_size"), "p_retailprice")
    return rounds(nb.knn_impute(df, "p_partkey", "p_size", ["p_retailprice"]), "p_size")


GAPS = """select s_suppkey, case when s_suppkey % 5 = 0 then null else s_nationkey::double end as a, case when s_suppkey % 7 = 1 then null else s_acctbal end as b,
 case when s_suppkey % 3 = 2 then null else (s_suppkey * 37 % 101)::double end as c from supplier"""


def gap_sql(x):
    return f"""(select q as s_suppkey, avg(v) as fill from (select q.s_suppkey as q, r.{x} as v, row_number() over (partition by q.s_suppkey order by
 round(3.0 / ((q.a is not null and r.a is not null)::int + (q.b is not null and r.b is not null)::int + (q.c is not null and r.c is not null)::int)
 * (coalesce(pow(q.a - r.a, 2), 0) + coalesce(pow(q.b - r.b, 2), 0) + coalesce(pow(q.c - r.c, 2), 0)), 9), r.s_suppkey) as n from g q, g r
 where q.{x} is null and r.{x} is not null and (q.a is not null and r.a is not null or q.b is not null and r.b is not null or q.c is not null and r.c is not null))
 where n <= 5 group by 1) f{x}"""


@query("impute_knn_gaps", f"""with g as ({GAPS}) select g.s_suppkey, """ + ", ".join(
    f"round(coalesce(g.{x}, f{x}.fill, (select avg({x}) from g)), 6) as {x}" for x in "abc") + " from g " + " ".join(
    f"left join {gap_sql(x)} on f{x}.s_suppkey = g.s_suppkey" for x in "abc"))
def _(t):
    df = t.supplier.select("s_suppkey", F.expr("case when s_suppkey % 5 = 0 then null else double(s_nationkey) end").alias("a"),
                           F.expr("case when s_suppkey % 7 = 1 then null else s_acctbal end").alias("b"),
                           F.expr("case when s_suppkey % 3 = 2 then null else double(s_suppkey * 37 % 101) end").alias("c"))
    return rounds(nb.gap_impute(df, "s_suppkey", ["a", "b", "c"]), "a", "b", "c")


@query("smote_counts", """with c as (select toxic, count(*) as n from labels group by 1)
select toxic, (select max(n) from c) as n, (select max(n) from c) - n as synthetic from c""")
def _(t):
    df = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id") \
        .select("doc_id", "toxic", "n_chars", c("quality"))
    out = nb.smote(df, "doc_id", "toxic", ["n_chars", "quality"])
    return out.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.count_if("synthetic").alias("synthetic"))
