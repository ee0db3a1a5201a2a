"""Checked queries: profiling (section C)."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from sparktab.functions.columns import micros
from sparktab.operators import balance, profile
from sparktab.plans.catalog import query

LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
          "l_discount", "l_tax"]
HOLES = ("case when l_discount = 0 then null else l_discount end as low, "
         "case when l_discount <= 0.01 then null else l_discount end as middle, "
         "case when l_tax <= 0.02 then null else l_tax end as high, "
         "case when l_tax <= 0.04 then null else l_tax end as most, "
         "case when l_returnflag = 'N' then null else l_returnflag end as flag")


def holes(t, *extra):
    """Lineitem with nulls made by fixed rules."""
    return t.lineitem.select(
        *extra, F.expr("case when l_discount = 0 then null else l_discount end").alias("low"),
        F.expr("case when l_discount <= 0.01 then null else l_discount end").alias("middle"),
        F.expr("case when l_tax <= 0.02 then null else l_tax end").alias("high"),
        F.expr("case when l_tax <= 0.04 then null else l_tax end").alias("most"),
        F.expr("case when l_returnflag = 'N' then null else l_returnflag end").alias("flag"))


def union(parts):
    return "\nunion all ".join(parts)


@query("basic_stats", "select count(*) as total_rows, 11::bigint as total_columns from lineitem")
def _(t):
    return profile.basic_stats(t.lineitem).select("total_rows", "total_columns")


@query("missing_profile", f"with h as (select {HOLES} from lineitem) " + union(
    f"""select '{x}' as "column", count(*) - count({x}) as nulls,
    round((count(*) - count({x})) * 100.0::double / count(*), 2) as null_pct,
    round((count(*) - count({x})) * 100.0::double / count(*), 2) > 30 as high_missing from h"""
    for x in ["low", "middle", "high", "most", "flag"]))
def _(t):
    return profile.missing_profile(holes(t))


NUM_SQL = union(
    f"""select '{x}' as "column", round(avg({x}), 4) as mean, round(stddev_samp({x}), 4) as std,
    round(min({x})::double, 4) as min, round(max({x})::double, 4) as max, round(skewness({x}), 4) + 0.0 as skewness,
    abs(round(skewness({x}), 4)) > 1 as is_skewed from {tab}"""
    for x, tab in [*((x, "lineitem") for x in LI_NUM)])


@query("numeric_profile", NUM_SQL)
def _(t):
    return profile.numeric_profile(t.lineitem)


def cat_sql(cols, tab):
    return union(
        f"""select '{x}' as "column", (select count(distinct {x}) from {tab}) as n_unique,
    (select {x} from {tab} where {x} is not null group by {x} order by count(*) desc, {x} limit 1) as top,
    case when (select count(distinct {x}) from {tab}) > 100 then 'high'
      when (select count(distinct {x}) from {tab}) > 10 then 'medium' else 'low' end as cardinality"""
        for x in cols)


@query("categorical_profile", cat_sql(["p_name", "p_brand", "p_type"], "part"))
def _(t):
    return profile.categorical_profile(t.part)


@query("categorical_profile_wide", cat_sql(["o_orderstatus", "o_orderpriority"], "orders"))
def _(t):
    return profile.categorical_profile(t.orders)


CORR = LI_NUM + ["net"]


@query("correlation_pairs", "with n as (select *, round(l_extendedprice * (1 - l_discount), 2) as net from lineitem) "
       + union(f"""select '{a}' as "left", '{b}' as "right", round(corr({a}, {b}), 4) + 0.0 as r,
       abs(corr({a}, {b})) > 0.95 as is_high from n""" for a, b in itertools.combinations(CORR, 2)))
def _(t):
    df = t.lineitem.withColumn("net", F.round(F.expr("l_extendedprice * (1 - l_discount)"), 2))
    return profile.correlation_pairs(df, CORR)


def gappy():
    """23 columns of lineitem, each with gaps of its own."""
    base = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey", "l_linenumber"]
    return {f"g{i}": f"case when (l_orderkey * 31 + l_linenumber * 7) % {i + 5} = 0 then null else {base[i % 7]} * {1 + i // 7}.0 + {base[(i * 3 + 1) % 7]} * {i % 4}.0 end"
            for i in range(23)}


@query("correlation_pairs_many", "with n as (select " + ", ".join(f"({e})::double as {k}" for k, e in gappy().items()) + " from lineitem) "
       + union(f"""select '{a}' as "left", '{b}' as "right", round(corr({a}, {b}), 4) + 0.0 as r, abs(corr({a}, {b})) > 0.95 as is_high from n"""
               for a, b in itertools.combinations(gappy(), 2)))
def _(t):
    return profile.correlation_pairs(t.lineitem.select(*[F.expr(e).cast("double").alias(k) for k, e in gappy().items()]))


TYPES = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_custkey"]


@query("target_type", union(
    f"""select '{x}' as "column", case when count(distinct {x}) <= 10 then 'classification' else 'regression' end
    as task_type from orders""" for x in TYPES) + """
    union all select 'l_linenumber', case when count(distinct l_linenumber) <= 10 then 'classification' else 'regression' end from lineitem""")
def _(t):
    found = [(k, v) for df, cols in ((t.orders, TYPES), (t.lineitem, ["l_linenumber"]))
             for k, v in profile.target_types(df, cols).items()]
    return t.spark.createDataFrame(found, "column string, task_type string")


@query("class_distribution", """
with g as (select o_orderstatus as "class", count(*) as n from orders group by 1)
select "class", n, round(n / (select sum(n) from g)::double, 6) as share,
 round((select min(n) from g) / (select sum(n) from g)::double, 4) as min_share,
 (select min(n) from g) / (select sum(n) from g)::double < 0.1 as imbalanced from g""")
def _(t):
    return profile.class_distribution(t.orders, "o_orderstatus")


def advice_sql(cond):
    return f"""select count(*) as classes, round(min(n) / sum(n)::double, 4) as min_share,
 min(n) / sum(n)::double < 0.1 as imbalanced,
 case when count(*) < 2 then 'skipped' when min(n) / sum(n)::double < 0.05 then 'SMOTE + class_weight'
  when min(n) / sum(n)::double < 0.1 then 'class_weight' else 'balanced' end as advice
 from (select {cond} as y, count(*) as n from lineitem group by 1)"""


@query("imbalance_advice", advice_sql("l_quantity >= 48"))
def _(t):
    return profile.imbalance_advice(t.lineitem.select((F.col("l_quantity") >= 48).alias("y")), "y")


@query("imbalance_advice_severe", advice_sql("l_quantity = 50"))
def _(t):
    return profile.imbalance_advice(t.lineitem.select((F.col("l_quantity") == 50).alias("y")), "y")


@query("class_weights", """
with g as (select (l_quantity >= 48)::int as y, count(*) as n from lineitem group by 1)
select l_orderkey, l_linenumber, (l_quantity >= 48)::int as y,
 round((select sum(n) from g) / ((select count(*) from g) * g.n)::double, 6) as weight
from lineitem join g on g.y = (l_quantity >= 48)::int""")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_quantity") >= 48).cast("int").alias("y"))
    return balance.class_weights(df, "y").withColumn("weight", F.round("weight", 6))


@query("full_profile", f"""
with h as (select l_quantity, {HOLES} from lineitem), g as (select flag, count(*) as n from h where flag is not null group by 1)
""" + union(
    [f"""select 'missing' as section, '{x}' as "column", 'nulls' as metric, (count(*) - count({x}))::double as value from h
    union all select 'missing', '{x}', 'null_pct', round((count(*) - count({x})) * 100.0::double / count(*), 2) from h"""
     for x in ["l_quantity", "low", "middle", "high", "most", "flag"]]
    + [f"""select 'numeric', '{x}', '{m}', round({e.format(x)}, 4) + 0.0 from h"""
       for x in ["l_quantity", "low", "middle", "high", "most"]
       for m, e in [("mean", "avg({})"), ("std", "stddev_samp({})"), ("min", "min({})"), ("max", "max({})"),
                    ("skewness", "skewness({})")]]
    + ["select 'categorical', 'flag', 'n_unique', count(*)::double from g",
       "select 'class', flag, 'n', n::double from g",
       "select 'class', flag, 'share', round(n / (select sum(n) from g)::double, 6) from g"]))
def _(t):
    return profile.full_profile_long(holes(t, "l_quantity"), "flag")


@query("target_moments", """
with m as (select avg(value) as m from events)
select round(avg(value), 2) as target_mean, round(stddev_samp(value), 2) as target_std,
 round(avg(pow(value - m, 3)) / pow(avg(pow(value - m, 2)), 1.5), 2) as target_skewness from events, m""")
def _(t):
    return profile.target_moments(t.events, "value")


LIN = ["l_linenumber", "l_quantity", "l_discount", "l_tax"]


@query("linearity", f"""with m as (select ({' + '.join(f'abs(corr({x}, l_extendedprice))' for x in LIN)}) / 4 as v from lineitem)
select round(v, 4) as mean_abs_r, case when v > 0.5 then 'High' else 'Low' end as linearity from m""")
def _(t):
    return profile.linearity(t.lineitem.select(*LIN, "l_extendedprice"), "l_extendedprice")


@query("time_frequency", """
select quantile_cont(gap, 0.5) as median_gap_us from (
 select epoch_us(ts) - lag(epoch_us(ts)) over (order by ts, event_id) as gap from events)""")
def _(t):
    gap = profile.time_frequency(t.events, "ts", "event_id", limit=0)
    return t.spark.createDataFrame([(gap,)], "median_gap_us double")


@query("adf_stationarity", """
with s as (select value, lag(value) over (order by ts, event_id) as prev from events),
r as (select value - prev as dy, prev as x from s where prev is not null),
f as (select count(*) as n, regr_slope(dy, x) as b, regr_sxx(dy, x) as sxx, regr_syy(dy, x) as syy from r)
select n + 1 as n, 0::bigint as lag, round(b / sqrt((syy - b * b * sxx) / (n - 2) / sxx), 4) as statistic,
 'Stationary' as verdict from f""")
def _(t):
    df = t.events.select("ts", "event_id", "value")
    r = profile.adf_stationarity(df, "value", ["ts", "event_id"], max_lag=0)
    return t.spark.createDataFrame([(r["n"], r["lag"], round(r["statistic"], 4), r["verdict"])],
                                   "n bigint, lag bigint, statistic double, verdict string")


@query("adf_stationarity_auto")
def _(t):
    r = profile.adf_stationarity(t.events.select("ts", "event_id", "value"), "value", ["ts", "event_id"])
    return t.spark.createDataFrame([(r["n"], r["lag"], r["statistic"], r["p_value"], r["verdict"])],
                                   "n bigint, lag bigint, statistic double, p_value double, verdict string")


@query("adf_by_series", """
with s as (select user_id, value, lag(value) over (partition by user_id order by ts, event_id) as prev from events),
r as (select user_id, value - prev as dy, prev as x from s where prev is not null),
f as (select user_id, count(*) as n, regr_slope(dy, x) as b, regr_sxx(dy, x) as sxx, regr_syy(dy, x) as syy from r group by 1)
select user_id, (select count(*) from events e where e.user_id = u.user_id) as n, case when n >= 19 then 0::bigint end as lag,
 case when n >= 19 then round(b / sqrt((syy - b * b * sxx) / (n - 2) / sxx), 4) end as statistic from (select distinct user_id from events) u left join f using (user_id)""")
def _(t):
    out = profile.adf_by_series(t.events, ["user_id"], "value", ["ts", "event_id"], max_lag=0)
    return out.select("user_id", "n", "lag", (F.round("statistic", 4) + 0.0).alias("statistic"))


OUT = ["value", "event_id"]


@query("zscore_outlier_flag", union(
    f"""select '{x}' as "column", max(abs({x} - m)) > 3 * max(s) as has_outliers
    from events, (select avg({x}) as m, stddev_samp({x}) as s from events)""" for x in OUT))
def _(t):
    return t.spark.createDataFrame(list(profile.zscore_outlier_flags(t.events, OUT).items()),
                                   "column string, has_outliers boolean")


@query("heavy_outlier_share", union(
    f"""select '{x}' as "column", round(count(*) filter (where {x} < a - 3 * (b - a) or {x} > b + 3 * (b - a)) / count(*)::double, 6) as share
    from events, (select quantile_cont({x}, 0.25) as a, quantile_cont({x}, 0.75) as b from events)""" for x in OUT))
def _(t):
    got = profile.heavy_outlier_shares(t.events, OUT)
    return t.spark.createDataFrame([(k, round(v, 6)) for k, v in got.items()], "column string, share double")


HIST = ["l_quantity", "l_extendedprice", "l_discount", "l_partkey"]


@query("histogram", union(
    f"""select '{x}' as "column", least(floor(({x}::double - a) / (b - a) * 30), 29)::bigint as bin, count(*) as n
    from lineitem, (select min({x})::double as a, max({x})::double as b from lineitem) group by 2""" for x in HIST))
def _(t):
    return profile.histogram(t.lineitem, HIST)


@query("class_balance", 'select l_returnflag as "class", count(*) as n from lineitem group by 1')
def _(t):
    return profile.class_balance(t.lineitem, "l_returnflag")


@query("dataset_analysis", """
with s as (select value, epoch_us(ts) - lag(epoch_us(ts)) over (order by ts, event_id) as gap from events),
m as (select avg(value) as m from events)
select count(*) as total_rows, 4::int as total_columns, 0::bigint as missing_values, true as is_time_series,
 (select cast(trunc(quantile_cont(gap, 0.5)) as bigint) from s) as time_gap_us, 'regression' as task_type,
 round(avg(value), 2) as target_mean, round(stddev_samp(value), 2) as target_std,
 round(avg(pow(value - m, 3)) / pow(avg(pow(value - m, 2)), 1.5), 2) as target_skewness,
 case when (abs(corr(event_id, value)) + abs(corr(user_id, value))) / 2 > 0.5 then 'High' else 'Low' end as linearity
from events, m""")
def _(t):
    df = t.events.select("event_id", "user_id", "ts", "value")
    return profile.dataset_analysis(df, "value", "ts", "event_id").select(
        "total_rows", "total_columns", "missing_values", "is_time_series", "time_gap_us", "task_type",
        "target_mean", "target_std", "target_skewness", "linearity")
