"""Checked queries: fitted transforms (section D) and splits (section E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktab.functions.columns import c
from sparktab.operators import encode, impute, scale, select, split, transform
from sparktab.operators.clean import BooleanNormalizer, TypeCorrector
from sparktab.operators.impute import Imputer
from sparktab.operators.encode import Encoder
from sparktab.operators.scale import Scaler
from sparktab.operators.transform import DatetimeExpander, OutlierCapper, SkewFixer
from sparktab.plans.catalog import query
from sparktab.plans.queries_profile import HOLES, holes, union


def fit_apply(step, df):
    return step.fit(df).transform(df)


def rounds(df, *names, digits=6):
    return df.withColumns({n: F.round(c(n), digits) + F.lit(0.0) for n in names})


@query("cap_outliers_iqr", """
with q as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b from events)
select event_id, round(greatest(least(value, b + 1.5 * (b - a)), a - 1.5 * (b - a)), 6) as value from events, q""")
def _(t):
    return rounds(fit_apply(OutlierCapper(columns=["value"]), t.events.select("event_id", "value")), "value")


@query("cap_outliers_zscore", """
with q as (select avg(value) as m, stddev_samp(value) as s from events)
select event_id, round(greatest(least(value, m + 3 * s), m - 3 * s), 6) as value from events, q""")
def _(t):
    df = t.events.select("event_id", "value")
    return rounds(fit_apply(OutlierCapper(method="zscore", columns=["value"]), df), "value")


@query("winsorize", """
with q as (select quantile_cont(l_extendedprice, 0.05) as a, quantile_cont(l_extendedprice, 0.95) as b from lineitem)
select l_orderkey, l_linenumber, round(greatest(least(l_extendedprice, b), a), 4) as l_extendedprice from lineitem, q""")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rounds(fit_apply(OutlierCapper(method="winsor", columns=["l_extendedprice"]), df),
                  "l_extendedprice", digits=4)


@query("fix_skew_log1p", "select event_id, round(ln(1 + value), 6) as value from events")
def _(t):
    return rounds(fit_apply(SkewFixer(columns=["value"]), t.events.select("event_id", "value")), "value")


@query("fix_skew_sqrt", "select event_id, round(sqrt(value - (select min(value) from events)), 6) as value from events")
def _(t):
    low = t.events.agg(F.min("value")).first()[0]
    df = t.events.select("event_id", (F.col("value") - low).alias("value"))
    return rounds(fit_apply(SkewFixer(columns=["value"]), df), "value")


DATE_SQL = ", ".join(f"{e}::int as {{0}}_{n}" for n, e in [
    ("year", "year(o_orderdate)"), ("month", "month(o_orderdate)"), ("day", "day(o_orderdate)"),
    ("dayofweek", "(isodow(o_orderdate) - 1)"), ("hour", "hour(o_orderdate)")])


@query("datetime_features", f"select o_orderkey, {DATE_SQL.format('o_orderdate')}, {DATE_SQL.format('txt')} from orders")
def _(t):
    df = t.orders.select("o_orderkey", "o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("txt"))
    return fit_apply(DatetimeExpander(), df)


DATE_TEXTS = {"us": "MM/dd/yyyy", "eu": "dd/MM/yyyy HH:mm:ss", "dots": "d.M.yyyy", "words": "MMM d, yyyy", "dashes": "dd-MM-yyyy HH:mm"}


@query("datetime_features_formats", "select o_orderkey, " + ", ".join(
    f"{part}(o_orderdate)::int as {x}_{part}" for x in DATE_TEXTS for part in ("year", "month", "day")) + ", " + ", ".join(
    f"(isodow(o_orderdate) - 1)::int as {x}_dayofweek, {'hour(o_orderdate)' if 'HH' in f else '0'}::int as {x}_hour" for x, f in DATE_TEXTS.items()) + " from orders")
def _(t):
    df = t.orders.select("o_orderkey", *[F.date_format("o_orderdate", f).alias(x) for x, f in DATE_TEXTS.items()])
    return fit_apply(DatetimeExpander(), df)


@query("transform_all", f"""
with e as (select *, case when event_type = 'view' then 'yes' else 'no' end as flag,
  json_extract_string(props, '$.k')::double as k from events),
q as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b from e)
select event_id, case when flag = 'yes' then 1 else 0 end as flag, k, year(ts)::int as ts_year, month(ts)::int as ts_month,
  day(ts)::int as ts_day, (isodow(ts) - 1)::int as ts_dayofweek, hour(ts)::int as ts_hour,
  round(case when (select skewness(greatest(least(value, b + 1.5 * (b - a)), a - 1.5 * (b - a))) from e, q) > 1
   then ln(1 + greatest(least(value, b + 1.5 * (b - a)), a - 1.5 * (b - a)))
   else greatest(least(value, b + 1.5 * (b - a)), a - 1.5 * (b - a)) end, 6) as value from e, q""")
def _(t):
    df = t.events.select("event_id", F.when(F.col("event_type") == "view", "yes").otherwise("no").alias("flag"),
                         F.get_json_object("props", "$.k").alias("k"), "ts", "value")
    for step in (BooleanNormalizer(), TypeCorrector(), DatetimeExpander(),
                 OutlierCapper(exclude=["event_id", "flag"]),
                 SkewFixer(exclude=["event_id", "flag"])):
        df = fit_apply(step, df)
    return rounds(df, "value")


@query("choose_imputation", f"with h as (select {HOLES} from lineitem), p as (" + union(
    f"""select '{x}' as "column", (count(*) - count({x})) * 100.0 / count(*) as pct, {num} as num from h"""
    for x, num in [("low", True), ("middle", True), ("high", True), ("most", True), ("flag", False)]) + """)
select "column", case when pct > 50 then 'drop' when not num then 'mode' when pct < 5 then 'median'
 when pct < 30 then 'knn' else 'median' end as strategy from p""")
def _(t):
    plan = Imputer().fit(holes(t))["plan"]
    return t.spark.createDataFrame(list(plan.items()), "column string, strategy string")


@query("impute_median", f"""with h as (select l_orderkey, l_linenumber, {HOLES} from lineitem)
select l_orderkey, l_linenumber, round(coalesce(high, (select quantile_cont(high, 0.5) from h)), 6) as high from h""")
def _(t):
    df = holes(t, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "high")
    return rounds(fit_apply(Imputer(columns=["high"]), df), "high")


@query("impute_mode", f"""with h as (select l_orderkey, l_linenumber, {HOLES} from lineitem)
select l_orderkey, l_linenumber, coalesce(flag, (select flag from h where flag is not null group by 1 order by count(*) desc, 1 limit 1)) as flag from h""")
def _(t):
    df = holes(t, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "flag")
    return fit_apply(Imputer(), df)


@query("impute_mean", f"""with h as (select l_orderkey, l_linenumber, {HOLES} from lineitem)
select l_orderkey, l_linenumber, round(coalesce(middle, (select avg(middle) from h)), 6) as middle from h""")
def _(t):
    df = holes(t, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "middle")
    return rounds(fit_apply(Imputer(columns=["middle"]), df), "middle")


@query("drop_sparse_columns", f"with h as (select l_orderkey, {HOLES} from lineitem) select l_orderkey from h")
def _(t):
    return fit_apply(Imputer(), holes(t, "l_orderkey").select("l_orderkey", "most"))


@query("apply_imputation", f"""with h as (select l_orderkey, l_linenumber, {HOLES} from lineitem),
f as (select * from h where l_linenumber <= 3)
select l_orderkey, l_linenumber, round(coalesce(low, (select case when (count(*) - count(low)) * 100.0 / count(*) between 5 and 29.999999
  then avg(low) else quantile_cont(low, 0.5) end from f)), 6) as low,
 coalesce(flag, (select flag from f where flag is not null group by 1 order by count(*) desc, 1 limit 1)) as flag
from h where l_linenumber > 3""")
def _(t):
    df = holes(t, "l_orderkey", "l_linenumber").drop("middle", "high", "most")
    fitted = Imputer().fit(df.filter("l_linenumber <= 3"))
    return rounds(fitted.transform(df.filter("l_linenumber > 3")), "low")


ENC = [("p_brand", "part"), ("p_name", "part"), ("p_type", "part"), ("o_orderstatus", "orders"),
       ("l_linestatus", "lineitem"), ("c_name", "customer")]


@query("choose_encoding", union(
    f"""select '{x}' as "column", case when n <= 2 then 'label' when n <= 10 then 'onehot' when n <= 100 then 'target'
    else 'frequency' end as encoding from (select count(distinct {x}) as n from {tab})""" for x, tab in ENC))
def _(t):
    rows = []
    for tab in dict.fromkeys(tab for _, tab in ENC):
        n = encode.distinct_counts(getattr(t, tab), [x for x, y in ENC if y == tab])
        rows += [(x, encode.choose_encoding(v)) for x, v in n.items()]
    return t.spark.createDataFrame(rows, "column string, encoding string")


@query("fill_missing_category", f"""with h as (select l_orderkey, l_linenumber, {HOLES} from lineitem)
select l_orderkey, l_linenumber, coalesce(flag, '__MISSING__') as flag from h""")
def _(t):
    df = holes(t, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "flag")
    return encode.fill_missing_category(df, ["flag"])


@query("encode_label", """with m as (select p_name, (dense_rank() over (order by p_name) - 1)::int as code from part
  where p_brand <> 'Brand#2' group by 1)
select p_partkey, coalesce(code, -1) as p_name from part left join m using (p_name)""")
def _(t):
    df = t.part.select("p_partkey", "p_name", "p_brand")
    m = Encoder(strategy="label", columns=["p_name"]).fit(df.filter("p_brand <> 'Brand#2'"))
    return m.transform(df).select("p_partkey", "p_name")


@query("encode_label_many", """with m as (select c_name, (dense_rank() over (order by c_name) - 1)::int as code from customer
  where c_nationkey <> 3 group by 1)
select c_custkey, coalesce(code, -1) as c_name from customer left join m using (c_name)""")
def _(t):
    df = t.customer.select("c_custkey", "c_name", "c_nationkey")
    m = Encoder(strategy="label", columns=["c_name"]).fit(df.filter("c_nationkey <> 3"))
    return m.transform(df).select("c_custkey", "c_name")


PRIO = ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("encode_onehot", "select o_orderkey, " + ", ".join(
    f"""(o_orderpriority = '{p}')::int as "o_orderpriority_{p}" """ for p in PRIO) + " from orders")
def _(t):
    return fit_apply(Encoder(), t.orders.select("o_orderkey", "o_orderpriority"))


@query("encode_target", """
with f as (select * from part where p_brand <> 'Brand#2'), m as (select p_brand, avg(p_retailprice) as v from f group by 1)
select p_partkey, round(coalesce(v, (select avg(p_retailprice) from f)), 6) as p_brand, p_retailprice
from part left join m using (p_brand)""")
def _(t):
    df = t.part.select("p_partkey", "p_brand", "p_retailprice")
    m = Encoder(target="p_retailprice", columns=["p_brand"]).fit(df.filter("p_brand <> 'Brand#2'"))
    return rounds(m.transform(df), "p_brand")


@query("encode_frequency", """
with f as (select * from part where p_brand <> 'Brand#2'), m as (select p_brand, count(*) / (select count(*) from f)::double as v from f group by 1)
select p_partkey, round(coalesce(v, 0), 6) as p_brand from part left join m using (p_brand)""")
def _(t):
    df = t.part.select("p_partkey", "p_brand")
    m = Encoder(strategy="frequency").fit(df.filter("p_brand <> 'Brand#2'"))
    return rounds(m.transform(df), "p_brand")


@query("encode_frequency_many", """
with m as (select o_custkey, count(*) / (select count(*) from orders)::double as v from orders group by 1)
select o_orderkey, round(v, 9) as cust from orders join m using (o_custkey)""")
def _(t):
    df = t.orders.select("o_orderkey", F.concat(F.lit("c"), "o_custkey").alias("cust"))
    return rounds(fit_apply(Encoder(), df), "cust", digits=9)


SCALE = ["l_quantity", "l_extendedprice"]


def scale_sql(center, width):
    parts = ", ".join(f"round(({x} - {center.format(x)}) / {width.format(x)}, 6) + 0.0 as {x}" for x in SCALE)
    return "select l_orderkey, l_linenumber, " + parts.replace("[", "(select ").replace("]", " from lineitem)") + " from lineitem"


def scaled(t, kind):
    df = t.lineitem.select("l_orderkey", "l_linenumber", *SCALE)
    return rounds(fit_apply(Scaler(strategy=kind, columns=SCALE), df), *SCALE)


@query("choose_scaler", """
with e as (select event_id, value, value * case when event_id % 15 = 0 then 100 else 1 end as spiked from events)
""" + union(f"""select '{x}' as "column", case when count(*) filter (where {x} < a - 3 * (b - a) or {x} > b + 3 * (b - a))
 > 0.05 * count(*) then 'robust' else 'standard' end as scaler
 from e, (select quantile_cont({x}, 0.25) as a, quantile_cont({x}, 0.75) as b from e)""" for x in ["value", "spiked"]))
def _(t):
    df = t.events.withColumn("spiked", F.expr("value * case when event_id % 15 = 0 then 100 else 1 end"))
    rows = [(x, Scaler(columns=[x]).fit(df)["kind"]) for x in ("value", "spiked")]
    return t.spark.createDataFrame(rows, "column string, scaler string")


@query("scale_standard", scale_sql("[avg({0})]", "[stddev_pop({0})]"))
def _(t):
    return scaled(t, "standard")


@query("scale_minmax", scale_sql("[min({0})]", "[max({0}) - min({0})]"))
def _(t):
    return scaled(t, "minmax")


@query("scale_robust", scale_sql("[quantile_cont({0}, 0.5)]", "[quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)]"))
def _(t):
    return scaled(t, "robust")


@query("inverse_scale", "select l_orderkey, l_linenumber, round(l_quantity, 4) as l_quantity, round(l_extendedprice, 4) as l_extendedprice from lineitem")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", *SCALE)
    m = Scaler(strategy="robust", columns=SCALE).fit(df)
    return rounds(m.inverse(m.transform(df)), *SCALE, digits=4)


@query("drop_low_variance", "select l_orderkey, l_linenumber, l_quantity from lineitem")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return fit_apply(select.FeatureSelector(steps=["variance"]), df)


def _nets(t):
    return t.lineitem.select("l_orderkey", "l_quantity", "l_extendedprice", "l_tax",
                             F.expr("round(l_extendedprice * (1 - l_discount), 2)").alias("net"))


@query("drop_correlated", "select l_orderkey, l_quantity, l_extendedprice, l_tax from lineitem")
def _(t):
    return fit_apply(select.FeatureSelector(steps=["correlation"]), _nets(t))


@query("dropped_features", """with n as (select *, round(l_extendedprice * (1 - l_discount), 2) as net from lineitem)
select 'l_tax' as feature, 'low_variance' as reason from n having var_pop(l_tax) <= 0.01
union all select 'net', 'high_correlation' from n having abs(corr(net, l_extendedprice)) > 0.95""")
def _(t):
    return select.FeatureSelector().fit(_nets(t)).dropped(t.spark)


SLOT = "('0x' || substr(md5({0}), 1, 8))::bigint"


@query("split_hash", f"""select o_orderkey, case when {SLOT.format('o_orderkey::varchar')} % 100 < 20 then 'test' else 'train' end as split from orders""")
def _(t):
    return split.split_random(t.orders.select("o_orderkey"), "o_orderkey")


@query("split_stratified", f"""
with r as (select o_orderkey, o_orderstatus, row_number() over (partition by o_orderstatus order by {SLOT.format('o_orderkey::varchar')}, o_orderkey) - 1 as i,
 count(*) over (partition by o_orderstatus) as n from orders)
select o_orderkey, o_orderstatus, case when i < floor(n * 0.2::double + 0.5) then 'test' else 'train' end as split from r""")
def _(t):
    return split.split_stratified(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey")


@query("split_time", """
with r as (select event_id, row_number() over (order by ts, event_id) - 1 as i, count(*) over () as n from events)
select event_id, case when i < trunc(n * 0.8::double) then 'train' else 'test' end as split from r""")
def _(t):
    return split.split_time(t.events, "ts", "event_id").select("event_id", "split")


@query("split_time_ties", """
with r as (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as i, count(*) over () as n from orders)
select o_orderkey, case when i < trunc(n * 0.8::double) then 'train' else 'test' end as split from r""")
def _(t):
    return split.split_time(t.orders, "o_orderdate", "o_orderkey").select("o_orderkey", "split")


@query("kfold", f"select o_orderkey, ({SLOT.format(chr(39) + 'fold' + chr(39) + ' || o_orderkey::varchar')} % 3)::int as fold from orders")
def _(t):
    return split.kfold(t.orders.select("o_orderkey"), "o_orderkey", 3)


@query("time_series_folds", """
with r as (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as i, count(*) over () as n from orders)
select o_orderkey, case when i < n - 3 * (n // 4) then 0 else 1 + (i - (n - 3 * (n // 4))) // (n // 4) end::int as block from r""")
def _(t):
    return split.time_series_folds(t.orders, "o_orderdate", "o_orderkey", 3).select("o_orderkey", "block")


@query("inner_holdout", """
with r as (select event_id, row_number() over (order by ts, event_id) - 1 as i, count(*) over () as n from events),
s as (select event_id, row_number() over (order by i) - 1 as j, count(*) over () as m from r where i < trunc(n * 0.8::double))
select event_id, case when j < trunc(m * 0.8::double) then 'fit' else 'validate' end as split from s""")
def _(t):
    train = split.split_time(t.events, "ts", "event_id").filter("split = 'train'").drop("split")
    return split.inner_holdout(train, "ts", "event_id").select("event_id", "split")


@query("recency_split", """select o_orderkey, case when o_orderdate > (select max(o_orderdate) from orders) - interval 90 day
 then 'validate' else 'train' end as split from orders""")
def _(t):
    return split.recency_split(t.orders, "o_orderdate", 90).select("o_orderkey", "split")
