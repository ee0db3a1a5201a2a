"""Checked queries: cleaning, typing, duplicates (section B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktab.operators import clean
from sparktab.plans.catalog import query

LI = "l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax"


@query("drop_columns", "select c_custkey, c_acctbal, c_mktsegment from customer")
def _(t):
    return clean.drop_columns(t.customer, ["c_name", "c_nationkey"])


@query("preview", "select * from part order by p_partkey limit 5")
def _(t):
    return clean.preview(t.part, "p_partkey")


@query("drop_duplicates", "select distinct l_orderkey, l_linenumber, l_returnflag from lineitem")
def _(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag")
    return clean.drop_duplicates(li)


@query("duplicate_report", """
with u as (select * from lineitem union all select * from lineitem where l_linenumber = 1)
select (select count(*) from u) as total_rows,
  (select count(*) from u) - (select count(*) from (select distinct * from u)) as duplicates,
  round(((select count(*) from u) - (select count(*) from (select distinct * from u)))
        / (select count(*) from u)::double, 6) as share""")
def _(t):
    li = t.lineitem
    return clean.duplicate_report(li.unionByName(li.filter("l_linenumber = 1")))


@query("drop_empty_columns", "select r_regionkey, r_name, 1 as one from region")
def _(t):
    df = t.region.withColumn("hollow", F.lit(None).cast("double")).withColumn("one", F.lit(1))
    return clean.drop_empty_columns(df)


@query("flag_constant_columns", """
select 'c_custkey' as "column", count(c_custkey) as non_null, count(distinct c_custkey) <= 1 as is_constant from customer
union all select 'c_mktsegment', count(c_mktsegment), count(distinct c_mktsegment) <= 1 from customer
union all select 'one', count(*), true from customer
union all select 'hollow', 0, true from customer limit 4""")
def _(t):
    df = t.customer.select("c_custkey", "c_mktsegment", F.lit(1).alias("one"),
                           F.lit(None).cast("string").alias("hollow"))
    return clean.constant_columns(df)


MIXED = "case when event_id % 10 = 0 then 'x' else json_extract_string(props, '$.k') end"


@query("flag_mixed_types", f"""
with e as (select {MIXED} as k, event_type from events)
select 'k' as "column", count(k) as non_null, count(try_cast(k as double)) as numeric_values,
  count(try_cast(k as double)) > 0 and count(try_cast(k as double)) < count(k) as is_mixed from e
union all select 'event_type', count(event_type), count(try_cast(event_type as double)),
  count(try_cast(event_type as double)) > 0 and count(try_cast(event_type as double)) < count(event_type) from e""")
def _(t):
    k = F.when(F.col("event_id") % 10 == 0, "x").otherwise(F.get_json_object("props", "$.k"))
    return clean.mixed_type_columns(t.events.select(k.alias("k"), "event_type"))


@query("ingest", "select distinct c_nationkey, c_mktsegment from customer")
def _(t):
    df = t.customer.select("c_nationkey", "c_mktsegment", F.lit(None).cast("string").alias("hollow"))
    return clean.ingest(df)[0]


@query("strip_column_names", "select s_suppkey, s_name from supplier")
def _(t):
    return clean.strip_column_names(
        t.supplier.select(F.col("s_suppkey").alias(" s_suppkey "), F.col("s_name").alias("s_name  ")))


@query("basic_clean", """
select o_orderkey::double as o_orderkey,
  coalesce(case when o_totalprice < 50000 then null else o_totalprice end,
    (select quantile_cont(case when o_totalprice < 50000 then null else o_totalprice end, 0.5) from orders)) as price,
  coalesce(case when o_orderstatus = 'F' then null else o_orderstatus end, 'unknown') as status from orders""")
def _(t):
    df = t.orders.select(
        "o_orderkey", F.when(F.col("o_totalprice") >= 50000, F.col("o_totalprice")).alias("price "),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("status"),
        F.lit(None).cast("double").alias("hollow"))
    return clean.basic_clean(df)


@query("separate_target", "select o_totalprice, o_orderstatus from orders")
def _(t):
    return clean.separate_target(t.orders, ["o_totalprice", "o_orderstatus", "absent"])[1]


@query("drop_target_if_present",
       "select o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority from orders")
def _(t):
    return clean.drop_target_if_present(t.orders, ["o_totalprice"])


@query("numeric_like_columns", f"""
with e as (select json_extract_string(props, '$.k') as k, {MIXED} as m, value from events)
select 'k' as "column", count(*) filter (where k is not null and try_cast(k as double) is null) = 0 as is_numeric from e
union all select 'm', count(*) filter (where m is not null and try_cast(m as double) is null) = 0 from e
union all select 'value', true union all select 'hollow', true""")
def _(t):
    m = F.when(F.col("event_id") % 10 == 0, "x").otherwise(F.get_json_object("props", "$.k"))
    return clean.numeric_like_columns(t.events.select(
        F.get_json_object("props", "$.k").alias("k"), m.alias("m"), "value",
        F.lit(None).cast("string").alias("hollow")))


@query("correct_types", f"""
select event_id, try_cast(case when event_id % 20 = 0 then 'x' else json_extract_string(props, '$.k') end as double) as k,
  {MIXED} as m from events""")
def _(t):
    raw = F.get_json_object("props", "$.k")
    df = t.events.select("event_id", F.when(F.col("event_id") % 20 == 0, "x").otherwise(raw).alias("k"),
                         F.when(F.col("event_id") % 10 == 0, "x").otherwise(raw).alias("m"))
    return clean.TypeCorrector().fit(df).transform(df)


@query("normalize_booleans", """
select l_orderkey, l_linenumber, case when l_returnflag = 'A' then null when l_linestatus = 'F' then 1 else 0 end as flag,
  case when l_quantity > 25 then 1 else 0 end as half, l_returnflag from lineitem""")
def _(t):
    df = t.lineitem.select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_returnflag") != "A", F.when(F.col("l_linestatus") == "F", "yes").otherwise("no")).alias("flag"),
        F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0).alias("half"), "l_returnflag")
    return clean.BooleanNormalizer().fit(df).transform(df)


@query("column_roles", """
select * from (values ('o_orderkey','numeric'),('o_custkey','numeric'),('o_orderstatus','categorical'),
 ('o_totalprice','numeric'),('o_orderdate','date'),('o_orderpriority','categorical'),('text_date','date')) v("column", role)""")
def _(t):
    return clean.column_roles(t.orders.withColumn(
        "text_date", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")))
