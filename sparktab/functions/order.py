"""Ordered work on long series without one big partition.

A series of any length is sorted once by range over the composite order, so
a series holding most of the table is spread over many tasks. Row numbers come
from the partition-local row ids plus one offset per partition. The sorted
table is a written stage, hence the numbers stay fixed under retries.

Short series (checked by a count of the largest one) take the plain window.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec

from sparktab.functions.columns import c
from sparktab.functions.staging import stage

SERIES_ROWS = 1_000_000   # longest series handled by one plain window
BLOCK_ROWS = 1_000_000    # rows per block of the positioned table
_LOCAL = (1 << 33) - 1    # row part of monotonically_increasing_id


def order_stage(df: DataFrame, order_by: list[str]) -> DataFrame:
    """Globally sorted stage with `_pid` and `_rid` (row number inside the partition)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [c(k) for k in order_by]
    ordered = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
               .withColumn("_mid", F.monotonically_increasing_id()))
    staged = stage(ordered, "order")
    return (staged.withColumn("_pid", F.shiftright("_mid", 33))
            .withColumn("_rid", F.col("_mid").bitwiseAND(F.lit(_LOCAL))).drop("_mid"))


def _offsets(per_part: DataFrame, sums: list[str]) -> DataFrame:
    """Exclusive running sums over the partitions; one row per partition, so small."""
    w = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    return per_part.select(
        "_pid", *[F.coalesce(F.sum(s).over(w), F.lit(0)).alias(s) for s in sums])


def with_position(df: DataFrame, order_by: list[str], name: str = "pos") -> DataFrame:
    """0-based position of every row in the total order."""
    staged = order_stage(df, order_by)
    counts = staged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_off"))
    return (staged.join(F.broadcast(_offsets(counts, ["_off"])), "_pid")
            .withColumn(name, F.col("_off") + F.col("_rid")).drop("_off", "_rid"))


def prefix_sums(df: DataFrame, order_by: list[str], columns: list[str]) -> DataFrame:
    """Inclusive running sums `cum_<column>` over the whole table."""
    staged = order_stage(df, order_by)
    part = staged.groupBy("_pid").agg(*[F.sum(x).alias("_o_" + x) for x in columns])
    w = W.partitionBy("_pid").orderBy("_rid").rowsBetween(W.unboundedPreceding, 0)
    out = staged.join(F.broadcast(_offsets(part, ["_o_" + x for x in columns])), "_pid")
    for x in columns:
        out = out.withColumn("cum_" + x, F.sum(x).over(w) + F.col("_o_" + x))
    return out.drop("_rid", "_pid", *["_o_" + x for x in columns])


def longest_series(df: DataFrame, keys: list[str]) -> int:
    if not keys:
        return df.count()
    sizes = df.groupBy(*[c(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def series_window(df: DataFrame, keys: list[str], order_by: list[str], before: int, after: int,
                  exprs: dict[str, Callable[[WindowSpec], Column]],
                  limit: int = SERIES_ROWS, block: int = BLOCK_ROWS) -> DataFrame:
    """Add window expressions that look `before` rows back and `after` rows ahead."""
    if longest_series(df, keys) <= limit:
        w = W.partitionBy(*[c(k) for k in keys]).orderBy(*[c(o) for o in order_by])
        return df.withColumns({n: f(w) for n, f in exprs.items()})
    block = max(block, before, after, 1)
    pos = with_position(df, keys + order_by, "_pos").drop("_pid")
    home, slot = F.floor(F.col("_pos") / block), F.col("_pos") % block
    blocks = F.array(home,
                     F.when(slot >= block - before, home + 1),
                     F.when((slot < after) & (home > 0), home - 1))
    spread = pos.withColumn("_blk", F.explode(F.array_compact(blocks)))
    w = W.partitionBy("_blk", *[c(k) for k in keys]).orderBy("_pos")
    out = spread.withColumns({n: f(w) for n, f in exprs.items()})
    return out.filter(F.col("_blk") == home).drop("_blk", "_pos")


def series_index(df: DataFrame, keys: list[str], order_by: list[str], name: str = "idx",
                 limit: int = SERIES_ROWS) -> DataFrame:
    """0-based position inside each series."""
    if keys and longest_series(df, keys) <= limit:
        w = W.partitionBy(*[c(k) for k in keys]).orderBy(*[c(o) for o in order_by])
        return df.withColumn(name, (F.row_number().over(w) - 1).cast("bigint"))
    pos = with_position(df, keys + order_by, name).drop("_pid")
    if not keys:
        return pos
    starts = pos.groupBy(*[c(k) for k in keys]).agg(F.min(name).alias("_start"))
    return lookup_series(pos, starts, keys).withColumn(name, F.col(name) - F.col("_start")).drop("_start")


def lookup_series(df: DataFrame, per_series: DataFrame, keys: list[str]) -> DataFrame:
    """Join one row per series to the rows; if a series is long (counted first), each is cut into salted shares.

    The copied rows of the shares are never broadcast: their size can't be told from the table's.
    """
    if longest_series(df, keys) <= SERIES_ROWS:
        return null_safe_join(df, per_series, keys)
    salts = 32
    left = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    right = per_series.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return null_safe_join(left, right.hint("merge"), keys + ["_salt"]).drop("_salt")


def null_safe_join(df: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on equal keys where null equals null; the keys come once."""
    names = {k: f"_right_{k}" for k in keys}
    right = right.select(*[c(k).alias(names[k]) if k in names else c(k) for k in right.columns])
    on = reduce(and_, [c(k).eqNullSafe(c(n)) for k, n in names.items()])
    return df.join(right, on, "left").drop(*names.values())


def fill_series(df: DataFrame, keys: list[str], order_by: list[str], forward: dict[str, str] | None = None,
                backward: dict[str, str] | None = None, limit: int = SERIES_ROWS) -> DataFrame:
    """Last and next non-null value of columns, {new name: source column}, in one ordering."""
    jobs = [(n, s, True) for n, s in (forward or {}).items()] + [(n, s, False) for n, s in (backward or {}).items()]
    cols = [c(k) for k in keys]

    def fill(source, ahead, w, skip=0):
        if ahead:
            return F.last(c(source), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -skip))
        return F.first(c(source), ignorenulls=True).over(w.rowsBetween(skip, W.unboundedFollowing))

    if longest_series(df, keys) <= limit:
        w = W.partitionBy(*cols).orderBy(*[c(o) for o in order_by])
        return df.withColumns({n: fill(s, ahead, w) for n, s, ahead in jobs})
    st = order_stage(df, keys + order_by)
    marks = st.groupBy("_pid", *cols).agg(
        *[(F.max_by if ahead else F.min_by)(c(s), F.when(c(s).isNotNull(), F.col("_rid"))).alias(f"_e{i}")
          for i, (_, s, ahead) in enumerate(jobs)])
    across = W.partitionBy(*cols).orderBy("_pid")
    carry = marks.select("_pid", *cols, *[fill(f"_e{i}", ahead, across, 1).alias(f"_c{i}")
                                          for i, (_, _, ahead) in enumerate(jobs)])
    # only series that cross a partition border carry anything: at most two per partition
    carry = carry.filter(reduce(or_, [F.col(f"_c{i}").isNotNull() for i in range(len(jobs))]))
    w = W.partitionBy("_pid", *cols).orderBy("_rid")
    out = st.withColumns({n: fill(s, ahead, w) for n, s, ahead in jobs})
    out = null_safe_join(out, F.broadcast(carry), ["_pid", *keys])
    return (out.withColumns({n: F.coalesce(c(n), F.col(f"_c{i}")) for i, (n, _, _) in enumerate(jobs)})
            .drop("_pid", "_rid", *[f"_c{i}" for i in range(len(jobs))]))
