"""Lookups of per-category values that hold for hot and for many categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktab.functions.columns import c

BROADCAST_ROWS = 100_000
HOT_SHARE = 1_000  # a category is hot above 1/HOT_SHARE of all rows: at most HOT_SHARE of them


def lookup(df: DataFrame, mapping: DataFrame, key: str, values: list[str],
           weight: str | None = None, rows: int | None = None,
           right_key: str | None = None, limit: int | None = None) -> DataFrame:
    """Left join `mapping` (unique `right_key`, `values`) to `df` on `key`, null-safe.

    A mapping of at most `limit` rows (BROADCAST_ROWS; less for wide rows) is broadcast. Above that, hot
    categories (by the `weight` column, a share of rows) are looked up by a
    broadcast that holds at most HOT_SHARE rows, and the rest by a shuffle
    join in which rows already served carry spread-out keys.
    """
    limit = BROADCAST_ROWS if limit is None else limit
    if rows is None:
        rows = mapping.limit(limit + 1).count()
    right = mapping.select(c(right_key or key).alias("_k"), *[c(v) for v in values],
                           *([c(weight).alias("_w")] if weight and weight not in values else []))
    if weight and weight in values:
        right = right.withColumn("_w", c(weight))
    if rows <= limit:
        right = right.drop("_w")
        return df.join(F.broadcast(right), c(key).eqNullSafe(F.col("_k")), "left").drop("_k")
    if weight is None:
        return df.join(right, c(key).eqNullSafe(F.col("_k")), "left").drop("_k")
    right = right.withColumn("_w", F.coalesce("_w", F.lit(0.0)))
    hot = right.filter(F.col("_w") > 1.0 / HOT_SHARE).drop("_w")
    for v in values:
        hot = hot.withColumnRenamed(v, "_h_" + v)
    hot = hot.withColumnRenamed("_k", "_hk").withColumn("_hit", F.lit(True))
    cold = right.filter(~(F.col("_w") > 1.0 / HOT_SHARE)).drop("_w")
    out = df.join(F.broadcast(hot), c(key).eqNullSafe(F.col("_hk")), "left")
    spread = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*df.columns), F.lit(4096)).cast("string"))
    def tagged(col):  # a key for the join that keeps null apart from every value
        return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit("0"))
    cold = cold.withColumn("_k", tagged(F.col("_k")))
    out = out.withColumn("_j", F.when(F.col("_hit"), spread).otherwise(tagged(c(key))))
    out = out.join(cold, F.col("_j") == F.col("_k"), "left")
    kept = [x for x in df.columns if x not in values]
    return out.select(*[c(x) for x in kept],
                      *[F.when(F.col("_hit"), F.col("_h_" + v)).otherwise(c(v)).alias(v) for v in values])
