"""Train/test splits and folds that depend on keys and values only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from sparktab.functions.aggregate import select_ranks
from sparktab.functions.columns import c, micros, percent_slot, row_hash, timestamp_columns
from sparktab.functions.lookup import lookup
from sparktab.functions.order import null_safe_join
from sparktab.functions.staging import stage


def split_key(df: DataFrame, key: str | None) -> Column:
    """The key column, or a hash of the whole row where no key exists."""
    return c(key) if key else row_hash(df.columns)


def split_random(df: DataFrame, key: str | None = None, test_size: float = 0.2, seed: str = "",
                 slots: int = 100) -> DataFrame:
    slot = percent_slot(split_key(df, key), slots, seed)
    return df.withColumn("split", F.when(slot < round(test_size * slots), "test").otherwise("train"))


def split_stratified(df: DataFrame, target: str, key: str, test_size: float = 0.2) -> DataFrame:
    """Exactly round(test_size * n) rows of each class, by hash order; random if a class has one row.

    The cut of each class is found by counting passes over hashes written once, so rows are neither sorted nor moved, however large
    a class is and however many classes there are: sizes, cuts and lookups are tables, not lists on the driver.
    """
    counts, few = class_balance_all(df, target)
    least, total = counts.agg(F.min("n"), F.sum("n")).first()
    if (least or 0) < 2:
        return split_random(df, key, test_size)
    quota = counts.select("_g", F.floor(F.col("n") * test_size + 0.5).cast("bigint").alias("rank"), (F.col("n") / total).alias("share"))
    work = df.select(c(target).alias("_g"), percent_slot(c(key), 1 << HASH_BITS).alias("_h"), _tie(df, key).alias("_tk"))
    cuts = group_cuts(stage(work, "hashes"), quota, few)
    out = df.withColumns({"_h": percent_slot(c(key), 1 << HASH_BITS), "_tk": _tie(df, key)})
    out = lookup(out, cuts, target, ["_hc", "_kc"], weight="share", rows=0 if few else None, right_key="_g")
    test = (F.col("_h") < F.col("_hc")) | ((F.col("_h") == F.col("_hc")) & (F.col("_tk") < F.col("_kc")))
    return out.withColumn("split", F.when(test, "test").otherwise("train")).select(*[c(x) for x in df.columns], "split")


HASH_BITS, DIGIT = 32, 16


FEW_CLASSES = 10_000


def settled(per_class: DataFrame, few: bool | None = None) -> tuple[DataFrame, bool]:
    """A table of one row per class as fixed values: in the plan while there are few classes, else a written stage; which of them."""
    if few is not False:
        rows = per_class.limit(FEW_CLASSES + 1).collect()
        if len(rows) <= FEW_CLASSES:
            return per_class.sparkSession.createDataFrame(rows, per_class.schema), True
    return stage(per_class, "classes"), False


def class_balance_all(df: DataFrame, target: str) -> tuple[DataFrame, bool]:
    """(_g, n) of every class, null included, and whether they are few."""
    return settled(df.groupBy(c(target).alias("_g")).agg(F.count(F.lit(1)).alias("n")))


def group_cuts(df: DataFrame, ranks: DataFrame, few: bool | None = None) -> DataFrame:
    """(_g, _hc, _kc, share): hash and key of the row at the given rank of each group.

    `df` has _g, _h (hash), _tk (key); `ranks` one row per group: _g, rank, share of all rows. Radix selection:
    each pass counts one digit of the hash per group in all tasks together and keeps, per group, the digit that holds
    the rank. What is known of the groups stays a table from pass to pass.
    """
    known = ranks.withColumn("_p", F.lit(0).cast("bigint"))
    one = W.partitionBy("_g").orderBy("_d")
    for shift in range(HASH_BITS - DIGIT, -1, -DIGIT):
        rows = df.select("_g", "_h")
        if shift == HASH_BITS - DIGIT:  # nothing is known yet
            rows = rows.withColumn("_p", F.lit(0).cast("bigint"))
        else:
            rows = lookup(rows, known, "_g", ["_p"], weight="share", rows=0 if few else None)
        digits = (rows.filter(F.shiftright("_h", shift + DIGIT) == F.col("_p")).groupBy("_g", F.shiftright("_h", shift).alias("_d"))
                  .agg(F.count(F.lit(1)).alias("n")).withColumn("_end", F.sum("n").over(one)))
        hit = null_safe_join(digits, known, ["_g"]).filter((F.col("rank") < F.col("_end")) & (F.col("rank") >= F.col("_end") - F.col("n")))
        hit = hit.select("_g", F.col("_d").alias("_np"), (F.col("rank") - F.col("_end") + F.col("n")).alias("_nr"))
        past = (F.col("_p") + 1) * (1 << DIGIT)  # the rank is past the end: every row of the group is before it
        known = null_safe_join(known, hit, ["_g"]).select(
            "_g", F.coalesce("_np", past).alias("_p"), F.coalesce("_nr", F.lit(0)).cast("bigint").alias("rank"), "share")
        known, few = settled(known, few)
    # rows that share a full hash are told apart by key: few distinct keys per hash value
    ties = lookup(df.select("_g", "_h", "_tk"), known.filter("rank > 0"), "_g", ["_p"], weight="share", rows=0 if few else None).filter(F.col("_h") == F.col("_p"))
    nth = (null_safe_join(ties.select("_g", "_tk").distinct().withColumn("_i", F.row_number().over(W.partitionBy("_g").orderBy("_tk"))), known, ["_g"])
           .filter(F.col("_i") <= F.col("rank") + 1).groupBy("_g").agg(F.max("_tk").alias("_key")))
    out = null_safe_join(known, nth, ["_g"]).select("_g", F.col("_p").alias("_hc"), F.coalesce("_key", F.lit(LOWEST)).alias("_kc"), "share")
    return settled(out, few)[0]


def _time_value(df: DataFrame, ts: str) -> Column:
    return micros(c(ts)) if ts in timestamp_columns(df) else c(ts)


LOWEST = -(1 << 63)


def _tie(df: DataFrame, key: str) -> Column:
    """The key as a 64-bit integer; other keys by their hash."""
    whole = isinstance(df.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    return c(key).cast("bigint") if whole else F.xxhash64(c(key))


def rank_cuts(df: DataFrame, first: Column, second: Column,
              asks: list[tuple[Column | None, int]]) -> list[tuple[int, int]]:
    """(first, second) of the row at a rank of the (first, second) order, per (condition, rank).

    Order statistics by counting passes over whole-number columns; all cuts share the passes. The second column
    is only looked at where the rank falls inside ties of the first.
    """
    base = df.select(first.cast("bigint").alias("_f"), second.cast("bigint").alias("_s"),
                     *[(F.lit(True) if cond is None else cond).alias(f"_c{i}") for i, (cond, _) in enumerate(asks)])
    shared = all(cond is None for cond, _ in asks)
    names = ["all"] if shared else list(range(len(asks)))
    wanted = {n: [r for i, (_, r) in enumerate(asks) if shared or i == n] for n in names}
    found = select_ranks(base, {n: F.col("_f") if shared else F.when(F.col(f"_c{n}"), F.col("_f")) for n in names}, lambda n, _: wanted[n])
    top = [found["all" if shared else i, r] for i, (_, r) in enumerate(asks)]
    inside = {i: r - top[i].below for i, (_, r) in enumerate(asks) if r > top[i].below}
    tied = {i: F.when(F.col(f"_c{i}") & (F.col("_f") == top[i].value), F.col("_s")) for i in inside}
    keys = select_ranks(base, tied, lambda i, _: [inside[i]]) if inside else {}
    return [(top[i].value, keys[i, inside[i]].value if i in inside else LOWEST) for i in range(len(asks))]


def _before(first: Column, second: Column, cut: tuple[int, int]) -> Column:
    return (first < cut[0]) | ((first == cut[0]) & (second < cut[1]))


def time_cuts(df: DataFrame, ts: str, key: str, ranks: list[int]) -> list[tuple[int, int]]:
    """(time, key) of the rows at the given ranks of the time order, ties by key."""
    return rank_cuts(df, _time_value(df, ts), _tie(df, key), [(None, r) for r in ranks])


def before(df: DataFrame, ts: str, key: str, cut: tuple[int, int]) -> Column:
    """Is the row before the cut row in (time, key) order?"""
    return _before(_time_value(df, ts), _tie(df, key), cut)


def split_time(df: DataFrame, ts: str, key: str, test_size: float = 0.2) -> DataFrame:
    """The first int(n * (1 - test_size)) rows in time order train, the rest test."""
    n = df.count()
    first_test = int(n * (1 - test_size))
    if first_test >= n:
        return df.withColumn("split", F.lit("train"))
    cut = time_cuts(df, ts, key, [first_test])[0]
    return df.withColumn("split", F.when(before(df, ts, key, cut), "train").otherwise("test"))


def inner_holdout(df: DataFrame, ts: str, key: str, share: float = 0.8) -> DataFrame:
    """First part of the training rows to fit, the rest to validate."""
    out = split_time(df, ts, key, 1 - share)
    return out.withColumn("split", F.when(F.col("split") == "train", "fit").otherwise("validate"))


def kfold(df: DataFrame, key: str | None = None, k: int = 3, seed: str = "fold") -> DataFrame:
    """Fold 0..k-1 by key; a row without a key (a synthetic one) gets its fold by a hash of the row."""
    by_row = percent_slot(row_hash(df.columns), k, seed)
    return df.withColumn("fold", F.coalesce(percent_slot(split_key(df, key), k, seed), by_row).cast("int"))


def time_series_folds(df: DataFrame, ts: str, key: str, k: int = 3) -> DataFrame:
    """Block 0..k in time order; fold i trains on blocks below i and tests on block i."""
    n = df.count()
    size = n // (k + 1)
    cuts = time_cuts(df, ts, key, [n - (k - i) * size for i in range(k)])
    block = sum((F.when(before(df, ts, key, cut), 0).otherwise(1) for cut in cuts), F.lit(0))
    return df.withColumn("block", block.cast("int"))


def recency_split(df: DataFrame, ts: str, days: int = 90) -> DataFrame:
    """Validate on the newest days."""
    newest = df.agg(F.max(micros(c(ts)))).first()[0]
    edge = newest - days * 86_400_000_000
    return df.withColumn("split", F.when(micros(c(ts)) > edge, "validate").otherwise("train"))
