"""What several operators of this package share: words, row keys, bounded lookups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktab.functions.staging import stage

#: A word: a run of anything but the blank and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: A lookup table of at most this many rows is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 100_000
SALTS = 64

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query of (spark, folder), and the same in SQL if SQL can say it."""
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: lineage ends here and the values are fixed."""
    return stage(df, label)


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def null_key(col: Column) -> Column:
    """A key that is never null: null and the empty string stay apart."""
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit("0"))


def row_key(doc_id: Column, text: Column) -> Column:
    """A string that tells rows apart: the id, or a digest of the text where there is no id."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))


def row_hash() -> Column:
    """64 bits of id and text. Rows that share them are equal to an operator that reads only these two."""
    return F.xxhash64("doc_id", "text")


def without(docs: DataFrame, keys: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """The rows of `docs` whose row_hash is not in keys (rk): broadcast while the counted keys are few, else shuffled."""
    keys = keys.select(F.col("rk").alias("__rk")).distinct()
    if keys.count() <= limit:
        keys = F.broadcast(keys)
    return docs.withColumn("__rk", row_hash()).join(keys, "__rk", "left_anti").select(*[F.col(f"`{x}`") for x in docs.columns])


def lookup(df: DataFrame, small: DataFrame, key: str, rows: int | None = None,
           limit: int = BROADCAST_ROWS, how: str = "left") -> DataFrame:
    """Join one row per key to the rows of `df`; `key` is never null.

    Broadcast while `small` has at most `limit` rows (counted unless given). Beyond, both sides are shuffled
    and each key is dealt over SALTS shares, so that a key with a third of all rows meets many tasks.
    """
    if (small.count() if rows is None else rows) <= limit:
        return df.join(F.broadcast(small), key, how)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{x}`") for x in df.columns]), F.lit(SALTS)))
    dealt = small.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return salted.join(dealt, [key, "__salt"], how).drop("__salt")
