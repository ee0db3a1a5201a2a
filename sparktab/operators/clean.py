"""Cleaning and typing: drops, duplicates, schema checks, booleans, numbers in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktab.functions.aggregate import exact_quantiles, wide_agg
from sparktab.functions.columns import (NUMERIC, c, date_formats, long_rows, numeric_columns, read_time, spread,
                                        string_columns, timestamp_columns)
from sparktab.functions.lookup import BROADCAST_ROWS
from sparktab.functions.staging import stage
from sparktab.operators.base import Fitted, Step

# fixed values: pairs that count as yes/no
TRUE_WORDS = ["yes", "true", "t", "y", "1"]
FALSE_WORDS = ["no", "false", "f", "n", "0"]


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def preview(df: DataFrame, key: str, rows: int = 5) -> DataFrame:
    return df.orderBy(c(key)).limit(rows)


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


HASHED = (*NUMERIC, T.BooleanType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType)  # equal values have equal hashes
MANY_COPIES = 0.8  # share of distinct rows below which all rows are compared at once
SLICES = 64        # the share is counted in one of so many slices by hash; copies lie in the same


def distinct_stage(df: DataFrame, rows: int, label: str) -> DataFrame:
    """A written stage of the distinct rows of a table of so many rows.

    Where copies are few, hashes are counted instead of rows: a row whose hash no other row has is distinct and isn't moved. Rows that
    share a hash are compared whole. With more such hashes than a broadcast holds, or columns whose equal values
    may differ in their hash (texts with a collation, nested ones), all rows are.
    """
    digest = F.xxhash64(*[c(n) for n in df.columns])
    hashed = rows and all(isinstance(f.dataType, HASHED) or f.dataType == T.StringType() for f in df.schema)
    if hashed:
        some, distinct = df.filter(F.pmod(digest, F.lit(SLICES)) == 0).agg(F.count(F.lit(1)), F.count_distinct(digest)).first()
    if not hashed or distinct < MANY_COPIES * some:
        return stage(drop_duplicates(df), label)
    zero = {f.name: (c(f.name) + F.lit(0.0)).cast(f.dataType) for f in df.schema
            if isinstance(f.dataType, (T.FloatType, T.DoubleType))}  # -0.0 becomes 0.0, as in a grouping
    held = stage(spread(df.withColumns(zero)), label)
    shared = stage(held.select(digest.alias("_digest")).groupBy("_digest").agg(F.count(F.lit(1)).alias("_rows"))
                   .filter("_rows > 1").select("_digest").limit(BROADCAST_ROWS + 1), "shared")
    found = shared.count()
    if not found:
        return held
    if found > BROADCAST_ROWS:
        return stage(drop_duplicates(held), label)
    alone, several = (held.join(F.broadcast(shared), digest == F.col("_digest"), how) for how in ("left_anti", "left_semi"))
    return stage(alone.unionByName(drop_duplicates(several)), label)


def duplicate_report(df: DataFrame) -> DataFrame:
    """rows, removed duplicates and their share, from counts per distinct row."""
    per_row = df.groupBy(*[c(n) for n in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return per_row.agg(F.sum("_n").alias("total_rows"),
                       (F.sum("_n") - F.count(F.lit(1))).alias("duplicates")) \
        .withColumn("share", F.round(F.col("duplicates") / F.col("total_rows"), 6))


def empty_columns(df: DataFrame) -> list[str]:
    counts = wide_agg(df, {n: F.count(c(n)) for n in df.columns})
    return [n for n in df.columns if counts[n] == 0]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    return df.drop(*empty_columns(df))


def constant_columns(df: DataFrame) -> DataFrame:
    """One row per column; constant = at most one distinct non-null value (min equals max)."""
    stats = [F.struct(F.lit(n).alias("column"), F.count(c(n)).alias("non_null"),
                      F.coalesce(F.min(c(n)).eqNullSafe(F.max(c(n))), F.lit(True)).alias("is_constant"))
             for n in df.columns]
    return _long(df, stats)


def _long(df: DataFrame, structs: list[Column]) -> DataFrame:
    one = df.agg(*[s.alias(f"r{i}") for i, s in enumerate(structs)])
    return one.select(long_rows([F.col(f"r{i}") for i in range(len(structs))]))


def mixed_type_columns(df: DataFrame) -> DataFrame:
    """Text columns in which some but not all values read as numbers."""
    stats = []
    for n in string_columns(df):
        good, all_ = F.count(c(n).try_cast("double")), F.count(c(n))
        stats.append(F.struct(F.lit(n).alias("column"), all_.alias("non_null"),
                              good.alias("numeric_values"),
                              ((good > 0) & (good < all_)).alias("is_mixed")))
    return _long(df, stats)


def numeric_like_columns(df: DataFrame) -> DataFrame:
    """Is every non-null value of the column a number? All-null counts as numeric."""
    stats = [F.struct(F.lit(n).alias("column"),
                      (F.count_if(c(n).isNotNull() & c(n).cast("string").try_cast("double").isNull()) == 0)
                      .alias("is_numeric")) for n in df.columns]
    return _long(df, stats)


def ingest(df: DataFrame) -> tuple[DataFrame, list[tuple[str, str, str, str]]]:
    """Duplicates out, empty columns out, constant and mixed columns reported.

    One pass judges all columns (copies change none of the answers), one
    shuffle (of hashes where copies are few) removes the duplicates into a
    written stage that later passes read.
    """
    text = string_columns(df)
    checks = {"*": F.count(F.lit(1))}
    for n in df.columns:
        checks[n, "known"] = F.count(c(n))
        checks[n, "same"] = F.min(c(n)).eqNullSafe(F.max(c(n)))
    for n in text:
        checks[n, "numbers"] = F.count(c(n).try_cast("double"))
    seen = wide_agg(df, checks)
    empty = [n for n in df.columns if seen[n, "known"] == 0]
    total = seen["*"]
    kept = distinct_stage(df.drop(*empty), total, "ingested")
    gone = total - kept.count()
    log = [("Duplicates", f"Removed {gone} rows", f"{gone * 100.0 / max(total, 1):.2f} % of rows",
            "applied" if gone else "skipped")]
    if empty:
        log.append(("Schema", f"Dropped empty columns {empty}", "only nulls", "applied"))
    const = [n for n in kept.columns if seen[n, "same"]]
    if const:
        log.append(("Schema", f"Constant columns {const}", "one distinct value", "skipped"))
    mixed = [n for n in text if 0 < seen[n, "numbers"] < seen[n, "known"]]
    if mixed:
        log.append(("Schema", f"Mixed types in {mixed}", "some values read as numbers", "skipped"))
    return kept, log


def strip_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[n.strip() for n in df.columns])


def basic_clean(df: DataFrame) -> DataFrame:
    """Names trimmed, empty columns out, median for numbers, "unknown" for text."""
    df = drop_empty_columns(strip_column_names(df))
    nums = numeric_columns(df)
    medians = exact_quantiles(df, {n: [0.5] for n in nums})
    fill = {n: F.coalesce(c(n).cast("double"), F.lit(medians[n][0])) for n in nums}
    fill |= {n: F.coalesce(c(n), F.lit("unknown")) for n in string_columns(df)}
    return df.withColumns(fill)


def separate_target(df: DataFrame, targets: list[str], date_col: str | None = None):
    """(features, labels); unknown targets are ignored."""
    known = [t for t in targets if t in df.columns]
    return df.drop(*known, *([date_col] if date_col else [])), df.select(*[c(t) for t in known])


def drop_target_if_present(df: DataFrame, targets: list[str]) -> DataFrame:
    return df.drop(*targets)


def column_roles(df: DataFrame) -> DataFrame:
    """numeric, categorical or date per column; text named like a date must be read everywhere by one of DATE_FORMATS."""
    nums, dates = set(numeric_columns(df)), set(timestamp_columns(df))
    named = [n for n in string_columns(df) if "date" in n.lower() or "time" in n.lower()]
    how = {n: f for n, (f, _) in date_formats(df, named).items()}
    bad = wide_agg(df, {n: F.count_if(c(n).isNotNull() & read_time(c(n), how[n]).isNull()) for n in named})
    dates |= {n for n in named if bad[n] == 0}
    rows = []
    for f in df.schema:
        if f.name in dates:
            rows.append((f.name, "date"))
        elif f.name in nums:
            rows.append((f.name, "numeric"))
        elif isinstance(f.dataType, (T.StringType, T.BooleanType)):
            rows.append((f.name, "categorical"))
    return df.sparkSession.createDataFrame(rows, "column string, role string")


class TypeCorrector(Step):
    """Text columns become numbers when more than `share` of the rows parse."""

    defaults = {"share": 0.9, "exclude": []}

    def learn(self, df):
        names = string_columns(df, self["exclude"])
        stats = {n: F.count(c(n).try_cast("double")) for n in names}
        seen = wide_agg(df, {**stats, "*": F.count(F.lit(1))})
        return TypeCorrectorModel(columns=[n for n in names if seen[n] > seen["*"] * self["share"]])


class TypeCorrectorModel(Fitted):
    defaults = {"columns": []}

    def apply(self, df):
        return df.withColumns({n: c(n).cast("string").try_cast("double") for n in self["columns"]
                               if n in df.columns})

    def log(self):
        return [("Type Correction", f"Converted {n}", "text reads as numbers", "applied")
                for n in self["columns"]]


class BooleanNormalizer(Step):
    """Columns with exactly two values of one yes/no pair become 1/0; null stays null.

    Numbers are compared by value, so 0.0/1.0 works; `ignore_case` also takes "Yes".
    """

    defaults = {"ignore_case": False, "exclude": []}

    def learn(self, df):
        names = string_columns(df, self["exclude"])
        flags = [f.name for f in df.schema
                 if isinstance(f.dataType, T.BooleanType) and f.name not in self["exclude"]]
        nums = numeric_columns(df, self["exclude"])
        stats = {n: F.struct(F.min(_word(n, self["ignore_case"])), F.max(_word(n, self["ignore_case"])),
                             F.approx_count_distinct(c(n))) for n in names}
        stats |= {n: F.struct(F.min(c(n)), F.max(c(n)),
                              F.count_if(c(n).isNotNull() & ~c(n).isin(0, 1))) for n in nums}
        seen = wide_agg(df, stats)
        pairs = [tuple(sorted(p)) for p in zip(TRUE_WORDS, FALSE_WORDS)]
        near = [n for n in names if seen[n][2] <= 8 and (seen[n][0], seen[n][1]) in pairs]
        # min and max form a pair: exactly two values when nothing lies outside it
        outside = wide_agg(df, {n: F.count_if(~_word(n, self["ignore_case"]).isin(seen[n][0], seen[n][1]))
                                for n in near})
        text = [n for n in near if outside[n] == 0]
        zero_one = [n for n in nums if seen[n][0] == 0 and seen[n][1] == 1 and seen[n][2] == 0]
        return BooleanNormalizerModel(text=text, numbers=zero_one, flags=flags,
                                      ignore_case=self["ignore_case"])


def _word(name: str, ignore_case: bool) -> Column:
    return F.lower(c(name)) if ignore_case else c(name)


class BooleanNormalizerModel(Fitted):
    defaults = {"text": [], "numbers": [], "flags": [], "ignore_case": False}

    def apply(self, df):
        out = {}
        for n in self["text"]:
            w = _word(n, self["ignore_case"])
            out[n] = F.when(w.isin(TRUE_WORDS), 1).when(w.isin(FALSE_WORDS), 0)
        for n in self["numbers"] + self["flags"]:
            out[n] = c(n).cast("int")
        return df.withColumns({n: e for n, e in out.items() if n in df.columns})

    def log(self):
        return [("Boolean Normalize", f"Converted {n}", "two yes/no values", "applied")
                for n in self["text"] + self["numbers"] + self["flags"]]
