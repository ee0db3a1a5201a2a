"""Small column helpers: typing by schema, epoch arithmetic, hashing, rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)


def c(name: str) -> Column:
    """Column by exact name, safe for dots and blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema
            if isinstance(f.dataType, (T.StringType, T.CharType, T.VarcharType))
            and f.name not in exclude]


def timestamp_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema
            if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
            and f.name not in exclude]


def dbl(name: str) -> Column:
    """Numeric column as double with NaN mapped to null, so every statistic skips it."""
    v = c(name).cast("double")
    return F.when(~F.isnan(v), v)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, independent of the session zone."""
    second = F.extract(F.lit("SECOND"), ts)
    return (F.unix_date(ts.cast("date")).cast("bigint") * F.lit(86_400_000_000)
            + F.hour(ts).cast("bigint") * F.lit(3_600_000_000)
            + F.minute(ts).cast("bigint") * F.lit(60_000_000)
            + (second * F.lit(1_000_000)).cast("bigint"))


# How dates are written besides the ISO form (""), and what such a text looks like. Month first goes before day first.
DATE_FORMATS = {
    "": None,
    "M/d/yyyy[ H:mm[:ss]]": r"^\d{1,2}/\d{1,2}/\d{4}",
    "d/M/yyyy[ H:mm[:ss]]": r"^\d{1,2}/\d{1,2}/\d{4}",
    "yyyy/M/d[ H:mm[:ss]]": r"^\d{4}/\d{1,2}/\d{1,2}",
    "d.M.yyyy[ H:mm[:ss]]": r"^\d{1,2}\.\d{1,2}\.\d{4}",
    "M-d-yyyy[ H:mm[:ss]]": r"^\d{1,2}-\d{1,2}-\d{4}",
    "d-M-yyyy[ H:mm[:ss]]": r"^\d{1,2}-\d{1,2}-\d{4}",
    "d MMM yyyy[ H:mm[:ss]]": r"^\d{1,2} [A-Z][a-z]{2} \d{4}",
    "MMM d, yyyy[ H:mm[:ss]]": r"^[A-Z][a-z]{2} \d{1,2}, \d{4}",
    "d MMMM yyyy[ H:mm[:ss]]": r"^\d{1,2} [A-Z][a-z]{2,8} \d{4}",
    "MMMM d, yyyy[ H:mm[:ss]]": r"^[A-Z][a-z]{2,8} \d{1,2}, \d{4}",
}


def read_time(col: Column, how: str) -> Column:
    """Timestamp of a text in one of DATE_FORMATS; null where it isn't one. Only texts of that look are parsed."""
    if not how:
        return F.try_to_timestamp(col)
    text = F.trim(col)
    return F.when(text.rlike(DATE_FORMATS[how]), F.try_to_timestamp(text, F.lit(how)))


def date_formats(df: DataFrame, names: list[str]) -> dict[str, tuple[str, int]]:
    """{column: (format, values it reads)}: the format that reads most values of a text column, the earlier one of equals.

    One format holds for a whole column, so day and month aren't mixed up from row to row. Plain numbers are no dates.
    """
    from sparktab.functions.aggregate import wide_agg
    asked = {(n, how): F.count(F.when(c(n).try_cast("double").isNull(), read_time(c(n), how))) for n in names for how in DATE_FORMATS}
    seen = wide_agg(df, asked)
    best = {n: max(DATE_FORMATS, key=lambda how: seen[n, how]) for n in names}
    return {n: (how, seen[n, how]) for n, how in best.items()}


def row_hash(columns: list[str]) -> Column:
    """md5 over the named columns; nulls are kept apart from empty strings."""
    return F.md5(F.to_json(F.struct(*[c(n) for n in columns]), {"ignoreNullFields": "false"}))


def percent_slot(key: Column, slots: int = 100, seed: str = "") -> Column:
    """Slot 0..slots-1 of a key from the first 8 hex digits of its md5.

    Depends on the key only: the same row gets the same slot after any
    repartitioning, retry or rerun, unlike a seeded random number.
    """
    text = F.concat(F.lit(seed), key.cast("string")) if seed else key.cast("string")
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % slots


def unit_hash(key: Column, seed: str) -> Column:
    """Uniform number in [0, 1) from a key."""
    return percent_slot(key, 1 << 31, seed) / F.lit(float(1 << 31))


def rounded(col: Column, digits: int = 4) -> Column:
    """Round and fold the negative zero away."""
    return F.round(col, digits) + F.lit(0.0)


def long_rows(row_structs: list[Column]) -> Column:
    """One output row per struct: reshapes a one-row wide aggregate."""
    return F.inline(F.array(*row_structs))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores where the input has fewer splits than cores (a small table in one file).

    A table of many splits is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df  # sized by the shuffle
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
