"""Joins on closeness: numbers within a relative band, names that contain each other.

Both turn a theta condition into equi-joins, so no plan compares every row with every row: numbers meet in buckets of
their logarithm, names in their rarest run of characters. A bucket or run that many rows share is cut into
counted shares: the rows are dealt over the shares, the other side's row is copied to each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktab.functions.columns import c
from sparktab.functions.lookup import lookup
from sparktab.functions.staging import stage

STEPS = 4            # buckets for each doubling
SHARE_ROWS = 50_000  # rows of one key in one task
HEAVY_KEYS = 100_000
GRAM = 3


def shared_join(rows: DataFrame, probes: DataFrame, keys: list[str], share_rows: int = SHARE_ROWS) -> DataFrame:
    """Inner join of `probes` to `rows` on equal keys; a key with many rows is dealt over shares of about `share_rows`.

    The list of such keys is broadcast: it has HEAVY_KEYS rows at the most, as shares grow with the table beyond that.
    """
    counts = stage(rows.groupBy(*[c(k) for k in keys]).agg(F.count(F.lit(1)).alias("_n")), "key-counts")
    share_rows = max(share_rows, (counts.agg(F.sum("_n")).first()[0] or 0) // HEAVY_KEYS)
    heavy = F.broadcast(counts.filter(F.col("_n") > share_rows)
                        .select(*[c(k) for k in keys], F.ceil(F.col("_n") / share_rows).cast("bigint").alias("_shares")))
    one = F.coalesce(F.col("_shares"), F.lit(1).cast("bigint"))
    rows = (rows.join(heavy, keys, "left").withColumn("_share", F.pmod(F.xxhash64(*[c(x) for x in rows.columns]), one)).drop("_shares"))
    probes = (probes.join(heavy, keys, "left")
              .withColumn("_share", F.explode(F.sequence(F.lit(0).cast("bigint"), one - 1))).drop("_shares"))
    return probes.join(rows, [*keys, "_share"]).drop("_share")


def bucket(value: Column, steps: int = STEPS) -> Column:
    """Number of the logarithmic bucket; all values below 1 share one."""
    return F.when(value < 1, -1).otherwise(F.floor(F.log2(F.greatest(value, F.lit(1.0))) * steps)).cast("bigint")


def band_join(rows: DataFrame, probes: DataFrame, value: str, wanted: str, width: float, keys: list[str],
              share_rows: int = SHARE_ROWS) -> DataFrame:
    """Pairs with equal keys and |value - wanted| / max(wanted, 1) < width (below 1).

    `value` is a column of `rows`, `wanted` one of `probes`. A probe meets the buckets that its band covers: a fixed number.
    """
    base, slack = F.greatest(c(wanted).cast("double"), F.lit(1.0)), 1e-9
    low, high = c(wanted) - base * (width + slack), c(wanted) + base * (width + slack)
    placed = rows.withColumn("_bucket", bucket(c(value).cast("double")))
    asked = probes.withColumn("_bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    near = F.abs(c(value) - c(wanted)) / base < width
    return shared_join(placed, asked, [*keys, "_bucket"], share_rows).filter(near).drop("_bucket")


def _finished(experiments: DataFrame) -> DataFrame:
    return (experiments.filter(F.col("best_model").isNotNull())
            .select(F.lower("task_type").alias("_task"), F.col("dataset_name").alias("dataset"), "best_model", "best_score",
                    F.col("profile_summary.total_rows").alias("total_rows"), F.col("profile_summary.total_columns").alias("features"))
            .filter(F.col("total_rows") > 0))


def _asked(profiles: DataFrame, key: str) -> DataFrame:
    return profiles.select(c(key), F.lower("task_type").alias("_task"), F.col("total_rows").alias("_rows"), F.col("total_columns").alias("_cols"))


def _alike(runs: DataFrame, asked: DataFrame, share_rows: int) -> DataFrame:
    near_rows = F.abs(F.col("total_rows") - F.col("_rows")) / F.greatest(F.col("_rows").cast("double"), F.lit(1.0)) < 0.5
    by_rows = band_join(runs, asked, "total_rows", "_rows", 0.5, ["_task"], share_rows)
    by_cols = band_join(runs, asked, "features", "_cols", 0.3, ["_task"], share_rows).filter(~F.coalesce(near_rows, F.lit(False)))
    return by_rows.unionByName(by_cols)


def similar_runs(experiments: DataFrame, profiles: DataFrame, key: str, share_rows: int = SHARE_ROWS) -> DataFrame:
    """(key, dataset, best_model, best_score, total_rows, features) of the finished runs that are like each profile.

    A run is like a profile (key, total_rows, total_columns, task_type) of the same task when its rows lie within 50 %
    or its columns within 30 %. Two band joins; the second leaves out what the first has found, so that no pair
    comes twice and none needs to be compared with another. Runs without rows, nulls and profiles with nulls match nothing.
    The pairs grow with runs times profiles; `similar_classes` says the same without listing them.
    """
    return _alike(_finished(experiments), _asked(profiles, key), share_rows).drop("_task", "_rows", "_cols")


def similar_classes(experiments: DataFrame, profiles: DataFrame, key: str, share_rows: int = SHARE_ROWS) -> DataFrame:
    """The pairs of `similar_runs` as pairs of classes, and the class of each run and profile, in one table told apart by `part`.

    Runs of the same task, rows and columns are like the same profiles, so they are one class, as are such profiles.
    `profile`: key and its class (task, profile_rows, profile_columns). `run`: dataset, best_model, best_score and its class
    (task, total_rows, features); every finished run with rows. `link`: two classes that are alike and how many pairs they stand for.
    Joining links to runs and profiles by their classes gives all pairs.
    """
    runs, asked = stage(_finished(experiments), "runs"), stage(_asked(profiles, key), "profiles")
    run_class, profile_class = ["_task", "total_rows", "features"], ["_task", "_rows", "_cols"]
    links = _alike(runs.groupBy(*run_class).agg(F.count(F.lit(1)).alias("_many")),
                   asked.groupBy(*profile_class).agg(F.count(F.lit(1)).alias("_asks")), share_rows)
    parts = [("profile", asked), ("run", runs), ("link", links.withColumn("pairs", F.col("_many") * F.col("_asks")).drop("_many", "_asks"))]
    out = None
    for name, df in parts:
        df = df.select(F.lit(name).alias("part"), *[c(x) for x in df.columns])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.select("part", c(key), "dataset", "best_model", "best_score", F.col("_task").alias("task"), F.col("_rows").alias("profile_rows"),
                      F.col("_cols").alias("profile_columns"), "total_rows", "features", "pairs")


def _grams(text: Column, size: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size))))


def _probe_grams(text: Column) -> Column:
    """Runs that a text containing this one must have: all of GRAM characters, or the text itself where it is shorter."""
    return F.when(F.length(text) >= GRAM, _grams(text, GRAM)).otherwise(F.array(text))


def contained(short: DataFrame, long: DataFrame, share_rows: int = SHARE_ROWS) -> DataFrame:
    """(short, long) of every pair in which the long text contains the short one; both have one column, of distinct non-empty texts.

    An inverted index of the long texts' runs; each short text looks up the one of its runs that the fewest long texts have,
    and is dropped if one of them is nowhere. What is found is compared in full.
    """
    s, g = short.select(F.col(short.columns[0]).alias("short")), long.select(F.col(long.columns[0]).alias("long"))
    sizes = [r[0] for r in s.select(F.least(F.length("short"), F.lit(GRAM)).alias("n")).distinct().collect()]  # 1, 2, 3 at most
    none = F.array().cast("array<string>")
    index = g.select("long", F.explode(F.concat(none, *[F.when(F.length("long") >= n, _grams(F.col("long"), n)).otherwise(none)
                                                        for n in sorted(sizes)])).alias("gram"))
    index = stage(index, "name-index")
    counts = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    runs = s.select("short", F.explode(_probe_grams(F.col("short"))).alias("gram"))
    rarest = (runs.join(counts, "gram", "left").groupBy("short")
              .agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), F.col("gram"))).alias("gram"), F.min(F.coalesce("n", F.lit(0))).alias("n"))
              .filter("n > 0").select("short", "gram"))
    return shared_join(index, rarest, ["gram"], share_rows).filter(F.contains("long", "short")).select("short", "long")


def clean_name(col: Column) -> Column:
    return F.lower(F.replace(col, F.lit(" "), F.lit("")))


def match_names(df: DataFrame, column: str, known: DataFrame, name: str, order: str | None = None,
                share_rows: int = SHARE_ROWS) -> DataFrame:
    """Adds match and kind: the known name that each free name means, by table.

    Exact names first, then equal ones without case and blanks, then the first known name (by `order`, else by name) that
    contains the free one or is contained in it; else null. Known names that are equal without case and blanks take the first
    one's place and the last one's spelling. An empty known name is contained in every name, an empty free name in every known one; a
    null one matches nothing. The work is done on distinct cleaned names, of which each free name then takes its own.
    """
    place = F.struct(c(order), c(name)) if order else F.struct(c(name))
    names = known.filter(c(name).isNotNull()).select(c(name).alias("match"), clean_name(c(name)).alias("key"), place.alias("place")).distinct()
    keys = names.groupBy("key").agg(F.min("place").alias("place"), F.max_by("match", "place").alias("match"))
    # numbers in the order of places: pairs are summed up by a number in place, texts would have to be sorted
    keys = stage(keys.orderBy("place").select("key", "match", F.monotonically_increasing_id().alias("place")), "known-names")
    raw = names.select("match").distinct()
    free = df.select(c(column).alias("free")).filter("free is not null").distinct()
    free = free.join(raw.withColumn("exact", F.lit(True)), F.col("free") == F.col("match"), "left").select("free", F.coalesce("exact", F.lit(False)).alias("exact"))
    free = stage(free.withColumn("clean", clean_name(F.col("free"))), "free-names")
    wanted = free.filter(~F.col("exact")).select("clean").distinct()
    same = wanted.join(keys.select(F.col("key").alias("clean"), F.col("match").alias("same")), "clean", "left")
    rest = same.filter("same is null").select("clean")
    full, some = keys.filter("key <> ''").select("key"), rest.filter("clean <> ''")
    pairs = (contained(full, some, share_rows).select(F.col("long").alias("clean"), F.col("short").alias("key"))
             .unionByName(contained(some, full, share_rows).select(F.col("short").alias("clean"), F.col("long").alias("key"))))
    blank, least = keys.agg(F.max(F.col("key") == ""), F.min_by("key", "place")).first()
    if blank:
        pairs = pairs.unionByName(some.select("clean", F.lit("").alias("key")))
    pairs = pairs.unionByName(rest.filter("clean = ''").select("clean", F.lit(least).alias("key")))
    part = pairs.join(keys.select("key", "place"), "key").groupBy("clean").agg(F.min("place").alias("place"))
    part = stage(part.join(keys.select("place", F.col("match").alias("part")), "place").select("clean", "part"), "partial-names")
    told = free.join(same.join(part, "clean", "left"), "clean", "left")
    told = told.select("free", F.when(F.col("exact"), F.col("free")).otherwise(F.coalesce("same", "part")).alias("match"),
                       F.when(F.col("exact"), "exact").when(F.col("same").isNotNull(), "normalized").when(F.col("part").isNotNull(), "partial").alias("kind"))
    counts = df.groupBy(c(column).alias("free")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 1
    told = told.join(counts, "free").withColumn("share", F.col("n") / total).drop("n")
    return lookup(df, told, column, ["match", "kind"], weight="share", right_key="free")
