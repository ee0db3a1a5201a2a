"""Exact nearest neighbours without a cross join.

Few queries (bounded in rows and bytes): the query matrix is broadcast and
each task keeps the k best per query while it streams over its rows.

Many queries: both sides are assigned to the nearest of a few pivots. The
triangle inequality gives each query an upper bound on its k-th distance from
the pivot distances alone, so it only visits cells that can still hold a
neighbour. Some queries are measured first: where vectors lie so that most cells
would be visited, all rows are dealt over blocks instead, which moves each query once per block
and not once per cell. Cells and query groups larger than a block are split by salts; blocks grow with the table
up to BLOCK_MOST rows, so that rows and queries are copied some 16 times, and beyond that in proportion to it.
Each block returns at most k rows per query, and the blocks are merged. Nothing
is dropped, so the result is the same as a full scan.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from sparktab.functions.aggregate import wide_agg
from sparktab.functions.columns import c, dbl, percent_slot, spread, unit_hash
from sparktab.functions.lookup import lookup
from sparktab.functions.staging import stage
from sparktab.operators.profile import class_sizes
from sparktab.operators.split import _before, _tie, rank_cuts

FEW_QUERIES = 10_000
FEW_BYTES = 64 << 20
BLOCK = 20_000
BLOCK_MOST = 50_000     # rows of a block that grows with the table
SHARES = 16             # blocks wanted at the most, while they are smaller than that
PIVOTS = 128            # at least, if not asked otherwise; CELL_ROWS a cell in larger tables
PIVOTS_MOST = 4_096
CELLS_AT_ONCE = 1 << 22  # numbers in one array of distances
SPAN_ROWS = 512         # rows whose distances to a pivot are taken at once
QUERIES_AT_ONCE = 512
TILE, GROUPS = 8_192, 256  # rows that meet these queries at once, and groups of them whose minima are taken
MANY = 64               # candidates a query, on average, above which double precision is cheaper
LARGE = 1e30            # squared norms that single precision holds
SAMPLE = 300            # queries that are measured before all are sent to cells
COPIES = 10_000


def vector(columns: list[str]):
    return F.array(*[c(x).cast("double") for x in columns])


def _matrix(series: pd.Series) -> np.ndarray:
    if not len(series):
        return np.zeros((0, 0))
    if isinstance(series.iloc[0], bytes):
        return np.frombuffer(b"".join(series), dtype="float64").reshape(len(series), -1)
    return np.concatenate(series.to_numpy()).astype("float64", copy=False).reshape(len(series), -1)


def _packed(col: str):
    """The numbers of a vector as bytes, which move between Spark and Python in one piece."""
    @F.pandas_udf("binary")
    def pack(vectors: pd.Series) -> pd.Series:
        return pd.Series([v.tobytes() for v in vectors], dtype=object)
    return pack(c(col).cast("array<double>")).alias(col)


def _spans(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Distances [rows, pivots], one pivot at a time: from differences, in an array of some rows that stays in the cache."""
    out, gap = np.empty((len(x), len(p))), np.empty((min(len(x), SPAN_ROWS), x.shape[1]))
    for s in range(0, len(x), SPAN_ROWS):
        part = x[s:s + SPAN_ROWS]
        gaps = gap[:len(part)]
        for j, one in enumerate(p):
            np.subtract(part, one, out=gaps)
            out[s:s + len(part), j] = np.einsum("ij,ij->i", gaps, gaps)
    return np.sqrt(out, out=out)


def _nearest(q: np.ndarray, x: np.ndarray, k: int, qid=None, xid=None):
    """(query row, x row, squared distance) of at least the k nearest x rows per query.

    A matrix product finds the candidates up to rounding; their distances are
    then taken from differences, so equal rows get equal distances.
    """
    a = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T
    if qid is not None:
        a[np.asarray(qid)[:, None] == np.asarray(xid)[None, :]] = np.inf
    kk = min(k, x.shape[0])
    edge = np.partition(a, kk - 1, axis=1)[:, kk - 1]
    slack = 1e-9 * (1 + (q * q).sum(1) + (x * x).sum(1).max())
    qi, xi = np.nonzero((a <= (edge + slack)[:, None]) & np.isfinite(a))
    return qi, xi, ((q[qi] - x[xi]) ** 2).sum(1)


def _cut(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    frame = frame.sort_values(["query", "d2", "id"], kind="stable")
    return frame[frame.groupby("query").cumcount() < k]


def _plain(q: np.ndarray, x: np.ndarray, k: int, qid=None, xid=None):
    """`_nearest` in steps that hold some CELLS_AT_ONCE distances."""
    step = max(1, min(QUERIES_AT_ONCE, CELLS_AT_ONCE // max(1, len(x))))
    parts = []
    for s in range(0, len(q), step):
        qi, xi, d2 = _nearest(q[s:s + step], x, k, *(() if qid is None else (qid[s:s + step], xid)))
        parts.append((qi + s, xi, d2))
    return tuple(np.concatenate(z) for z in zip(*parts))


def _finder(x: np.ndarray, k: int, xid=None):
    """A function (queries, their ids or None) -> (query row, x row, squared distance) of at least the k nearest x rows per query.

    Products of single precision, tile by tile, give all squared distances less the query's own square, with an error that is bounded from the norms.
    In each tile columns fall to GROUPS groups; the k-th least of the groups' minima so far has k rows at or below it. Only groups with a minimum within
    that and twice the error are looked into, and what is found there is measured from differences, as in `_nearest`. Vectors are taken from their
    mean first. Where the error leaves many candidates (norms far above the distances, many equal rows), in small tables and for numbers that single
    precision doesn't hold, `_nearest` does the work.
    """
    n, d = x.shape
    plain = lambda q, qid=None: _plain(q, x, k, qid, None if qid is None else xid)
    if n < 4 * GROUPS or 8 * k > GROUPS:
        return plain
    with np.errstate(over="ignore", invalid="ignore"):
        raw, mid = np.einsum("ij,ij->i", x, x).max(), x.mean(0)
        if not raw < LARGE:
            return plain
    gap = x - mid
    norms = np.einsum("ij,ij->i", gap, gap)
    most, unit = norms.max(), (d + 8) * 2.0 ** -23
    wide = np.zeros((n + -n % GROUPS, d + 1), dtype="float32")
    wide[:n, :d], wide[:n, d], wide[n:, d] = gap, norms, np.inf
    del gap
    buffer = np.empty(QUERIES_AT_ONCE * min(TILE, len(wide)), dtype="float32")

    def find(q, qid=None):
        with np.errstate(over="ignore", invalid="ignore"):
            own = np.einsum("ij,ij->i", q, q)
            if not own.max() < LARGE:
                return plain(q, qid)
        gap = q - mid
        slack = 2 * unit * (most + 2 * np.sqrt(most * np.einsum("ij,ij->i", gap, gap))) + 1e-9 * (1 + own + raw)
        asked = np.empty((len(q), d + 1), dtype="float32")
        asked[:, :d], asked[:, d] = -2 * gap, 1
        best = np.full((len(q), GROUPS), np.inf, dtype="float32")
        held, parts = 0, []
        for t in range(0, len(wide), TILE):
            tile = wide[t:t + TILE]
            a = np.matmul(asked, tile.T, out=buffer[:len(q) * len(tile)].reshape(len(q), -1))
            if qid is not None:
                a[:, :n - t][qid[:, None] == xid[None, t:t + TILE]] = np.inf
            a = a.reshape(len(q), -1, GROUPS)
            low = a.min(1)
            np.minimum(best, low, out=best)
            edge = np.partition(best, k - 1, axis=1)[:, k - 1]
            limit = np.nextafter((edge + slack).astype("float32"), np.float32(np.inf))
            qi, group = np.nonzero(low <= limit[:, None])
            if len(qi) <= MANY * len(q):
                inside = a[qi, :, group]
                at, row = np.nonzero(inside <= limit[qi, None])
                held += len(at)
            if max(len(qi), held) > MANY * len(q):
                return plain(q, qid)
            parts.append((qi[at], t + row * GROUPS + group[at], inside[at, row]))
        qi, xi, value = (np.concatenate(z) for z in zip(*parts))
        near = value <= limit[qi]
        qi, xi = qi[near], xi[near]
        return qi, xi, ((q[qi] - x[xi]) ** 2).sum(1)

    return find


def _topk(queries: pd.DataFrame, qm: np.ndarray, rows: pd.DataFrame, k: int, skip_same: bool) -> pd.DataFrame:
    found = []
    held, given, labels = queries["query"].to_numpy(), rows["id"].to_numpy(), rows["label"].to_numpy()
    find = _finder(_matrix(rows["vec"]), k, given)
    for s in range(0, len(qm), QUERIES_AT_ONCE):
        ids = held[s:s + QUERIES_AT_ONCE]
        qi, xi, d2 = find(qm[s:s + QUERIES_AT_ONCE], ids if skip_same else None)
        found.append(pd.DataFrame({"query": ids[qi], "id": given[xi], "d2": d2, "label": labels[xi]}))
    return _cut(pd.concat(found), k)


def knn_join(queries: DataFrame, corpus: DataFrame, k: int, query_id: str, corpus_id: str,
             query_vec: str, corpus_vec: str, label: str | None = None, skip_same: bool = False,
             few: int = FEW_QUERIES, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """(query, id, d2, label, rank): the k nearest corpus rows of every query, ties by id.

    A query whose vector is null or holds null or NaN comes back once, with nulls; corpus rows of that kind are
    nobody's neighbour.
    """
    q = queries.select(c(query_id).alias("query"), c(query_vec).cast("array<double>").alias("qvec"))
    x = corpus.select(c(corpus_id).alias("id"), c(corpus_vec).cast("array<double>").alias("vec"),
                      (c(label) if label else F.lit(None).cast("double")).alias("label"))
    broken = F.coalesce(F.exists("qvec", lambda v: v.isNull() | F.isnan(v)), F.lit(True))
    x = x.filter(~F.coalesce(F.exists("vec", lambda v: v.isNull() | F.isnan(v)), F.lit(True)))
    schema = T.StructType([T.StructField("query", q.schema["query"].dataType),
                           T.StructField("id", x.schema["id"].dataType), T.StructField("d2", T.DoubleType()),
                           T.StructField("label", x.schema["label"].dataType)])
    lost = q.filter(broken).select("query", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields[1:]],
                                   F.lit(None).cast("int").alias("rank"))
    size = q.agg(F.count_if(~broken), F.max(F.size("qvec")), F.count_if(broken)).first()
    q = q.filter(~broken)
    if size[0] <= few and size[0] * (size[1] or 0) * 8 <= FEW_BYTES:
        w = W.partitionBy("query").orderBy("d2", "id")
        found = _scan(q, x, k, schema, skip_same).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    else:
        found = _by_distinct(stage(q, "knn-q"), stage(x, "knn-x"), k, schema, skip_same, size[0], block, pivots)
    return found.unionByName(lost) if size[2] else found


def _by_distinct(q: DataFrame, x: DataFrame, k: int, schema, skip_same: bool, total: int, block: int,
                 pivots: int) -> DataFrame:
    """Search once per distinct vector, so any number of copies costs as much as one.

    Of equal corpus rows only those with the smallest ids can be among the nearest
    (one more is kept where a query skips its own id); the rank filter is
    applied inside each task before rows move. Answers are looked up by vector.
    """
    keep = k + (1 if skip_same else 0)
    zero = F.transform("vec", lambda v: v + F.lit(0.0))  # -0.0 and 0.0 are one value
    w = W.partitionBy("vec").orderBy("id")
    few = x.withColumn("vec", zero).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep).drop("_r")
    q = q.withColumn("qvec", F.transform("qvec", lambda v: v + F.lit(0.0)))
    asks = q.groupBy("qvec").agg((F.count(F.lit(1)) / F.lit(float(max(total, 1)))).alias("share"),
                                 F.min("query").alias("query"))
    asks = stage(asks, "knn-asks")
    found = _cells(asks.select("query", "qvec"), stage(few, "knn-few"), keep, schema, block, pivots)
    w = W.partitionBy("query").orderBy("d2", "id")
    best = found.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep)
    near = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("d2", "id", "label"))).alias("near"))
    answers = stage(asks.join(near, "query").select("qvec", "near", "share"), "knn-answers")
    width = 8 * (answers.agg(F.max(F.size("qvec"))).first()[0] or 1) + 64 * keep
    out = lookup(q, answers, "qvec", ["near"], "share", limit=min(100_000, FEW_BYTES // width))
    if skip_same:
        out = out.withColumn("near", F.filter("near", lambda s: s["id"] != F.col("query")))
    return (out.select("query", F.posexplode(F.slice("near", 1, k)).alias("_p", "_n"))
            .select("query", "_n.id", "_n.d2", "_n.label", (F.col("_p") + 1).alias("rank")))


def _scan(q: DataFrame, x: DataFrame, k: int, schema, skip_same: bool) -> DataFrame:
    held = q.toPandas()  # size checked by the caller
    shared = q.sparkSession.sparkContext.broadcast((held[["query"]], _matrix(held["qvec"])))

    def run(batches):
        ids, qm = shared.value
        best = None
        for rows in batches:
            if len(rows) == 0 or len(ids) == 0:
                continue
            part = _topk(ids, qm, rows, k, skip_same)
            best = part if best is None else _cut(pd.concat([best, part]), k)
        if best is not None:
            yield best

    return spread(x).mapInPandas(run, schema)


def _block(rows: int, block: int) -> int:
    """Rows of a block: as asked in small tables, more in larger ones, so that copies don't grow with the table while blocks fit a task."""
    return max(block, min(BLOCK_MOST, math.ceil(rows / SHARES)))


def _meet(placed: DataFrame, visits: DataFrame, k: int, schema, skip_same: bool, block: int) -> DataFrame:
    """At least the k nearest (query, id, d2, label) in the cells that each query visits; `placed` has cell, `visits` cells.

    Pairs of blocks are dealt over a fixed number of tasks, as their bytes don't tell their work.
    """
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    load = visits.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("m"))
    shares = stage(sizes.join(load, "cell").select("cell", F.ceil(F.col("n") / block).cast("int").alias("xs"),
                                                   F.ceil(F.col("m") / block).cast("int").alias("qs")), "knn-shares")
    pairs = shares.agg(F.sum(F.col("xs").cast("bigint") * F.col("qs"))).first()[0] or 1
    spark = placed.sparkSession
    tasks = max(1, min(pairs, max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    slots = lambda s: F.explode(F.sequence(F.lit(0), F.col(s) - 1))
    key = ["cell", "a", "b"]
    shares = F.broadcast(shares)
    left = (placed.select("id", _packed("vec"), "label", "cell").join(shares, "cell").withColumn("a", F.pmod(F.xxhash64("id"), F.col("xs")).cast("int"))
            .withColumn("b", slots("qs")).drop("xs", "qs").repartition(tasks, *key))
    right = (visits.select("query", _packed("qvec"), "cells").select("query", "qvec", F.explode("cells").alias("cell")).join(shares, "cell")
             .withColumn("b", F.pmod(F.xxhash64("query"), F.col("qs")).cast("int")).withColumn("a", slots("xs")).drop("xs", "qs").repartition(tasks, *key))

    def best(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if len(rows) == 0 or len(asks) == 0:
            return pd.DataFrame({f.name: [] for f in schema})
        return _topk(asks[["query"]], _matrix(asks["qvec"]), rows, k, skip_same)

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(best, schema)


def _reached(m: np.ndarray, pivots: np.ndarray, radius: np.ndarray, steps: np.ndarray, keep: int):
    """(query row, cell) of the cells that may hold one of the `keep` nearest, by the triangle inequality."""
    d = _spans(m, pivots)
    bound = (d + steps[None, :, -1]).min(1)
    loose = np.flatnonzero(~np.isfinite(bound))  # no cell has that many rows
    if len(loose):
        reach = (d[loose][:, :, None] + steps[None, :, :]).reshape(len(loose), -1)
        bound[loose] = np.partition(reach, keep - 1, axis=1)[:, keep - 1] if reach.shape[1] >= keep else np.inf
    return np.nonzero(d - radius[None, :] <= bound[:, None] * (1 + 1e-9) + 1e-9)


def _cells(q: DataFrame, x: DataFrame, keep: int, schema, block: int, pivots: int) -> DataFrame:
    sc = q.sparkSession.sparkContext
    n, dims = x.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    block = _block(n, block)
    one = F.lit(0).alias("cell")
    whole = lambda: _meet(x.select("*", one), q.select("*", F.array(F.lit(0)).alias("cells")), keep, schema, False, block)
    wanted = max(pivots, min(PIVOTS_MOST, INDEX_BYTES // (8 * max(1, dims or 1)), n // CELL_ROWS))
    order = F.xxhash64(F.to_json(F.struct("vec")))
    picked = [r[0] for r in x.select("vec").distinct().orderBy(order).limit(wanted).collect()]
    if len(picked) < 2:
        return whole()
    p = sc.broadcast(np.array(picked, dtype="float64"))

    def assign(batches):
        for rows in batches:
            for s in range(0, len(rows), max(1, CELLS_AT_ONCE // len(p.value))):
                part = rows.iloc[s:s + max(1, CELLS_AT_ONCE // len(p.value))]
                d = _spans(_matrix(part["vec"]), p.value)
                cell = d.argmin(1)
                yield part.assign(cell=cell.astype("int32"), pd=d[np.arange(len(part)), cell])

    kinds = T.StructType(x.schema.fields + [T.StructField("cell", T.IntegerType()),
                                            T.StructField("pd", T.DoubleType())])
    placed = stage(x.mapInPandas(assign, kinds), "knn-cells")
    stats = {r["cell"]: r for r in placed.groupBy("cell").agg(
        F.max("pd").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}
    w = W.partitionBy("cell").orderBy("pd")
    near: dict[int, list[float]] = {}
    for r in (placed.select("cell", "pd").withColumn("r", F.row_number().over(w))
              .filter(F.col("r") <= keep).collect()):
        near.setdefault(r["cell"], []).append(r["pd"])
    cells = sorted(stats)
    table = np.full((len(cells), keep), np.inf)
    for i, cell in enumerate(cells):
        table[i, :len(near[cell])] = sorted(near[cell])
    guide = sc.broadcast((np.array(cells), np.array([stats[i]["radius"] for i in cells]), table))
    some = [r[0] for r in q.orderBy(F.xxhash64("query"), "query").limit(SAMPLE).select("qvec").collect()]
    _, ci = _reached(np.array(some, dtype="float64"), p.value[guide.value[0]], *guide.value[1:], keep)
    rows_met = np.array([stats[i]["n"] for i in cells])[ci].sum() / len(some)
    visited, blocks = len(ci) / len(some), math.ceil(n / block)
    if visited > blocks and rows_met > n / 2 or visited > max(64, 4 * blocks):
        return whole()

    def visit(batches):
        ids, radius, steps = guide.value
        for rows in batches:
            for s in range(0, len(rows), max(1, CELLS_AT_ONCE // len(ids))):
                part = rows.iloc[s:s + max(1, CELLS_AT_ONCE // len(ids))]
                qi, ci = _reached(_matrix(part["qvec"]), p.value[ids], radius, steps, keep)
                yield part.assign(cells=np.split(ids[ci].astype("int32"), np.cumsum(np.bincount(qi, minlength=len(part)))[:-1]))

    kinds = T.StructType(q.schema.fields + [T.StructField("cells", T.ArrayType(T.IntegerType()))])
    return _meet(placed, stage(q.mapInPandas(visit, kinds), "knn-visits"), keep, schema, False, block)


CELL_ROWS = 2_000      # rows wanted in a leaf of the two-level index
INDEX_BYTES = 32 << 20  # of all pivots: they travel with the tasks
LEAVES = 1_024         # of the two-level index at the most: cells grow with the table beyond that
TUNE_QUERIES = 200     # searched exactly to learn how many cells to visit


def _pivot_sample(x: DataFrame, rows: int, wanted: int) -> DataFrame:
    """(vec, _h): some `wanted` distinct vectors or more, taken by their hash, so copies don't count; all if that gives too few."""
    hashed = x.select("vec", F.xxhash64(F.to_json(F.struct("vec"))).alias("_h"))
    share = math.ceil(min(1.0, wanted / max(rows, 1)) * (1 << 20))
    some = stage(hashed.filter(F.pmod("_h", F.lit(1 << 20)) < share).distinct(), "ann-sample")
    return some if share == 1 << 20 or some.count() * 4 >= wanted else stage(hashed.distinct(), "ann-sample")


def knn_approx(queries: DataFrame, corpus: DataFrame, k: int, query_id: str, corpus_id: str, query_vec: str, corpus_vec: str,
               label: str | None = None, skip_same: bool = False, probes: int | None = None, target: float = 0.95,
               cell_rows: int = CELL_ROWS, block: int = BLOCK) -> DataFrame:
    """(query, id, d2, label, rank) like `knn_join`, from the cells nearest to each query only: exact distances, some neighbours may be missed.

    `probes` cells are visited for each query. Unless given, the number is measured: TUNE_QUERIES queries (by hash) are searched exactly, and
    enough cells are taken that the share `target` of their neighbours lies within. Vectors without structure need a large part of all cells,
    clustered ones a few.

    An index of pivots in two levels: rows fall to the nearest of sqrt(cells) upper pivots, then to the nearest of its own
    lower ones. A query measures the upper pivots, the lower ones of as many as `probes` cells need, and visits the `probes` nearest cells. Work per
    query: some sqrt(cells) pivots and the rows of the groups it visits. The pivots are the rows of least hash (a bounded,
    documented sample); every row is indexed. There are at most LEAVES cells, and pivots are held to INDEX_BYTES, beyond which cells grow.
    Neighbouring cells form SHARES groups, or more where a group would have more than BLOCK_MOST rows; a query is sent once to each group
    with one of its cells and compared with all rows there, so that it is copied some times and not once per cell. Groups above `block` rows are dealt over shares. Vectors that are null or hold null or NaN are nobody's neighbour and find none. Measure with `recall`.
    """
    clean = lambda v: ~F.coalesce(F.exists(v, lambda e: e.isNull() | F.isnan(e)), F.lit(True))
    q = stage(queries.select(c(query_id).alias("query"), c(query_vec).cast("array<double>").alias("qvec")).filter(clean("qvec")), "ann-q")
    x = stage(corpus.select(c(corpus_id).alias("id"), c(corpus_vec).cast("array<double>").alias("vec"),
                            (c(label) if label else F.lit(None).cast("double")).alias("label")).filter(clean("vec")), "ann-x")
    n, dims = x.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    schema = T.StructType([T.StructField("query", q.schema["query"].dataType), T.StructField("id", x.schema["id"].dataType),
                           T.StructField("d2", T.DoubleType()), T.StructField("label", x.schema["label"].dataType)])
    if not n or q.isEmpty():
        return q.sparkSession.createDataFrame([], T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())]))
    sc = q.sparkSession.sparkContext
    width = max(1, math.isqrt(min(max(1, n // cell_rows), LEAVES, INDEX_BYTES // (8 * max(1, dims or 1)))))
    sample = _pivot_sample(x, n, 16 * width * width)
    upper = [r[0] for r in sample.orderBy("_h", "vec").limit(width).collect()]
    top = sc.broadcast(np.array(upper, dtype="float64").reshape(len(upper), -1))

    def place_upper(batches):
        for rows in batches:
            if len(rows):
                yield rows.assign(up=_spans(_matrix(rows["vec"]), top.value).argmin(1).astype("int32"))

    placed = sample.mapInPandas(place_upper, T.StructType(sample.schema.fields + [T.StructField("up", T.IntegerType())]))
    w = W.partitionBy("up").orderBy("_h", "vec")
    lower: dict[int, list] = {u: [] for u in range(len(upper))}
    for r in placed.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= width).select("up", "vec").collect():  # width x width at most
        lower[r["up"]].append(r["vec"])
    lower = {u: held or [upper[u]] for u, held in lower.items()}
    ups = sorted(lower)
    first = np.cumsum([0, *[len(lower[u]) for u in ups]])
    tree = sc.broadcast((np.array(ups), {u: (int(first[i]), np.array(lower[u], dtype="float64")) for i, u in enumerate(ups)}))

    def place(batches):
        for rows in place_upper(batches):
            m, up, cell = _matrix(rows["vec"]), rows["up"].to_numpy(), np.zeros(len(rows), dtype="int32")
            for u in np.unique(up):
                own = np.flatnonzero(up == u)
                start, pivots = tree.value[1][int(u)]
                cell[own] = start + _spans(m[own], pivots).argmin(1)
            yield rows.drop(columns="up").assign(cell=cell)

    def visit(batches):
        ids, below = tree.value
        sizes = np.array([len(below[u][1]) for u in ids])
        group = np.repeat(np.arange(len(ids)), sizes)
        step = max(1, CELLS_AT_ONCE // len(group))
        for rows in batches:
            for s in range(0, len(rows), step):
                part = rows.iloc[s:s + step]
                m = _matrix(part["qvec"])
                far = _spans(m, top.value[ids])
                order = far.argsort(1, kind="stable")
                met = np.cumsum(sizes[order], axis=1) - sizes[order] < 4 * probes  # upper cells until four times the wanted leaves are met
                reach = np.zeros(met.shape, dtype=bool)
                np.put_along_axis(reach, order, met, axis=1)
                d = np.full((len(m), len(group)), np.inf)
                for i, u in enumerate(ids.tolist()):
                    own = np.flatnonzero(reach[:, i])
                    if len(own):
                        d[np.ix_(own, np.flatnonzero(group == i))] = _spans(m[own], below[u][1])
                last = min(probes, d.shape[1]) - 1
                edge = np.partition(d, last, axis=1)[:, last]
                qi, ci = np.nonzero((d <= edge[:, None]) & np.isfinite(d))
                found = np.unique(qi * np.int64(groups + 1) + bins[ci])  # each group of cells once
                qi = found // (groups + 1)
                yield part.assign(cells=np.split((found % (groups + 1)).astype("int32"), np.cumsum(np.bincount(qi, minlength=len(part)))[:-1]))

    cell = T.StructField("cell", T.IntegerType())
    leaves = stage(x.mapInPandas(place, T.StructType(x.schema.fields + [cell])), "ann-cells")
    if probes is None:
        some = stage(q.orderBy(F.xxhash64("query"), "query").limit(TUNE_QUERIES), "ann-some")
        exact = knn_join(some, x, k, "query", "id", "qvec", "vec", skip_same=skip_same).select("query", "id")
        at = exact.join(leaves.select("id", "cell"), "id").groupBy("query").agg(F.collect_list("cell").alias("cells")).join(some, "query").collect()
        pivots = np.concatenate([tree.value[1][u][1] for u in ups])
        ranks = [r for row in at for r in np.argsort(np.argsort(_spans(np.array([row["qvec"]]), pivots)[0], kind="stable"))[row["cells"]]]
        probes = int(np.quantile(ranks, target, method="higher")) + 1 if ranks else 1
    counts = np.zeros(first[-1], dtype="int64")
    for r in leaves.groupBy("cell").count().collect():  # a row per cell
        counts[r["cell"]] = r["count"]
    groups = max(SHARES, math.ceil(n / BLOCK_MOST))
    bins = ((np.cumsum(counts) - counts) * groups // n).astype("int32")  # group of each cell, in the order of the tree
    bin_of = F.broadcast(q.sparkSession.createDataFrame(list(enumerate(bins.tolist())), "cell int, _group int"))
    leaves = leaves.join(bin_of, "cell").drop("cell").withColumnRenamed("_group", "cell")
    visits = stage(q.mapInPandas(visit, T.StructType(q.schema.fields + [T.StructField("cells", T.ArrayType(T.IntegerType()))])), "ann-visits")
    found = _meet(leaves, visits, k, schema, skip_same, _block(n, block))
    w = W.partitionBy("query").orderBy("d2", "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, recall): share of the exact neighbours (query, id) that were found, of all queries."""
    hit = exact.filter("id is not null").select("query", "id").join(found.select("query", "id").withColumn("_hit", F.lit(1)), ["query", "id"], "left")
    return hit.agg(F.countDistinct("query").alias("queries"), (F.count("_hit") / F.count(F.lit(1))).alias("recall"))


def gap_impute(df: DataFrame, key: str, columns: list[str], k: int = 5, few: int = FEW_QUERIES, **kw) -> DataFrame:
    """Fill the nulls of several columns from the k nearest rows, distances taken over the parts that both rows know.

    The squared distance is scaled by columns / known parts. A null in a column takes the mean of that column over the k nearest rows that
    have it, ties by key; rows that share no part are no neighbours, and where there are none at all the column's mean is taken. NaN counts as null.

    Rows are grouped by which parts they know. For two such patterns the shared parts are fixed, so the search within
    the pair is an ordinary one (`knn_join`, exact, without comparing all pairs); the pairs' answers are merged by the scaled distance.
    There are as many searches as pairs of patterns that occur: bounded by the columns, not by the rows.
    """
    base = df.select(c(key).alias("_id"), *[dbl(x).alias(x) for x in columns])
    bits = reduce(add, [F.when(c(x).isNotNull(), F.lit(1 << i)).otherwise(0) for i, x in enumerate(columns)])
    base = stage(base.withColumn("_known", bits.cast("bigint")), "gap-rows")
    seen = sorted(r[0] for r in base.select("_known").distinct().collect())  # at most 2 ** columns
    means = wide_agg(base, {x: F.avg(c(x)) for x in columns})
    out = df
    for i, x in enumerate(columns):
        found = None
        for ask in seen:
            if ask >> i & 1:
                continue
            for give in seen:
                shared = [y for j, y in enumerate(columns) if ask & give & 1 << j]
                if not give >> i & 1 or not shared:
                    continue
                rows = base.withColumn("_v", vector(shared))
                near = knn_join(rows.filter(F.col("_known") == ask), rows.filter(F.col("_known") == give), k, "_id", "_id", "_v", "_v", x, few=few, **kw)
                near = near.select("query", "id", (F.col("d2") * (len(columns) / len(shared))).alias("d2"), "label")
                found = near if found is None else found.unionByName(near)
        if found is not None:
            w = W.partitionBy("query").orderBy(F.round("d2", 9), "id")
            fill = (found.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).groupBy(F.col("query").alias("_q"))
                    .agg(F.avg("label").alias("_fill")))
            out = out.join(fill, c(key) == F.col("_q"), "left")
        else:
            out = out.withColumns({"_fill": F.lit(None).cast("double"), "_q": F.lit(None)})
        out = out.withColumn(x, F.coalesce(dbl(x), F.col("_fill"), F.lit(means[x]))).drop("_fill", "_q")
    return out.select(*[c(x) for x in df.columns])


def knn_classify(test: DataFrame, train: DataFrame, key: str, vec: str, label: str, k: int = 5, **kw) -> DataFrame:
    """Majority of the k nearest, smallest label on ties."""
    near = knn_join(test, train, k, key, key, vec, vec, label, **kw)
    votes = near.groupBy("query", "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy(F.col("query").alias(key)).agg(
        F.min_by("label", F.struct((-F.col("n")).alias("n"), "label")).alias("prediction"))


def knn_regress(test: DataFrame, train: DataFrame, key: str, vec: str, label: str, k: int = 5, **kw) -> DataFrame:
    near = knn_join(test, train, k, key, key, vec, vec, label, **kw)
    return near.groupBy(F.col("query").alias(key)).agg(F.avg("label").alias("prediction"))


def knn_impute(df: DataFrame, key: str, column: str, features: list[str], k: int = 5, **kw) -> DataFrame:
    """Fill nulls with the mean of the k rows nearest by the other features."""
    v = df.withColumn("_v", vector(features))
    fill = knn_regress(v.filter(dbl(column).isNull()), v.filter(dbl(column).isNotNull()), key, "_v", column, k, **kw)
    return (df.join(fill, key, "left")
            .withColumn(column, F.coalesce(dbl(column), F.col("prediction"))).drop("prediction"))


def smote(df: DataFrame, key: str, label: str, features: list[str], k: int = 5, seed: str = "smote", **kw) -> DataFrame:
    """Rows between a minority row and one of its k nearest rows of the same class.

    Added until every class has as many rows as the largest. Base row,
    neighbour and place on the line depend on hashes of the key, so reruns agree.
    Returns the old and new rows with a `synthetic` flag; new keys are null. A class of one row is repeated.
    """
    base = df.select(c(key), c(label), *[c(f).cast("double").alias(f) for f in features])
    sizes = class_sizes(base, label)
    top = max(sizes.values())
    out = base.withColumn("synthetic", F.lit(False))
    for value, n in sizes.items():
        need = top - n
        if need <= 0:
            continue
        if n < 2:  # no neighbour to go towards: the row is repeated
            parts = F.explode(F.sequence(F.lit(0), F.lit((need - 1) // COPIES)))
            alone = base.filter(c(label) == F.lit(value)).withColumn("_part", parts)
            if need > 10 * COPIES:
                alone = alone.repartition("_part")
            alone = alone.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES), F.lit(need) - F.col("_part") * COPIES))))
            out = out.unionByName(alone.select(F.lit(None).cast(df.schema[key].dataType).alias(key), c(label), *[c(f) for f in features],
                                               F.lit(True).alias("synthetic")))
            continue
        rows = base.filter(c(label) == F.lit(value)).withColumn("_v", vector(features))
        kk = min(k, n - 1)
        near = knn_join(rows, rows, kk, key, key, "_v", "_v", skip_same=True, **kw).select(
            F.col("query").alias(key), F.col("id").alias("_nb"), F.col("rank").alias("_pick"))
        # the vectors of the kk neighbours lie on the row before it is copied, so no copy takes part in a join
        mate = rows.select(c(key).alias("_nb"), F.col("_v").alias("_w"))
        near = near.join(mate, "_nb").groupBy(c(key)).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pick", "_w"))), lambda s: s["_w"]).alias("_near"))
        rows = stage(rows.join(near, key), "smote-rows")
        # need // n copies each, and one more for the first need % n rows in hash order
        copies = F.lit(need // n)
        if need % n:
            spot, tie = percent_slot(c(key), 1 << 32, seed), _tie(rows, key)
            cut = rank_cuts(rows, spot, tie, [(None, need % n)])[0]
            copies = copies + _before(spot, tie, cut).cast("int")
        # in two steps, so that a row with very many copies is shared out between tasks
        more = rows.withColumn("_copies", copies).filter("_copies > 0").withColumn(
            "_part", F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / COPIES).cast("int"))))
        if need > 10 * COPIES:
            more = more.repartition(c(key), "_part")
        more = more.withColumn("_copy", F.explode(F.sequence(
            F.lit(1), F.least(F.lit(COPIES), F.col("_copies") - F.col("_part") * COPIES)))).withColumn(
            "_copy", F.col("_copy") + F.col("_part") * COPIES)
        tag = F.concat_ws("|", c(key).cast("string"), F.col("_copy").cast("string"))
        more = more.withColumn("_w", F.get("_near", percent_slot(tag, kk, seed + "n").cast("int"))) \
            .withColumn("_gap", unit_hash(tag, seed + "g"))
        new = [(F.col("_v")[i] + F.col("_gap") * (F.col("_w")[i] - F.col("_v")[i])).alias(f)
               for i, f in enumerate(features)]
        out = out.unionByName(more.select(F.lit(None).cast(df.schema[key].dataType).alias(key), c(label), *new,
                                          F.lit(True).alias("synthetic")))
    return out
