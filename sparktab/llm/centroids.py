"""Centroid clustering with a vantage-point tree over the centroids.

Vectors become whole numbers first (floor(SCALE * x)), so sums, means and distances are exact and no result depends on
the order of rows or partitions. The first centroids are the vectors whose seeded sha256 is least. Each round rebuilds a
vantage-point tree over the centroids and broadcasts it; every task assigns its vectors and sends one partial sum per
centroid; the new centroids are the floors of the means.

The tree: a node holds one centroid (its vantage point) and the nearest and farthest distance from it to the centroids
inside and outside its radius. Each vector walks it best first: of the nodes it has met it takes the one with the least
possible distance, measures the vantage point with whole numbers, and gives both children their bounds. A node is left out only
if even its bound, lessened by what floating point may have added, is above the best distance; an equal one is visited, so that of
equally near centroids the smaller number is found. The vectors of a batch walk side by side, each in its own order.

Size: the tree and all sums hold k x dims numbers, k and dims being parameters; walking takes a table of (batch rows x nodes), cut to CELLS.

Defined results: vectors that are null, of another length, or hold a null or non-finite part are left out; a null id
sorts behind all others when the first centroids are chosen; equal rows are rows of their own, equal first vectors are centroids of
their own (ties go to the smaller number); with fewer vectors than k there are as many centroids as vectors; an empty table gives
an empty result; a part of BOUND or more after scaling is an error, as its distances would not fit a long. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktab.llm.common import keep, query, table

CLUSTERS, DIMS, ROUNDS, SEED, SCALE = 40, 64, 5, 2, 256
BOUND = 1 << 27
CELLS = 1 << 21
_SLACK = 1e-9


@dataclass
class Tree:
    """Nodes 0..n-1: the centroid of each, its children (-1: none), and the distances (least, most) from it to theirs."""
    centroids: np.ndarray   # [k, dims] whole numbers
    point: np.ndarray       # centroid of each node
    child: np.ndarray       # [n, 2] inside, outside
    near: np.ndarray        # [n, 2] least distance to the centroids of a child
    far: np.ndarray         # [n, 2] most

    @classmethod
    def build(cls, centroids: np.ndarray) -> Tree:
        k = len(centroids)
        point, child = np.zeros(k, dtype=np.int64), np.full((k, 2), -1)
        near, far = np.zeros((k, 2)), np.zeros((k, 2))
        made, todo = 0, [(np.arange(k), -1, 0)]
        while todo:
            members, parent, side = todo.pop()
            if not len(members):
                continue
            spread = ((centroids[members] - centroids[members].mean(axis=0)) ** 2).sum(axis=1)
            top = int(np.argmax(spread))
            own, rest = members[top], np.delete(members, top)
            node, made = made, made + 1
            point[node] = own
            if parent >= 0:
                child[parent, side] = node
            gap = np.sqrt(((centroids[rest] - centroids[own]) ** 2).sum(axis=1).astype(np.float64))
            order = np.argsort(gap, kind="stable")
            cut = (len(rest) + 1) // 2
            for i, part in enumerate((order[:cut], order[cut:])):
                if len(part):
                    near[node, i], far[node, i] = gap[part].min(), gap[part].max()
                    todo.append((rest[part], node, i))
        return cls(centroids, point, child, near, far)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number of the nearest centroid, squared distance) of each vector, and how many distances it took."""
        rows, k = vectors.shape[0], len(self.point)
        label, best = np.full(rows, k), np.full(rows, np.iinfo(np.int64).max)
        step, took = max(1, CELLS // max(k, vectors.shape[1])), 0
        for at in range(0, rows, step):
            took += self._walk(vectors[at:at + step], label[at:at + step], best[at:at + step])
        return label, best, took

    def _walk(self, x: np.ndarray, label: np.ndarray, best: np.ndarray) -> int:
        bound = np.full((len(x), len(self.point)), np.inf)  # least possible distance of each node met and not yet visited
        bound[:, 0] = 0
        row, took = np.arange(len(x)), 0
        while len(row):
            node = bound[row, :].argmin(axis=1)
            reach = np.sqrt(best[row].astype(np.float64))
            low = bound[row, node]
            open_ = np.isfinite(low) & (low <= reach + _SLACK * (1 + reach))
            row, node = row[open_], node[open_]
            if not len(row):
                break
            took += len(row)
            bound[row, node] = np.inf
            own = self.point[node]
            gap = x[row] - self.centroids[own]
            square = np.einsum("ij,ij->i", gap, gap)
            closer = (square < best[row]) | ((square == best[row]) & (own < label[row]))
            best[row[closer]], label[row[closer]] = square[closer], own[closer]
            distance = np.sqrt(square.astype(np.float64))
            for side in (0, 1):
                has = np.flatnonzero(self.child[node, side] >= 0)
                d, n = distance[has], node[has]
                least = np.maximum(np.maximum(d - self.far[n, side], self.near[n, side] - d), 0)
                least = np.maximum(least - _SLACK * (1 + d + self.far[n, side]), 0)
                bound[row[has], self.child[n, side]] = least
        return took


def whole_vectors(rows: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and p (array of int) of the vectors that have `dims` finite parts."""
    part = F.col("embedding").cast("array<double>")
    usable = F.forall(part, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    in_range = F.forall("p", lambda x: F.abs(x) < BOUND)
    checked = F.when(in_range, F.col("p")).otherwise(F.raise_error(F.lit(f"a part times {scale} reaches {BOUND}")).cast("array<double>"))
    return (rows.filter((F.size("embedding") == dims) & usable)
            .select("vec_id", F.transform(part, lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("p"))
            .select("vec_id", checked.cast("array<int>").alias("p")))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The k vectors with the least sha256 of `seed:vec_id`: a top-k, never a sort of all."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(F.coalesce(key, F.lit("~")).alias("key"), "p").orderBy("key", "p").limit(k).collect()
    return np.array([r.p for r in rows], dtype=np.int64)


def move(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: exact floors of the means of what each has gathered."""
    k, dims = centroids.shape
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(Tree.build(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        count, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            if not len(x):
                continue
            label = tree.nearest(x)[0]
            order = np.argsort(label, kind="stable")
            found, start, n = np.unique(label[order], return_index=True, return_counts=True)
            sums[found] += np.add.reduceat(x[order], start, axis=0)
            count[found] += n
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[at]), pa.array(list(sums[at]), pa.list_(pa.int64()))],
                                         names=["cluster", "n", "s"])

    partial = vectors.select("p").mapInArrow(run, "cluster int, n bigint, s array<bigint>")
    total = partial.groupBy("cluster").agg(F.sum("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(dims)])).collect()  # at most k rows
    shared.destroy()
    out = centroids.copy()
    for cluster, n, sums in total:
        out[cluster] = [s // n for s in sums]
    return out


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector."""
    dims = centroids.shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast(Tree.build(centroids))
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            label, square, _ = tree.nearest(_matrix(batch.column(1), dims))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label.astype(np.int32)), pa.array(square)],
                                             names=["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "p").mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint")


def cluster(rows: DataFrame, k: int = CLUSTERS, dims: int = DIMS, rounds: int = ROUNDS, seed: int = SEED,
            scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance of every usable vector; the final centroids)."""
    vectors = keep(whole_vectors(rows, dims, scale), "vectors")  # each round reads these numbers only
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), np.empty((0, dims), dtype=np.int64)
    for _ in range(rounds):
        centroids = move(vectors, centroids)
    return keep(assign(vectors, centroids), "assigned"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster_inertia, inertia and centroid_sha256: a lookup of at most k rows."""
    spark = assigned.sparkSession
    shown = [(i, ",".join(map(str, c.tolist()))) for i, c in enumerate(centroids)]
    named = spark.createDataFrame(shown, "cluster int, parts string").select("cluster", F.sha2(F.col("parts").cast("binary"), 256).alias("centroid_sha256"))
    per = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = assigned.agg(F.sum("distance")).first()[0]
    per = per.join(F.broadcast(named), "cluster").withColumn("inertia", F.lit(whole).cast("bigint"))
    return assigned.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = CLUSTERS, dims: int = DIMS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE) -> str:
    """The same as one statement: every vector against every centroid, round after round."""
    square = "list_sum(list_transform(list_zip(v.p, c.p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [f"""with v as materialized (
        select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as p from embeddings
        where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
      h as (select coalesce(sha256('{seed}:' || cast(vec_id as varchar)), '~') as key, p from v),
      c0 as materialized (select row_number() over (order by key, p) - 1 as c, p from h order by key, p limit {k})"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} as materialized (select rid, vec_id, p, c, d from (
            select v.rid, v.vec_id, v.p, c.c, {square} as d, row_number() over (partition by v.rid order by {square}, c.c) as r from v, c{i} c) where r = 1)""")
        if i < rounds:
            parts.append(f"""s{i} as (select c, j, sum(x) as s, count(*) as n from (select c, unnest(p) as x, unnest(range({dims})) as j from a{i}) group by c, j),
      m{i} as (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by j) as p from s{i} group by c),
      c{i + 1} as materialized (select o.c, coalesce(m.p, o.p) as p from c{i} o left join m{i} m on o.c = m.c)""")
    return ",\n".join(parts) + f"""
      select a.vec_id, cast(a.c as integer) as cluster, cast(a.d as bigint) as distance, cast(sum(a.d) over (partition by a.c) as bigint) as cluster_inertia,
        cast(sum(a.d) over () as bigint) as inertia, sha256(array_to_string(c.p, ',')) as centroid_sha256
      from a{rounds} a join c{rounds} c on a.c = c.c"""


@query("op11_centroid_clustering", _sql())
def op11_centroid_clustering(spark, folder):
    return with_inertia(*cluster(table(spark, folder, "embeddings")))
