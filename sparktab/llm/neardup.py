"""Near-duplicate detection with HyperMinHash.

A document's shingle hashes fall into 256 buckets; each bucket's register keeps of its smallest hash the number of
leading zeros and ten mantissa bits (16 bits in all). Empty buckets borrow from the next bucket of a fixed
probing order. Bands of five registers bring similar documents together; the share of equal registers, corrected for
chance collisions, estimates the Jaccard similarity; and what the estimate can't exclude is verified on full sets.

1. Exact copies of a set are one class (a digest of the set); all that follows works on classes.
2. Classes in one band bucket are compared by registers: estimated links make candidate clusters.
3. Inside a cluster, exact intersections of the full sets give the links; their components are the result.

Bands: at similarity 0.75 a pair shares no band with a chance of 1 in a million. The estimate cuts five standard
errors below the threshold. Neither pairs nor sets of a large group meet in one task (see graph.connected).

Defined results: null and wordless texts have no shingles, are linked with nothing and kept; fewer than five words
are one shingle; equal rows share the smallest id; without an id in the component its id is null and it is kept;
an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktab.llm.common import keep, query, row_hash, table, without
from sparktab.llm.graph import connected
from sparktab.llm.shingles import mix, shingle_set

PERCENT = 75
REGISTERS, MANTISSA = 256, 10
ROWS, BANDS = 5, 51
LEAST_KEYS = 1_000_000  # wanted rows that are broadcast to the second scan

_PROBES = np.argsort(mix(np.arange(REGISTERS * REGISTERS, dtype=np.uint64)).reshape(REGISTERS, REGISTERS), axis=1)


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (uint16) of a sorted, non-empty set of 64-bit hashes."""
    bucket = (hashes >> np.uint64(56)).astype(np.int64)
    at = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1])
    rest = hashes[at] << np.uint64(8)
    zeros = np.minimum(64 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1] - 11, 56)
    mantissa = (rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    out = np.zeros(REGISTERS, dtype=np.uint16)
    out[bucket[at]] = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)
    full = np.zeros(REGISTERS, dtype=bool)
    full[bucket[at]] = True
    empty = np.flatnonzero(~full)
    if len(empty):
        out[empty] = out[_PROBES[empty, full[_PROBES[empty]].argmax(axis=1)]]
    return out


@functools.lru_cache(maxsize=4096)
def _chance(n: int, m: int) -> float:
    """Chance that registers of two disjoint sets agree, for 2**n and 2**m elements in a bucket."""
    i = np.arange(1, 57)[:, None]
    j = np.arange(1 << MANTISSA)[None, :]
    low = (1 + j / (1 << MANTISSA)) * 2.0 ** -i
    high = (1 + (j + 1) / (1 << MANTISSA)) * 2.0 ** -i
    def held(k):
        return np.exp(2.0 ** k * np.log1p(-low)) - np.exp(2.0 ** k * np.log1p(-np.minimum(high, 1 - 1e-12)))
    return float((held(n) * held(m)).sum())


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, corrected for collisions by chance."""
    level = lambda x: np.maximum(np.round(np.log2(np.maximum(x / REGISTERS, 1))), 0).astype(int)
    a, b = np.broadcast_arrays(level(np.asarray(n)), level(np.asarray(m)))
    chance = np.array([_chance(min(x, y), max(x, y)) for x, y in zip(a.ravel().tolist(), b.ravel().tolist())]).reshape(a.shape)
    return (equal / REGISTERS - chance) / (1 - chance)


def _maybe(sizes: np.ndarray, data: list[bytes]) -> np.ndarray:
    """Pairs that the registers and the sizes can't exclude. Small sets fill few buckets, so they get a wider margin."""
    regs = np.frombuffer(b"".join(data), dtype=np.uint16).reshape(len(data), REGISTERS)
    n = sizes.astype(float)
    link = np.zeros((len(n), len(n)), dtype=bool)
    t = PERCENT / 100
    for i in range(len(n) - 1):
        m = n[i + 1:]
        short, long = np.minimum(m, n[i]), np.maximum(m, n[i])
        error = np.sqrt(t * (1 - t) * (REGISTERS + short) / (REGISTERS * short))
        like = estimate((regs[i + 1:] == regs[i]).sum(axis=1), n[i:i + 1], m)
        link[i, i + 1:] = (short * 100 >= long * PERCENT) & (like >= t - 5 * error)
    return link | link.T


def _verified(sizes: np.ndarray, data: list[bytes]) -> np.ndarray:
    """Pairs with 100 * intersection >= PERCENT * union on the full sets."""
    sets = [np.frombuffer(d, dtype=np.uint64) for d in data]
    n = np.array([len(s) for s in sets])
    if len(sets) == 2:
        shared = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        inter = np.array([[0, shared], [shared, 0]])
    else:
        owner = np.repeat(np.arange(len(sets)), n)
        value, index, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        place = np.cumsum(times > 1) - 1
        some = times[index] > 1
        owner, index, wide = owner[some], place[index[some]], int((times > 1).sum())
        inter = np.zeros((len(sets), len(sets)))
        step = max(1, 16_000_000 // len(sets))
        for at in range(0, wide, step):  # columns in slices: memory stays bounded for long texts
            here = (index >= at) & (index < at + step)
            part = np.zeros((len(sets), min(step, wide - at)), dtype=np.float32)
            part[owner[here], index[here] - at] = 1
            inter += part @ part.T
    link = inter * 100 >= PERCENT * (n[:, None] + n[None, :] - inter)
    np.fill_diagonal(link, False)
    return link


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, rk (a hash of id and text), n (set size), digest of the set, regs (null for an empty set)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, regs = [], [], []
            for t in batch.column(2):
                s = shingle_set(t.as_py())
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary())],
                names=["doc_id", "rk", "n", "digest", "regs"])

    rows = docs.select("doc_id", row_hash().alias("rk"), F.col("text").cast("binary").alias("t"))
    return rows.mapInArrow(run, f"doc_id {kind}, rk bigint, n bigint, digest binary, regs binary")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rid, n, payload (the whole set) for the rows named in wanted (rk, rid)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["rid", "n", "payload"])

    if wanted.count() <= LEAST_KEYS:
        wanted = F.broadcast(wanted)
    rows = docs.select(row_hash().alias("rk"), F.col("text").cast("binary").alias("t")).join(wanted, "rk")
    return rows.select("rid", "t").mapInArrow(run, "rid bigint, n bigint, payload binary")


def linked(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, rk, n, component_id, first (the rk of the component's one row to keep); null without shingles."""
    prints = keep(fingerprints(docs), "prints")
    classes = (prints.filter("n > 0").groupBy("digest")
               .agg(F.min("rk").alias("rk"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk")).alias("least"), F.first("n").alias("n"), F.first("regs").alias("regs")))
    classes = keep(classes.withColumn("rid", F.monotonically_increasing_id()), "classes")

    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    bands = classes.select("rid", "regs", band.alias("band")).select(
        F.xxhash64("band", F.substring("regs", F.col("band") * (2 * ROWS) + 1, F.lit(2 * ROWS))).alias("grp"), "rid")
    shared = bands.groupBy("grp").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    inside = keep(bands.join(shared, "grp"), "band-groups")
    # most small groups are the same few classes in many bands: one comparison does for all
    lists = (inside.filter(F.col("size") <= 64).groupBy("grp").agg(F.sort_array(F.collect_list("rid")).alias("rids"))
             .select("rids").distinct())
    lists = lists.select(F.xxhash64("rids").alias("grp"), F.explode("rids").alias("rid"), F.size("rids").cast("bigint").alias("size"))
    groups = keep(lists.union(inside.filter(F.col("size") > 64).select("grp", "rid", "size")), "groups")
    regs = classes.select("rid", "n", F.col("regs").alias("payload"))
    clusters = keep(connected(groups, regs, _maybe, "maybe"), "clusters")
    sizes = clusters.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    members = keep(clusters.join(sizes, "comp").select(F.col("comp").alias("grp"), F.col("node").alias("rid"), "size"), "members")
    wanted = classes.join(clusters, F.col("rid") == F.col("node")).select("rk", "rid")
    sets = keep(full_sets(docs, wanted), "sets")
    parts = connected(members, sets, _verified, "links", apart=True)
    joined = classes.select("rid", "digest", "least").join(parts, F.col("rid") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "rid"))
    ids = joined.join(joined.groupBy("comp").agg(F.min("least").alias("first")), "comp").select("digest", "first")
    return (prints.select("doc_id", "rk", "n", "digest").join(ids, "digest", "left")
            .select("doc_id", "rk", "n", F.col("first.doc_id").alias("component_id"), F.col("first.rk").alias("first")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return linked(docs).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                               F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all their columns, with one row of each component: the smallest id (null last), and of rows
    that share id and text one. Rows without shingles all stay."""
    rows = keep(linked(docs).filter("n > 0").select("rk", "first"), "linked")
    left = without(docs, rows.filter("rk <> first").select("rk"))
    again = keep(rows.filter("rk = first").groupBy("rk").count().filter("count > 1").select("rk"), "repeated")
    if again.isEmpty():
        return left
    marked = left.withColumn("__rk", row_hash()).join(again.select(F.col("rk").alias("__rk")), "__rk", "left_semi")
    return without(left, again).unionByName(marked.dropDuplicates(["__rk"]).drop("__rk"))


@query("op4_minhash_dedup")
def op4_minhash_dedup(spark, folder):
    return near_duplicates(table(spark, folder, "documents"))
