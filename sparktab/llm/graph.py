"""Connected components, and links inside groups, as Spark jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktab.llm.common import keep

BLOCK = 256
TASK_EDGES = 250_000
SENT_ROWS = 1_000_000


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, comp) from a written table (a, b): comp is the smallest node reachable. Nodes without edges don't appear.

    First every task contracts up to about task_edges edges to stars by itself. If that took more than one task, the
    large-star and small-star steps alternate: every node passes its smallest neighbour on to its larger and then to its
    smaller neighbours. Each round is a written table. Minima are partial aggregates and the joins have one row per
    node on one side, so a node with very many neighbours can be split.
    """
    parts = -(-edges.count() // task_edges) or 1
    edges = keep(edges.coalesce(parts).mapInArrow(_contract, "a bigint, b bigint"), "contracted")
    if parts == 1:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    now, seen = keep(_down(edges), "edges"), None
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            child = now.select(F.col("a").alias("node"), F.col("b").alias("comp"))
            return child.union(child.select("comp", "comp").distinct())
        seen = mark
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").select(F.when(F.col("b") > F.col("a"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                                              F.struct("a", F.col("m").alias("b")))).alias("e"))
        now = keep(_down(small.select("e.a", "e.b")), "edges")


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars (node, smallest node) of the components of one task's edges, the smallest node itself included."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if a != b:
                a, b = find(root.setdefault(a, a)), find(root.setdefault(b, b))
                root[max(a, b)] = min(a, b)
    if root:
        yield pa.RecordBatch.from_arrays([pa.array(root, pa.int64()), pa.array([find(x) for x in root], pa.int64())], names=["a", "b"])


def _down(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def spanning(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that connect exactly what a symmetric matrix of links connects: each node with the first of its component."""
    left, pairs = np.ones(len(adjacent), dtype=bool), []
    for i in range(len(adjacent)):
        if not left[i]:
            continue
        inside = np.zeros(len(adjacent), dtype=bool)
        inside[i] = True
        fresh = inside.copy()
        while fresh.any():
            reach = adjacent[fresh].any(axis=0)
            fresh = reach & ~inside
            inside |= reach
        left &= ~inside
        pairs += [(i, int(j)) for j in np.flatnonzero(inside) if j != i]
    return pairs


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """(rid, n, payload) per run of equal g in batches sorted by g; a rid that repeats in a run comes once."""
    g, held = None, {}
    for batch in batches:
        keys, rids, sizes, data = (batch.column(i) for i in range(4))
        keys, rids, sizes = keys.to_numpy(zero_copy_only=False), rids.to_numpy(zero_copy_only=False), sizes.to_numpy(zero_copy_only=False)
        for i in range(len(keys)):
            if keys[i] != g:
                if len(held) > 1:
                    yield _run(held)
                g, held = keys[i], {}
            held.setdefault(int(rids[i]), (sizes[i], data[i].as_py()))
    if len(held) > 1:
        yield _run(held)


def _run(held: dict) -> tuple[np.ndarray, np.ndarray, list]:
    order = sorted(held)
    return np.array(order, dtype=np.int64), np.array([held[r][0] for r in order]), [held[r][1] for r in order]


def compare_groups(rows: DataFrame, link: Callable[[np.ndarray, list], np.ndarray]) -> DataFrame:
    """Edges (a, b) that connect what `link` (sizes, payloads -> symmetric matrix) connects in each group.

    rows: (g, rid, n, payload), at most two blocks of rows per g. Equal g of two groups would only compare more.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for rids, sizes, data in _runs(batches):
            for i, j in spanning(link(sizes, data)):
                a.append(rids[i])
                b.append(rids[j])
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.select("g", "rid", "n", "payload").repartition("g").sortWithinPartitions("g").mapInArrow(run, "a bigint, b bigint")


def _with_payload(rows: DataFrame, data: DataFrame) -> DataFrame:
    """Payloads go to their groups in one shuffle: while the counted (g, rid) rows are few, they are sent to the payloads."""
    return (F.broadcast(rows) if rows.count() <= SENT_ROWS else rows).join(data, "rid")


def connected(members: DataFrame, data: DataFrame, link, label: str, apart: bool = False,
              block: int = BLOCK) -> DataFrame:
    """(node, comp): the components of all links between members of one group; lone nodes don't appear.

    members: (grp, rid, size), a written table, with size the members of the group; data: (rid, n, payload); apart: no rid is in two groups. Groups of up to `block` members are compared as a whole. In a
    larger one every block meets the first block, and who is still not connected with the group's largest component
    then meets every block. So a dense group costs about its size, and no group is ever held by one task.
    """
    few = members.filter(F.col("size") <= block).select(F.xxhash64("grp").alias("g"), "rid")
    whole = keep(compare_groups(_with_payload(few, data), link), label)
    many = members.filter(F.col("size") > block)
    if many.isEmpty():
        return _joined(whole, None, apart)
    many = many.withColumn("nb", F.ceil(F.col("size") / (block * 0.8)))
    many = many.withColumn("blk", F.pmod(F.xxhash64("rid", F.lit(7)), F.col("nb")))
    dealt = many.select("grp", "rid", F.explode(F.when(F.col("blk") == 0, F.sequence(F.lit(0).cast("bigint"), F.col("nb") - 1))
                                                .otherwise(F.array("blk"))).alias("blk"))
    edges = keep(compare_groups(_with_payload(dealt.select(F.xxhash64("grp", "blk").alias("g"), "rid"), data), link), label + "-large")
    found = keep(_joined(whole, edges, apart), label + "-found")
    known = keep(many.join(found.withColumnRenamed("node", "rid"), "rid", "left").withColumn("comp", F.coalesce("comp", "rid")), label + "-known")
    parts = known.groupBy("grp", "comp").count()
    main = parts.groupBy("grp").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.count(F.lit(1)).alias("parts"),
                                    (F.sum("count") - F.max("count")).alias("out")).filter("parts > 1")
    main = keep(main, label + "-open")
    if main.isEmpty():
        return found
    known = known.join(main, "grp").withColumn("ob", F.ceil(F.col("out") / (block * 0.8)))
    i, j = F.sequence(F.lit(0).cast("bigint"), F.col("ob") - 1), F.sequence(F.lit(0).cast("bigint"), F.col("nb") - 1)
    own = F.pmod(F.xxhash64("rid", F.lit(11)), F.col("ob"))
    everyone = known.select("grp", "rid", F.explode(i).alias("i"), F.col("blk").alias("j"))
    stray = known.filter("comp <> main").select("grp", "rid", own.alias("i"), F.explode(j).alias("j"))
    rest = everyone.union(stray).select(F.xxhash64("grp", "i", "j").alias("g"), "rid")
    more = keep(compare_groups(_with_payload(rest, data), link), label + "-rest")
    if more.isEmpty():
        return found
    return _joined(whole, edges.union(more), apart)


def _joined(whole: DataFrame, edges: DataFrame | None, apart: bool) -> DataFrame:
    """Components of both edge tables. Where groups stand apart, a group compared as a whole is solved already."""
    if not apart:
        return components(whole if edges is None else whole.union(edges))
    stars = whole.select(F.col("b").alias("node"), F.col("a").alias("comp")).union(whole.select("a", "a").distinct())
    return stars if edges is None else stars.union(components(edges))
