"""Text retrieval: chunks, hashed vectors, nearest chunks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktab.functions.columns import c, spread
from sparktab.operators.neighbors import BLOCK, FEW_BYTES, FEW_QUERIES, _cut

CHUNK, OVERLAP = 500, 50
PAIRS = 2_000_000  # products worked on at once


def chunk_documents(df: DataFrame, key: str, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Character windows of `size` that overlap by `overlap`, over the whole text."""
    n, step = F.length(c(text)), size - overlap
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(step))
    return (df.select(c(key), c(text).alias("_t"), F.posexplode(starts).alias("chunk", "_s"))
            .select(c(key), "chunk", F.substring(F.col("_t"), F.col("_s") + 1, F.lit(size)).alias("chunk_text")))


def _merge(pieces: list[str], sep: str, size: int, overlap: int) -> list[str]:
    """Join neighbouring pieces up to `size`, carrying a tail of at most `overlap` characters."""
    out, held, total = [], [], 0
    for p in pieces:
        gap = len(sep) if held else 0
        if held and total + gap + len(p) > size:
            out.append(sep.join(held))
            while held and (total > overlap or total + len(sep) + len(p) > size):
                total -= len(held[0]) + (len(sep) if len(held) > 1 else 0)
                held = held[1:]
        total += len(p) + (len(sep) if held else 0)
        held = [*held, p]
    if held:
        out.append(sep.join(held))
    return [x for x in (y.strip() for y in out) if x]


def chunk_by_separator(df: DataFrame, key: str, text: str, separator: str = "\n\n", size: int = CHUNK,
                       overlap: int = OVERLAP) -> DataFrame:
    """Split at the separator and merge pieces up to `size`; a longer piece stays whole."""

    @F.pandas_udf("array<string>")
    def chunks(s: pd.Series) -> pd.Series:
        return s.map(lambda t: _merge([p for p in t.split(separator) if p], separator, size, overlap))

    return df.filter(c(text).isNotNull()).select(c(key), F.posexplode(chunks(c(text))).alias("chunk", "chunk_text"))


def fit_embedder(chunks: DataFrame, text: str = "chunk_text", size: int = 1 << 18):
    """Hashed word counts, weighted by inverse document frequency, scaled to length one."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="_w", outputCol="_tf", numFeatures=size),
        IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="_n")]).fit(spread(chunks))


def embed_text(df: DataFrame, embedder, name: str = "embedding") -> DataFrame:
    """Sparse vectors: struct (type, size, indices, values)."""
    return embedder.transform(df).withColumn(name, F.unwrap_udt("_n")).drop("_w", "_tf", "_idf", "_n")


def _postings(asks: pd.DataFrame) -> tuple:
    """Queries by bucket: ids, squared lengths, buckets with where each begins and its count, query and weight of each posting."""
    own = np.repeat(np.arange(len(asks)), asks["terms"].map(len).to_numpy(dtype="int64"))
    term, w = (np.concatenate([np.empty(0), *asks[x]]) for x in ("terms", "weights"))
    order = np.argsort(term, kind="stable")
    buckets, start, count = np.unique(term[order], return_index=True, return_counts=True)
    return asks["query"].to_numpy(), np.bincount(own, w * w, len(asks)), buckets, start, count, own[order], w[order]


def _closest(index: tuple, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of each query by sparse dot products, ties by id."""
    ids, qn, buckets, start, count, owner, weight = index
    rows = rows.sort_values("id", kind="stable")
    n, names = len(ids), rows["id"].to_numpy()
    at = np.repeat(np.arange(len(rows)), rows["terms"].map(len).to_numpy(dtype="int64"))
    term, w = (np.concatenate([np.empty(0), *rows[x]]) for x in ("terms", "weights"))
    xn = np.bincount(at, w * w, len(rows))
    pos = np.searchsorted(buckets, term)
    hit = np.append(buckets, -1.0)[pos] == term
    pos, at, w = pos[hit], at[hit], w[hit]
    part = (np.cumsum(np.bincount(at, count[pos], len(rows)) + n) // PAIRS).astype("int64")
    bounds, found = [*np.unique(part, return_index=True)[1], len(rows)], []
    for lo, hi in zip(bounds, bounds[1:]):
        a, b = np.searchsorted(at, [lo, hi])
        many = count[pos[a:b]]
        p = np.arange(many.sum()) + np.repeat(start[pos[a:b]] - np.cumsum(many) + many, many)
        dot = np.bincount(owner[p] * (hi - lo) + np.repeat(at[a:b] - lo, many), weight[p] * np.repeat(w[a:b], many), n * (hi - lo))
        d2 = np.maximum(qn[:, None] + xn[None, lo:hi] - 2 * dot.reshape(n, hi - lo), 0)
        kk = min(k, hi - lo)
        qi, xi = np.nonzero(d2 <= np.partition(d2, kk - 1, axis=1)[:, kk - 1:kk])
        if len(qi) > 8 * n * kk:  # many ties: rows stand by id, so the first are kept
            xi = np.argsort(d2, axis=1, kind="stable")[:, :kk].ravel()
            qi = np.repeat(np.arange(n), kk)
        found.append(pd.DataFrame({"query": ids[qi], "id": names[lo + xi], "d2": d2[qi, xi]}))
    return _cut(pd.concat(found), k)


def retrieve(queries: DataFrame, chunks: DataFrame, embedder, query_id: str, query_text: str, chunk_id: str,
             k: int = 3, few: int = FEW_QUERIES, block: int = BLOCK) -> DataFrame:
    """(query, id, d2, rank): the k nearest chunks of every query text, ties by id.

    Few queries (in rows and bytes) are broadcast and each task keeps the best k; more are dealt in blocks that meet each block of chunks.
    """
    q = embed_text(queries.select(c(query_id), c(query_text).alias("chunk_text")), embedder)
    x = embed_text(spread(chunks), embedder)
    sparse = [F.col("embedding.indices").alias("terms"), F.col("embedding.values").alias("weights")]
    q, x = q.select(c(query_id).alias("query"), *sparse), x.select(c(chunk_id).alias("id"), *sparse)
    kind = T.StructType([q.schema["query"], x.schema["id"], T.StructField("d2", T.DoubleType())])
    none = lambda: pd.DataFrame({f.name: [] for f in kind})
    total, terms = q.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    parts = max(math.ceil(total / few), math.ceil(terms * 12 / FEW_BYTES), 1)
    if parts == 1:
        shared = q.sparkSession.sparkContext.broadcast(_postings(q.toPandas()))  # size checked above

        def run(batches):
            best = None
            for rows in batches:
                if len(rows) and len(shared.value[0]):
                    now = _closest(shared.value, rows, k)
                    best = now if best is None else _cut(pd.concat([best, now]), k)
            if best is not None:
                yield best

        found = x.mapInPandas(run, kind)
    else:
        blocks = max(math.ceil(x.count() / block), 1)

        def dealt(df, key, own, n, other, m):
            return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(m - 1).cast("bigint"))))

        def best(asks: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            return _closest(_postings(asks), rows, k) if len(asks) and len(rows) else none()

        found = (dealt(q, "query", "_a", parts, "_b", blocks).groupBy("_a", "_b")
                 .cogroup(dealt(x, "id", "_b", blocks, "_a", parts).groupBy("_a", "_b")).applyInPandas(best, kind))
    w = W.partitionBy("query").orderBy("d2", "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
