"""Mixing sources to target weights.

Words are summed per source, every source gets a target, its repetition rate is target / size, and each
document is emitted floor(rate) times plus one more copy with probability equal to the fraction. The draw is
a hash of the seed and the row's key, so reruns, retries and other partitionings give the same mix.

Defined results: a null text has size 0; a null source is a source of its own, the last; a document without an
id is drawn by a digest of its text; equal rows (same id) get equally many copies; an empty table gives an
empty mix; a source without words has target 0 and its documents are not taken; other columns are carried
along untouched by `emit` and ignored by `plan`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktab.functions.order import with_position
from sparktab.llm.common import keep, lookup, n_words, null_key, query, row_key, table

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix-1"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Target words per source from (source, size): the total shared by weight, never above cap x source.

    Sources take the weights in turn, in code point order, null last. What a source at its cap can't take is
    shared anew among the others by weight until none is above; each round is one aggregate over the sources.
    Returns (k, source_size, target), k = null_key(source).
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("source").isNull())
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    per = keep(with_position(per, ["last", "source"]).select(null_key(F.col("source")).alias("k"), "source_size", w.alias("w")),
               "mix-sources")
    level, capped = None, F.lit(False)
    while True:
        got = per.agg(F.sum("source_size").alias("total"),
                      F.sum(F.when(capped, F.col("source_size"))).alias("full"),
                      F.sum(F.when(~capped, F.col("w"))).alias("open"),
                      F.count(F.when(capped, 1)).alias("n")).first()
        if not got["open"]:
            break
        if level is not None and got["n"] == before:
            break
        before = got["n"]
        level = ((got["total"] or 0) - cap * (got["full"] or 0)) / got["open"]
        capped = F.col("source_size") * cap < F.lit(float(level)) * F.col("w")
    share = F.lit(float(level or 0)) * F.col("w")
    return per.select("k", "source_size", F.when(capped, (F.col("source_size") * cap).cast("double")).otherwise(share).alias("target"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken (= size x copies)."""
    unit = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), row_key(F.col("doc_id"), F.col("text")))), 1, 13), 16, 10)
    sizes = keep(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"),
                             (unit.cast("bigint") / F.lit(float(1 << 52))).alias("u")), "mix-sizes")
    goal = targets(sizes.select("source", "size"), weights, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = (F.floor(rate) + (F.col("u") < rate - F.floor(rate)).cast("bigint")).cast("bigint")
    return (lookup(sizes.withColumn("k", null_key(F.col("source"))), goal, "k")
            .select("doc_id", "size", "source_size", "target", copies.alias("copies"),
                    (F.col("size") * copies).alias("taken")))


def emit(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mix itself: the rows of `docs`, each as often as the plan takes it; all columns are kept."""
    sizes = docs.select("source", n_words(F.col("text")).alias("size"))
    goal = targets(keep(sizes.groupBy("source").agg(F.sum("size").alias("size")), "mix-sizes"), weights, cap)
    unit = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), row_key(F.col("doc_id"), F.col("text")))), 1, 13), 16, 10)
    rates = goal.select(F.col("k").alias("__k"),
                        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("__rate"))
    rows = lookup(docs.withColumn("__k", null_key(F.col("source"))), rates, "__k")
    u = unit.cast("bigint") / F.lit(float(1 << 52))
    copies = (F.floor("__rate") + (u < F.col("__rate") - F.floor("__rate")).cast("bigint")).cast("int")
    return (rows.withColumn("__copies", copies).filter("__copies > 0")
            .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
            .select(*[F.col(f"`{x}`") for x in docs.columns]))


SQL = r"""
WITH s AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))), 1, 13))::BIGINT
           / 4503599627370496.0::DOUBLE AS u
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w, sum(source_size) OVER () AS total FROM per),
ordered AS (
  SELECT *, sum(w) OVER up AS w_up, sum(source_size) OVER up AS s_up, sum(w) OVER () AS w_all
  FROM weighed
  WINDOW up AS (ORDER BY 3 * source_size::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (
  SELECT *, (total - 3 * coalesce(s_up, 0))::DOUBLE / (w_all - coalesce(w_up, 0))::DOUBLE AS level FROM ordered),
found AS (
  SELECT min_by(level, 3 * source_size::DOUBLE / w) FILTER (WHERE 3 * source_size >= level * w) AS level FROM levels),
goal AS (
  SELECT source, source_size,
         CASE WHEN 3 * source_size < found.level * w THEN (3 * source_size)::DOUBLE ELSE found.level * w END AS target
  FROM weighed, found)
SELECT s.doc_id, s.size, g.source_size, g.target,
       (s.size * CASE WHEN g.source_size = 0 THEN 0
                      ELSE floor(g.target / g.source_size) + (u < g.target / g.source_size - floor(g.target / g.source_size))::INT
                 END)::BIGINT AS taken
FROM s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
"""


@query("op10_mixing", SQL)
def op10_mixing(spark, folder):
    return plan(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")
