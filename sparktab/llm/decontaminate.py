"""Benchmark decontamination with a positional inverted index.

`build_index` stores postings (term, row, pos) of the training documents for the terms that can matter, sorted by
term inside each file. `phrase_matches` looks phrases up from their rarest term: its postings, shifted by the term's
place in the phrase, are candidate starts; the shifted postings of the second rarest term are intersected with them,
and what is left is confirmed on all terms of the phrase. `proximity_matches` finds all terms of a phrase, in any
order, inside a span.

All of it is DataFrame operations. Postings are dealt by row, so neither a frequent word nor a passage that many
documents share meets one task; only the vocabulary and the phrase terms are broadcast, below a counted size.

Defined results: null text has no words; an item without words matches nothing; an item of fewer words than the
window is one window as a whole; equal benchmark rows count once; repeated documents get equal results, one row
each; an empty benchmark leaves every document clean. Other columns are ignored by `contamination`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparktab.llm.common import BROADCAST_ROWS, keep, lookup, query, row_hash, table, without

WINDOW = 13
SHARE = 20                       # contaminated if SHARE x hit words >= words
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END = "\x00"                     # never a term: its posting marks the end of a document


def terms_of(text: Column) -> Column:
    """Words of a text: A-Z in lower case, cut at ASCII characters other than letters and digits."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAKS, -1), "")


@dataclass(frozen=True)
class Index:
    """vocabulary: (term, id); postings: (term id, row, pos, doc_id, rk), the last two only in the end posting (id 0)."""
    vocabulary: DataFrame
    postings: DataFrame

    def documents(self) -> DataFrame:
        """row, doc_id, rk, n_words of every document."""
        return self.postings.filter("term = 0").select("row", "doc_id", "rk", F.col("pos").cast("bigint").alias("n_words"))


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a table if its counted rows are within the limit; else leave the join to a shuffle."""
    return F.broadcast(df) if df.count() <= limit else df


def build_index(docs: DataFrame, terms: DataFrame) -> Index:
    """Store the postings of `docs` for the distinct words in `terms` (term)."""
    ids = keep(terms.select("term").distinct().withColumn("id", (F.monotonically_increasing_id() + 1)), "vocabulary")
    ids = ids.unionByName(terms.sparkSession.range(1).select(F.lit(END).alias("term"), F.lit(0).cast("bigint").alias("id")))
    words = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", row_hash().alias("rk"), "text")  # numbered before the words are dealt out
    words = words.select("row", "doc_id", "rk", F.posexplode(F.array_append(terms_of(F.col("text")), F.lit(END))).alias("pos", "term"))
    postings = (lookup(words, ids, "term", how="inner")
                .select(F.col("id").alias("term"), "row", "pos", *[F.when(F.col("id") == 0, F.col(x)).alias(x) for x in ("doc_id", "rk")])
                .sortWithinPartitions("term", "row", "pos"))
    return Index(ids, keep(postings, "postings"))


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, words: every run of `window` words of an item, or all its words if it has fewer."""
    w = items.select("item_id", terms_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    start = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return w.withColumn("s", F.explode(start)).select("item_id", F.slice("w", F.col("s"), F.lit(window)).alias("words")).distinct()


def phrase_terms(index: Index, phrases: DataFrame) -> DataFrame:
    """phrase, n, off, term (id), nth (1: rarest in the index); phrases with a word the index lacks are left out."""
    freq = index.postings.filter("term > 0").groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
    known = index.vocabulary.join(small(freq.withColumnRenamed("term", "id")), "id")
    rows = phrases.select("phrase", F.size("words").alias("n"), F.posexplode("words").alias("off", "term"))
    rows = lookup(rows, known, "term", how="inner").select("phrase", "n", "off", F.col("id").alias("term"), "freq")
    per = W.partitionBy("phrase")
    return (rows.withColumn("found", F.count(F.lit(1)).over(per))
            .withColumn("nth", F.row_number().over(per.orderBy("freq", "term", "off")))
            .filter("found = n").drop("found", "freq"))


def phrase_matches(index: Index, phrases: DataFrame) -> DataFrame:
    """Exact occurrences (row, phrase, start, n) of phrases (phrase, words)."""
    need = keep(phrase_terms(index, phrases), "phrase-terms")

    def shifted(nth: int) -> DataFrame:  # candidate starts by one term of each phrase
        of = need.filter(F.col("nth") == nth).select("term", "phrase", "n", "off")
        found = index.postings.join(small(of), "term")
        return found.select("row", "phrase", (F.col("pos") - F.col("off")).alias("start"), "n").filter("start >= 0")

    first = shifted(1)
    both = first.join(shifted(2).drop("n"), ["row", "phrase", "start"])
    left = keep(both.unionByName(first.filter("n = 1")), "candidates")
    rows = small(left.select("row").distinct())
    want = left.join(small(need.select("phrase", "off", "term")), "phrase").withColumn("pos", F.col("start") + F.col("off"))
    there = index.postings.join(rows, "row", "left_semi").select("row", "pos", "term")
    return (want.join(there, ["row", "pos", "term"]).groupBy("row", "phrase", "start", "n").count()
            .filter("count = n").drop("count"))


def proximity_matches(index: Index, phrases: DataFrame, span: int) -> DataFrame:
    """(row, phrase, start): spans of `span` words, from a term of the phrase on, that hold all its distinct terms in any order."""
    need = phrase_terms(index, phrases)
    need = need.groupBy("phrase", "term").agg(F.min("nth").alias("nth"))
    per = W.partitionBy("phrase")
    need = keep(need.withColumn("nth", F.row_number().over(per.orderBy("nth"))).withColumn("n", F.count(F.lit(1)).over(per)), "span-terms")
    anchor = index.postings.join(small(need.filter("nth = 1").select("term", "phrase")), "term").select("row", "phrase", F.col("pos").alias("at"))
    near = index.postings.join(small(need.select("term", "phrase", "n")), "term").select("row", "phrase", "term", "pos", "n")
    near = near.join(anchor, ["row", "phrase"]).filter(F.abs(F.col("pos") - F.col("at")) < span)
    start = F.sequence(F.greatest("pos", "at") - span + 1, F.least("pos", "at"))
    return (near.withColumn("start", F.explode(start)).groupBy("row", "phrase", "start")
            .agg(F.count_distinct("term").alias("found"), F.first("n").alias("n"), F.max((F.col("pos") == F.col("start"))).alias("on"))
            .filter("`on` AND found = n").select("row", "phrase", "start"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """Per document: doc_id, rk, n_words, n_hit, n_items, items_sha256, contaminated."""
    per_item = keep(windows_of(items, window), "windows")
    phrases = keep(per_item.select("words").distinct().withColumn("phrase", F.monotonically_increasing_id()), "phrases")
    owners = per_item.join(phrases, "words").select("phrase", F.col("item_id").cast("string").alias("item")).distinct()
    index = build_index(docs, phrases.select(F.explode("words").alias("term")))
    hits = keep(phrase_matches(index, phrases), "hits")
    before = W.partitionBy("row").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    spans = hits.select("row", "start", (F.col("start") + F.col("n")).alias("end")).distinct()
    done = F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0)))
    cover = (spans.withColumn("new", F.greatest(F.col("end") - done, F.lit(0))).groupBy("row")
             .agg(F.sum("new").cast("bigint").alias("n_hit")))
    named = (hits.select("row", "phrase").distinct().join(small(owners), "phrase").groupBy("row")
             .agg(F.sort_array(F.collect_set("item")).alias("items")))
    found = cover.join(named, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    of = F.coalesce("items", F.array().cast("array<string>"))
    return (index.documents().join(found, "row", "left")
            .select("doc_id", "rk", "n_words", n_hit.alias("n_hit"), F.size(of).cast("bigint").alias("n_items"),
                    F.sha2(F.array_join(of, ","), 256).alias("items_sha256"),
                    ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated")))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The rows of `docs`, all their columns, that are not contaminated."""
    return without(docs, keep(contamination(docs, items, window, share).filter("contaminated").select("rk"), "contaminated"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, list_slice(w, s, s + least(13, len(w)) - 1) AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM b WHERE len(w) > 0)),
g AS (
  SELECT r, s, k, list_slice(w, s, s + k - 1) AS g
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM win))),
hit AS (SELECT g.* FROM g SEMI JOIN win USING (k, g)),
cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS p FROM hit) GROUP BY r),
named AS (
  SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hit JOIN win USING (k, g) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN named USING (r)
"""


@query("op5_decontamination", SQL)
def op5_decontamination(spark, folder):
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("rk")
