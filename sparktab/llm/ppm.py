"""Language-model scoring by prediction by partial matching (PPM).

The model is a trie of byte contexts up to ORDER bytes. A context that has seen the next byte predicts it with
(2 count - 1) / 2n, where n is the context's total and q its number of distinct next bytes; otherwise it escapes with
q / 2n (method D) to the next shorter context, in which the bytes seen before are excluded. After the empty context
the bytes never seen share the rest evenly. The end of a text is a symbol of its own.

Pretrained: the counts of all (context, byte) pairs are summed over the training texts by Spark, and every task scores
whole texts against them. Because a longer context's bytes are among the shorter one's, exclusion only needs the
mass of those bytes in the shorter context, so escapes are table lookups. If the pairs outgrow PAIRS, the trie is cut
into slices by the last two context bytes and the texts are scored once per slice: memory is bounded, the sum is the same.

Adaptive: `adaptive_score` learns from the document itself while it is coded, from an empty trie.

Next to it stands a smoothed word model (base): log10((c + 0.1) / (N + 0.1 (V + 1))) summed over tokens, each text
ending in one end token. Counts of the most frequent words (at most HOT) travel with the tasks; the rest is joined.

Defined results: a null text is the empty text: one end token, and the model's probability of ending at once; a
document without an id is a training document; equal rows get equal scores; with no training texts every byte has
1 / 256 and N = 0; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktab.llm.common import keep, query, table
from sparktab.llm.shingles import word_hashes

ORDER = 5
PAIRS = 2_000_000
HOT = 1 << 19
FOLDS = 10
START, END = b"\xfe", b"\xff"   # never bytes of UTF-8 text
SYMBOLS = 256
SMOOTH = 0.1
_PIECE = 1 << 19


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _lower(text: bytes | None) -> bytes:
    return (text or b"").lower()  # of bytes: A-Z only


def _segments(texts: Iterator[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of (packed contexts with their next byte, index of the text): one entry per byte and one per end."""
    parts, owner, held = [], [], 0
    for i, text in enumerate(texts):
        data = START * order + text + END
        for at in range(order, len(data), _PIECE):  # a long text comes in pieces that overlap by a context
            parts.append(data[at - order:at + _PIECE])
            owner.append(i)
            held += len(parts[-1])
            if held >= _PIECE:
                yield _pack(parts, owner, order)
                parts, owner, held = [], [], 0
    if parts:
        yield _pack(parts, owner, order)


def _pack(parts: list[bytes], owner: list[int], order: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.uint64)
    sizes = np.array([len(p) for p in parts])
    keys = np.zeros(len(data) - order, dtype=np.uint64)
    for j in range(order + 1):
        keys = (keys << np.uint64(8)) | data[j:j + len(keys)]
    real = np.ones(len(data), dtype=bool)
    for start in np.cumsum(sizes) - sizes:
        real[start:start + order] = False
    real = real[order:]
    return keys[real], np.repeat(np.array(owner), sizes - order)


def _merge(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([c for _, c in found])).astype(np.int64)


def count_corpus(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Partial counts (kind, key, count) of the texts: kind 0 words, 1 byte runs of order + 1, 2 documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {0: [], 1: []}
        size = {0: 0, 1: 0}

        def out(kind: int) -> pa.RecordBatch:
            keys, counts = _merge(found[kind])
            found[kind], size[kind] = [], 0
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, dtype=np.int32)), pa.array(keys.view(np.int64)), pa.array(counts)],
                                              names=["kind", "key", "count"])

        def add(kind: int, keys: np.ndarray) -> None:
            keys, counts = np.unique(keys, return_counts=True)
            found[kind].append((keys, counts))
            size[kind] += len(keys)
            if size[kind] > 2_000_000 and len(found[kind]) > 1:
                found[kind] = [_merge(found[kind])]
                size[kind] = len(found[kind][0][0])

        docs_seen = 0
        for batch in batches:
            docs_seen += batch.num_rows
            texts = [_lower(t.as_py()) for t in batch.column(0)]
            for keys, _ in _segments(texts, order):
                add(1, keys)
            words, held = [], 0
            for text in texts:
                words.append(word_hashes(text))
                held += len(words[-1])
                if held > 500_000:
                    add(0, np.concatenate(words))
                    words, held = [], 0
            if held:
                add(0, np.concatenate(words))
            for kind in (0, 1):
                if size[kind] > 1_500_000:
                    yield out(kind)
        for kind in (0, 1):
            if found[kind]:
                yield out(kind)
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0], pa.int64()), pa.array([docs_seen], pa.int64())],
                                         names=["kind", "key", "count"])

    return docs.select(F.col("text").cast("binary").alias("t")).mapInArrow(run, "kind int, key bigint, count bigint")


def _small(counts: np.ndarray) -> np.ndarray:
    """Counts in four bytes where they fit: the tables travel to every task."""
    return counts.astype(np.int32) if not len(counts) or counts.max() < 1 << 30 else counts.astype(np.int64)


@dataclass
class Level:
    """Tables of one order: seen pairs, contexts with what their escapes are made of. Logs are taken when they are looked up."""
    pairs: np.ndarray      # context and byte, sorted
    count: np.ndarray      # of a pair
    owner: np.ndarray      # index of a pair's context
    contexts: np.ndarray   # sorted
    total: np.ndarray      # of a context's pairs
    kinds: np.ndarray      # distinct next bytes of a context
    rest: np.ndarray       # 2n' of the next shorter context without this one's bytes
    fresh: np.ndarray      # distinct next bytes there
    link: np.ndarray       # index of the next shorter context

    def log_count(self, at: np.ndarray) -> np.ndarray:
        return np.log(np.maximum(2 * self.count[at].astype(np.int64) - 1, 1))

    def plain(self, at: np.ndarray) -> np.ndarray:
        """Log chance of a pair whose context is the first one met."""
        return self.log_count(at) - np.log(2 * self.total[self.owner[at]].astype(np.int64))

    def escape(self, at: np.ndarray) -> np.ndarray:
        """Log of the escape chance when nothing is excluded."""
        return np.log(self.kinds[at].astype(np.int64)) - np.log(2 * self.total[at].astype(np.int64))

    def rests(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logs of 2n' and of the escape chance in the next shorter context without this one's bytes; 0 where no byte is left."""
        some = self.fresh[at] > 0
        rest = np.log(np.where(some, self.rest[at], 1).astype(np.int64))
        return rest, np.log(np.where(some, self.fresh[at], 1).astype(np.int64)) - rest


class Model:
    """PPM tables from the counts of runs of order + 1 bytes; with slices, only the runs of one slice."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int = ORDER, short: tuple[np.ndarray, np.ndarray] | None = None,
                 part: int = 0, parts: int = 1):
        """short: counts of the runs of two bytes over all slices (from the keys themselves unless given)."""
        self.order, self.part, self.parts = order, part, parts
        self.levels: list[Level] = []
        tables = []
        for k in range(order + 1):
            key, n = (keys, counts) if k >= 2 or short is None else short
            mask = np.uint64((1 << (8 * (k + 1))) - 1)
            tables.append(_merge([(key & mask, n)]) if len(key) else (np.empty(0, np.uint64), np.empty(0, np.int64)))
        for k, (pairs, n) in enumerate(tables):
            contexts, at, q = np.unique(pairs >> np.uint64(8), return_inverse=True, return_counts=True)
            total = np.bincount(at, weights=n, minlength=len(contexts))
            rest, fresh, mine = np.zeros(len(contexts)), np.zeros(len(contexts), dtype=np.int64), np.zeros(len(contexts), dtype=np.int64)
            if k and len(contexts):
                below, low_n = tables[k - 1]
                low = self.levels[k - 1]
                mass = np.bincount(at, weights=low_n[np.searchsorted(below, pairs & np.uint64((1 << (8 * k)) - 1))], minlength=len(contexts))
                mine = np.searchsorted(low.contexts, contexts & np.uint64((1 << (8 * (k - 1))) - 1))
                rest, fresh = 2 * (self._n[mine] - mass), self._q[mine] - q
            self.levels.append(Level(pairs, _small(n), at.astype(np.int32), contexts, _small(total), q.astype(np.int16), _small(rest), fresh.astype(np.int16),
                                     mine.astype(np.int32)))
            self._n, self._q = total, q
            if k == 0:
                self.unseen = -math.log(SYMBOLS - q[0]) if len(q) and q[0] < SYMBOLS else -math.log(SYMBOLS)
        del self._n, self._q  # of the last order: only needed to build

    def log_chances(self, keys: np.ndarray) -> np.ndarray:
        """Natural log of the chance of each byte after its context; 0 for contexts of other slices."""
        out = np.zeros(len(keys))
        left = np.arange(len(keys)) if self.parts == 1 else np.flatnonzero(slice_of(keys, self.parts) == self.part)
        sum_, rest, escape = np.zeros(len(left)), np.zeros(len(left)), np.zeros(len(left))
        ctx = np.full(len(left), -1)  # of the order above, once one is known
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            key = keys[left] & np.uint64((1 << (8 * (k + 1))) - 1)
            at, hit = _find(level.pairs, key)
            after = ctx >= 0
            here = np.flatnonzero(hit)
            if len(here):
                out[left[here]] = np.where(after[here], sum_[here] + level.log_count(at[here]) - rest[here], level.plain(at[here]))
            miss = np.flatnonzero(~hit)
            if not len(miss):
                return out
            left, sum_, rest, escape, after, ctx, key = left[miss], sum_[miss], rest[miss], escape[miss], after[miss], ctx[miss], key[miss]
            if k < self.order:
                ctx = np.where(after, self.levels[k + 1].link[np.maximum(ctx, 0)], -1) if len(self.levels[k + 1].link) else ctx
            fresh = np.flatnonzero(~after)
            found, known = _find(level.contexts, key[fresh] >> np.uint64(8))
            ctx[fresh[known]] = found[known]
            sum_[after] += escape[after]
            new = fresh[known]
            sum_[new] += level.escape(ctx[new])
            seen = np.flatnonzero(ctx >= 0)
            rest[seen], escape[seen] = level.rests(ctx[seen])
        out[left] = sum_ + self.unseen
        return out


def _find(table_: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table_):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(table_, keys), len(table_) - 1)
    return at, table_[at] == keys


def slice_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Slice of a run by the two bytes before its last."""
    two = (keys >> np.uint64(8)) & np.uint64(0xFFFF)
    return ((two * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)) % np.uint64(parts)


def load_models(pairs: DataFrame, order: int = ORDER, limit: int = PAIRS) -> list:
    """Functions that build the model of each slice on the driver, at most about `limit` pairs at a time."""
    parts = -(-pairs.count() // limit) or 1
    two = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF))
    part = (two * F.lit(0x9E3779B1)).bitwiseAND(F.lit(0xFFFFFFFF)) % parts

    def fetch(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        rows = df.select("key", "count").toArrow()
        key, count = rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy()
        order_ = np.argsort(key)
        return key[order_], count[order_]

    short = None
    if parts > 1:
        short = fetch(pairs.groupBy(F.col("key").bitwiseAND(F.lit(0xFFFF)).alias("key")).agg(F.sum("count").alias("count")))

    def build(g: int) -> Model:
        return Model(*fetch(pairs if parts == 1 else pairs.filter(part == g)), order=order, short=short, part=g, parts=parts)

    return [lambda g=g: build(g) for g in range(parts)]


def text_scores(model: Model, texts: list[bytes]) -> np.ndarray:
    """log10 probability of each text, its end included."""
    out = np.zeros(len(texts))
    for keys, owner in _segments(texts, model.order):
        runs, at = np.unique(keys, return_inverse=True)  # each distinct run is looked up once, in the tables' order
        out += np.bincount(owner, weights=model.log_chances(runs)[at], minlength=len(texts))
    return out / math.log(10)


def hot_words(words: DataFrame, most: int = HOT) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words, at most `most` (whole count classes): (sorted hashes, counts)."""
    level = F.floor(F.log2("count") * 4)
    classes = sorted(((r[0], r[1]) for r in words.groupBy(level).count().collect()), reverse=True)  # some hundred rows
    least, held = None, 0
    for k, n in classes:
        if held + n > most:
            break
        least, held = k, held + n
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    rows = words.filter(level >= least).toArrow()
    key, count = rows.column("key").to_numpy().view(np.uint64), rows.column("count").to_numpy()
    at = np.argsort(key)
    return key[at], count[at]


def score(docs: DataFrame, order: int = ORDER, folds: int = FOLDS, pairs_limit: int = PAIRS, hot_limit: int = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    partial = keep(count_corpus(docs.filter(~held_out(F.col("doc_id"), folds)), order), "counts")

    def total(of: int) -> DataFrame:
        return partial.filter(F.col("kind") == of).groupBy("key").agg(F.sum("count").alias("count"))

    words, pairs = keep(total(0), "words"), keep(total(1), "pairs")
    trained = partial.filter("kind = 2").agg(F.sum("count")).first()[0] or 0
    n_words, distinct = words.agg(F.sum("count"), F.count(F.lit(1))).first()
    n_all, v_all = (n_words or 0) + trained, distinct + (trained > 0)
    hot, hot_count = hot_words(words, hot_limit)
    log_hot = np.log10(hot_count + SMOOTH)
    log_end, log_den = math.log10(trained + SMOOTH), math.log10(n_all + SMOOTH * (v_all + 1))
    builders = load_models(pairs, order, pairs_limit)
    spark = docs.sparkSession

    def scorer(shared, with_words: bool):

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, hot, log_hot = shared.value
            for whole in batches:
                for at in range(0, whole.num_rows, 1000):
                    batch = whole.slice(at, 1000)
                    texts = [_lower(t.as_py()) for t in batch.column(2)]
                    points = pa.array(text_scores(model, texts))
                    if not with_words:
                        yield pa.RecordBatch.from_arrays([batch.column(1), points], names=["rk", "score"])
                        continue
                    tokens, known, base, rest = [], [], [], []
                    for text in texts:
                        h = word_hashes(text)
                        i, hit = _find(hot, h)
                        tokens.append(len(h) + 1)
                        known.append(int(hit.sum()) + (trained > 0))
                        base.append(float(log_hot[i[hit]].sum()) + log_end - (len(h) + 1) * log_den)
                        rest.append(h[~hit].view(np.int64))
                    sizes = np.concatenate([[0], np.cumsum([len(r) for r in rest])]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(rest)))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), batch.column(1), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base), points, lists],
                        names=["doc_id", "rk", "n_tokens", "known", "base", "score", "rest"])
        return run

    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rk"), F.col("text").cast("binary").alias("t"))
    shared = spark.sparkContext.broadcast((builders[0](), hot, log_hot))
    first = rows.mapInArrow(scorer(shared, True),
                            f"doc_id {kind}, rk bigint, n_tokens bigint, known bigint, base double, score double, rest array<bigint>")
    scored = keep(first.withColumn("row", F.monotonically_increasing_id()), "scored")
    shared.destroy()  # what it gave is written: the next slice takes its place in the executors' memory
    for build in builders[1:]:  # one pass more for each further slice of the trie
        shared = spark.sparkContext.broadcast((build(), None, None))
        part = keep(rows.mapInArrow(scorer(shared, False), "rk bigint, score double"), "slice")
        shared.destroy()
        part = part.groupBy("rk").agg(F.max("score").alias("more"))
        scored = scored.join(part, "rk").withColumn("score", F.col("score") + F.col("more")).drop("more")
    rare = scored.select("row", F.explode("rest").alias("key")).groupBy("row", "key").agg(F.count(F.lit(1)).alias("times"))
    c = F.coalesce("count", F.lit(0))
    rare = (rare.join(words, "key", "left").groupBy("row")
            .agg(F.sum(F.col("times") * F.log10(c + SMOOTH)).alias("rare"), F.sum(F.when(c > 0, F.col("times"))).alias("rare_known")))
    return scored.join(rare, "row", "left").select(
        "doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("bigint").alias("n_known"), F.lit(int(n_all)).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare", F.lit(0.0))).alias("base_score"), "score")


def adaptive_score(text: bytes, order: int = ORDER) -> float:
    """log10 probability of a text under a trie that starts empty and learns each byte after coding it."""
    counts: dict[bytes, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    data, out = START * order + text + END, 0.0
    for i in range(order, len(data)):
        s, excluded, done = data[i], set(), False
        for k in range(order, -1, -1):
            seen = counts.get(data[i - k:i])
            if seen is None:
                continue
            fresh = {x: n for x, n in seen.items() if x not in excluded}
            if not fresh:
                continue
            n, q = sum(fresh.values()), len(fresh)
            if s in fresh:
                out += math.log10((2 * fresh[s] - 1) / (2 * n))
                done = True
                break
            out += math.log10(q / (2 * n))
            excluded |= set(fresh)
        if not done:
            out -= math.log10(SYMBOLS - len(excluded))
        for k in range(order + 1):
            counts[data[i - k:i]][s] += 1
    return out


def score_adaptive(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, score: every document coded by its own adaptive trie."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = [adaptive_score(_lower(t.as_py()), order) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(points, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("t")).mapInArrow(run, f"doc_id {kind}, score double")


@query("op9_lm_scoring")
def op9_lm_scoring(spark, folder):
    return score(table(spark, folder, "documents"))
