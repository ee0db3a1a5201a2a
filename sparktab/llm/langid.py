"""Language identification with error-correcting output codes.

Every language has a codeword; bit b splits the languages in two, and a binary classifier over hashed byte n-grams
predicts it: the sum of log ratios of the n-gram's frequency on either side, each language weighing the same. Decoding
takes the language whose codeword has the smallest weighted logistic loss over the bits, where a bit weighs as much as
it is right on training texts of that language. A second codeword almost as near marks the result as ambiguous.

The n-gram counts cover all training texts (summed by Spark; languages x BUCKETS numbers reach the driver). Only the bits'
reliabilities are measured on a bounded sample, CALIBRATION rows.

Defined results: null text or no letter: `und`, score 0, not ambiguous; without training rows all are `und`; equal
texts get equal results; rows without language don't train; a document without id is held out from training; an empty table
gives an empty result. Only the text enters a prediction. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktab.llm.common import query, table
from sparktab.llm.shingles import mix

SIZES = (2, 3, 4)              # bytes of an n-gram
BUCKETS = 1 << 16              # per n-gram size
CALIBRATION = 2000
FOLDS = 5
TEMPER = 0.25                  # overlapping n-grams repeat each other's evidence
AMBIGUOUS = 0.1                # least lead of the nearest codeword, as a share of the two scores
UNKNOWN = "und"
_GAP = b"\n" * max(SIZES)
_PIECE = 1 << 20

_FOLD = np.full(256, 32, dtype=np.uint64)  # letters in lower case, all other ASCII as blanks
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def codewords(n: int) -> np.ndarray:
    """+1 / -1 matrix (languages, bits), all rows apart: every split of up to 6 languages, else 12 hashed bits per doubling."""
    if n <= 6:
        splits = np.arange(1, max(2, 1 << (n - 1)))
        return np.array([[1 if i == n - 1 or not (s >> i) & 1 else -1 for s in splits] for i in range(n)])
    bits = 12 * int(np.ceil(np.log2(n)))
    hashed = mix(np.arange(n * bits * 4, dtype=np.uint64)).reshape(-1, n)
    rows = [(h >> np.uint64(40)).argsort() < n // 2 for h in hashed]
    return np.where(np.array(rows[:bits]).T, 1, -1)


def ngrams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces of (bucket indexes [bytes, sizes], owner): n-grams of each text, none across two texts."""
    parts, owner, held = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text), 1), _PIECE):
            parts += [text[max(0, at - max(SIZES) + 1):at + _PIECE], _GAP]
            owner.append((i, len(parts[-2]) + len(_GAP)))
            held += owner[-1][1]
            if held >= _PIECE:
                yield _index(parts, owner)
                parts, owner, held = [], [], 0
    if parts:
        yield _index(parts, owner)


def _index(parts: list[bytes], owner: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    data = _FOLD[np.frombuffer(b"".join(parts), dtype=np.uint8)]
    wide = np.concatenate([data, np.full(max(SIZES), 32, dtype=np.uint64)])
    out, key = [], np.zeros(len(data), dtype=np.uint64)
    for j in range(max(SIZES)):
        key = (key << np.uint64(8)) | wide[j:j + len(data)]
        if j + 1 in SIZES:
            h = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
            out.append(h.astype(np.int64) % BUCKETS + SIZES.index(j + 1) * BUCKETS)
    return np.stack(out, axis=1), np.repeat(np.array([i for i, _ in owner]), [n for _, n in owner])


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(lang, bucket, count) over all rows of (lang, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang in sorted(set(langs)):
                texts = [t.as_py() for t, own in zip(batch.column(1), langs) if own == lang]
                held = total.setdefault(lang, np.zeros(BUCKETS * len(SIZES), dtype=np.int64))
                for index, _ in ngrams(texts):
                    held += np.bincount(index.ravel(), minlength=len(held))
        for lang, held in total.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(held[at])], names=["lang", "bucket", "count"])

    return (docs.select("lang", F.col("text").cast("binary").alias("t")).mapInArrow(run, "lang string, bucket bigint, count bigint")
            .groupBy("lang", "bucket").agg(F.sum("count").alias("count")))


@dataclass
class Coder:
    """languages, codewords [languages, bits], weights [buckets, bits], trust [languages, bits]."""
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """Evidence for each bit of each text."""
        out = np.zeros((len(texts), self.code.shape[1]))
        for index, owner in ngrams(texts):
            start = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
            for column in index.T:
                out[owner[start]] += np.add.reduceat(self.weights[column], start, axis=0)
        return out * TEMPER

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its score (0 to 1), whether the second is almost as near."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None, :, :])
        loss = (loss * self.trust[None, :, :]).sum(axis=2)
        near = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share = near / near.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        ranked = np.sort(share, axis=1)
        lead = ranked[:, -1] - (ranked[:, -2] if share.shape[1] > 1 else 0)
        return best, np.clip(ranked[:, -1], 0, 1), lead < AMBIGUOUS


def fit(docs: DataFrame, calibration: int = CALIBRATION) -> Coder | None:
    """Coder from the rows of (text, lang) that have a language and a text; None without any."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = count_ngrams(rows).toArrow()  # languages x buckets
    if not counts.num_rows:
        return None
    langs = counts.column("lang").to_pylist()
    languages = sorted(set(langs))
    number = {x: i for i, x in enumerate(languages)}
    freq = np.zeros((len(languages), BUCKETS * len(SIZES)))
    freq[[number[x] for x in langs], counts.column("bucket").to_numpy()] = counts.column("count").to_numpy()
    freq = freq.reshape(len(languages), len(SIZES), BUCKETS) + 0.5
    freq = (freq / freq.sum(axis=2, keepdims=True)).reshape(len(languages), -1)
    code = codewords(len(languages))
    weights = np.stack([np.log(freq[c == 1].mean(axis=0)) - (np.log(freq[c == -1].mean(axis=0)) if (c == -1).any() else 0)
                        for c in code.T], axis=1).astype(np.float32)
    coder = Coder(languages, code, weights, np.ones(code.shape))
    keyed = rows.select("lang", F.xxhash64("lang", "text").alias("k"), F.col("text").cast("binary").alias("t"))
    cut = keyed.select("k").orderBy("k").limit(calibration).agg(F.max("k")).first()[0]  # keys only: no text meets another
    sample = keyed.filter(F.col("k") <= cut)
    sums = judge_bits(sample, coder).collect()
    right = np.ones(code.shape) * 0.9
    weight = np.ones(len(languages))
    for lang, hits, n in sums:
        right[number[lang]] += np.array(hits)
        weight[number[lang]] += n
    trust = right / weight[:, None]
    coder.trust = trust / trust.sum(axis=1, keepdims=True) * code.shape[1]
    return coder


def judge_bits(sample: DataFrame, coder: Coder) -> DataFrame:
    """(lang, right answers per bit, rows) on labelled rows (lang, k, t)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            good = np.sign(coder.margins([t.as_py() for t in batch.column(1)])) == coder.code[[coder.languages.index(x) for x in langs]]
            for lang in sorted(set(langs)):
                own = np.array([x == lang for x in langs])
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([good[own].sum(axis=0).tolist()], pa.list_(pa.int64())), pa.array([int(own.sum())])],
                                                 names=["lang", "hits", "n"])
    return sample.select("lang", "t").mapInArrow(run, "lang string, hits array<bigint>, n bigint")


def identify(docs: DataFrame, coder: Coder | None, *keep: Column) -> DataFrame:
    """The columns named in keep (doc_id unless given), lang_pred, score, ambiguous of each whole text."""
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    out = docs.select(*(keep or [F.col("doc_id")]), letter.alias("__letter"), F.col("text").cast("binary").alias("__t"))
    names = out.columns[:-2]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields[:-2])
    shared = docs.sparkSession.sparkContext.broadcast(coder)  # languages x buckets, never more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for batch in batches:
            n = len(names)
            letters = batch.column(n).to_numpy(zero_copy_only=False)
            lang, score, unsure = np.full(batch.num_rows, UNKNOWN, dtype=object), np.zeros(batch.num_rows), np.zeros(batch.num_rows, dtype=bool)
            at = np.flatnonzero(letters) if coder is not None else []
            if len(at):
                best, points, close = coder.decode(coder.margins([batch.column(n + 1)[int(i)].as_py() for i in at]))
                lang[at], score[at], unsure[at] = np.array(coder.languages, dtype=object)[best], points, close
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)],
                                             names=[*names, "lang_pred", "score", "ambiguous"])

    return out.mapInArrow(run, f"{shape}, lang_pred string, score double, ambiguous boolean")


@query("op1_language_id")
def op1_language_id(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(True))
    return identify(docs, fit(docs.filter(~held_out)), F.col("doc_id"), held_out.alias("held_out"))
