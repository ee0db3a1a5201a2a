"""Quality rules by weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document. The documents are counted per pattern of votes,
and expectation-maximisation over these counts estimates how likely each rule votes good on good and bad on bad
documents, and the share of good ones. A document is kept on its posterior probability of being good, not on
passing every rule. Base failures (too few words, repeated windows) go in any case.

The patterns (at most 3 ** rules, in practice some hundred) are all that reaches the driver; the posterior is a
column expression.

Defined results: a null text counts as empty and fails the base; equal texts get equal verdicts; an empty table gives
an empty result; with one kind of vote only, the prior decides. Other columns are ignored by `measure`, kept by `clean`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktab.llm.common import keep, query, table

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
THRESHOLD = 0.5
MARK = "__quality_"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = """the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which
der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass
le la les de des et en un une du que est pour qui dans par sur au il ne pas ce avec plus se sont
el los las y que del se por con una su para es al lo como más pero sus este si""".split()

STATS = {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint",
         "n_lines": "bigint", "n_ended_lines": "bigint", "n_letter_words": "bigint", "n_distinct_words": "bigint", "n_stop_words": "bigint", "n_stutters": "bigint"}

_STOP = frozenset(w.encode() for w in STOP_WORDS)
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
_LETTERS = bytes(i for i in range(256) if i >= 128 or bytes([i]).isalpha())
_NEITHER = bytes(i for i in range(256) if i not in _LETTERS and i not in _SPACES)


def repeated_words(words: list[bytes], distinct: dict[bytes, None] | None = None, window: int = WINDOW) -> int:
    """Words that lie in a window of consecutive words found twice or more in the text."""
    n = len(words)
    distinct = dict.fromkeys(words) if distinct is None else distinct
    if n <= window or len(distinct) > n - window:  # two equal windows repeat each of their words or overlap
        return 0
    number = {w: i for i, w in enumerate(distinct)}
    ids = np.fromiter(map(number.__getitem__, words), dtype=np.uint64, count=n)
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    count = n - window + 1
    h = np.zeros(count, dtype=np.uint64)
    for j in range(window):
        h = h * np.uint64(0xBF58476D1CE4E5B9) + mixed[j:j + count]
    ordered = np.sort(h)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    a, b = order[:-1][same], order[1:][same]
    alike = np.ones(len(a), dtype=bool)
    for j in range(window):
        alike &= ids[a + j] == ids[b + j]
    if alike.all():
        starts = np.union1d(a, b)
    else:  # two different windows with one hash: compare the windows themselves
        seen: dict[tuple, list[int]] = {}
        for i in range(count):
            seen.setdefault(tuple(ids[i:i + window].tolist()), []).append(i)
        starts = np.array(sorted(i for at in seen.values() if len(at) > 1 for i in at), dtype=np.int64)
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[starts] += 1
    edge[starts + window] -= 1
    return int((np.cumsum(edge)[:n] > 0).sum())


def text_stats(text: bytes | None) -> tuple[int, ...]:
    """The numbers of STATS for one UTF-8 text."""
    text = text or b""
    words = text.split()
    tails = int(((np.frombuffer(text, dtype=np.uint8) & 0xC0) == 0x80).sum())
    seen: set[bytes] = set()
    lines = dup = ended = 0
    for line in text.split(b"\n"):
        body = line.strip()
        if body:
            lines += 1
            ended += body.endswith((b".", b"!", b"?", b'"', b"\xe2\x80\x9d"))
            dup += line in seen
            seen.add(line)
    distinct = dict.fromkeys(words)
    stop = {w.lower() for w in distinct} & _STOP
    return (len(words), sum(map(len, words)) - tails, len(text) - len(text.translate(None, _SYMBOLS)), dup, repeated_words(words, distinct),
            lines, ended, len(text.translate(None, _NEITHER).split()), len(distinct), len(stop), sum(map(eq, words, words[1:])))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the numbers of STATS, from the whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_stats(t.as_py()) for t in batch.column(1)]
            cols = [pa.array([f[i] for f in found], pa.int64()) for i in range(len(STATS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", *STATS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("t")).mapInArrow(
        run, f"doc_id {kind}, " + ", ".join(f"{k} {v}" for k, v in STATS.items()))


def measure_rows(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all their columns, with the numbers of STATS under names that start with MARK."""
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, *[T.StructField(MARK + k, T.LongType()) for k in STATS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_stats(t.as_py()) for t in batch.column(at).cast(pa.binary())]
            cols = [pa.array([f[i] for f in found], pa.int64()) for i in range(len(STATS))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def rules(mark: str = "") -> dict[str, Column]:
    """Votes as columns over STATS: 1 good, -1 bad, 0 no opinion."""
    def stat(name: str) -> Column:
        return F.col(mark + name)

    n, lines = F.greatest(stat("n_words"), F.lit(1)), F.greatest(stat("n_lines"), F.lit(1))

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    mean = stat("word_chars") / n
    symbols, dup, repeat = stat("n_symbols") / n, stat("n_dup_lines") / lines, stat("n_repeat_words") / n
    ended, letters, distinct = stat("n_ended_lines") / lines, stat("n_letter_words") / n, stat("n_distinct_words") / n
    stop, stutter = stat("n_stop_words"), stat("n_stutters") / n
    return {
        "length": vote(stat("n_words") < MIN_WORDS, stat("n_words") >= 50),
        "word_length": vote((mean < 2.5) | (mean > 12), (mean >= 3) & (mean <= 10)),
        "symbols": vote(symbols > 0.1, symbols <= 0.02),
        "symbol_flood": vote(symbols > 0.5, symbols <= 0.1),
        "duplicate_lines": vote(dup > 0.3, dup <= 0.05),
        "repeats": vote(repeat > 0.3, repeat <= 0.05),
        "sentences": vote(ended < 0.2, ended >= 0.7),
        "letters": vote(letters < 0.7, letters >= 0.9),
        "variety": vote((distinct < 0.15) & (stat("n_words") < 2000), (distinct >= 0.3) | (stat("n_words") >= 2000)),
        "stutter": vote(stutter > 0.1, stutter <= 0.03),
        "stop_words": vote((stop < 2) & (stat("n_words") >= MIN_WORDS), stop >= 4),
    }


@dataclass(frozen=True)
class VoteModel:
    """prior: share of good documents; good[j]: chance that rule j, if it votes, votes good on a good document;
    bad[j]: that it votes bad on a bad one."""
    names: tuple[str, ...]
    prior: float
    good: tuple[float, ...]
    bad: tuple[float, ...]

    def posterior(self, votes: dict[str, Column]) -> Column:
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, g, b in zip(self.names, self.good, self.bad):
            odds = odds + (F.when(votes[name] == 1, math.log(g / (1 - b))).when(votes[name] == -1, math.log((1 - g) / b)).otherwise(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def fit(patterns: list[tuple[tuple[int, ...], int]], names: list[str], rounds: int = 200) -> VoteModel:
    """Expectation-maximisation over (votes, number of documents).

    Starts from the share of good votes in each pattern. A rule may miss most bad documents, as each kind of bad
    text breaks other rules, but must vote bad oftener on bad than on good ones; the prior stays inside 0.05 to
    0.95. This keeps the two classes from changing places.
    """
    votes = np.array([p for p, _ in patterns], dtype=float).reshape(len(patterns), len(names))
    weight = np.array([c for _, c in patterns], dtype=float)
    up, down = (votes == 1).astype(float), (votes == -1).astype(float)
    cast = up.sum(1) + down.sum(1)
    q = np.where(cast > 0, (up.sum(1) + 0.5) / (cast + 1), 0.5) ** 2
    prior, good, bad = 0.5, np.full(len(names), 0.8), np.full(len(names), 0.8)
    for _ in range(rounds if weight.sum() else 0):
        g, b = weight * q, weight * (1 - q)
        old = np.concatenate([[prior], good, bad])
        prior = float(np.clip((g.sum() + 1) / (weight.sum() + 2), 0.05, 0.95))
        good = np.clip((g @ up + 4) / (g @ (up + down) + 5), 0.6, 0.999)
        bad = np.clip((b @ down + 4) / (b @ (up + down) + 5), 1.05 - good, 0.999)
        odds = math.log(prior / (1 - prior)) + up @ np.log(good / (1 - bad)) + down @ np.log((1 - good) / bad)
        q = 1 / (1 + np.exp(-odds))
        if np.abs(np.concatenate([[prior], good, bad]) - old).max() < 1e-9:
            break
    return VoteModel(tuple(names), prior, tuple(good.tolist()), tuple(bad.tolist()))


def _verdict(stats: DataFrame, threshold: float, mark: str = "") -> dict[str, Column]:
    """Fit on a written table of STATS; base_failed, posterior and kept as columns over it."""
    votes = rules(mark)
    names = sorted(votes)
    counted = stats.groupBy(*[votes[n].alias(n) for n in names]).count().orderBy(*names).collect()  # at most 3 ** rules
    model = fit([(tuple(r)[:-1], r["count"]) for r in counted], names)
    words = F.col(mark + "n_words")
    failed = (words < MIN_WORDS) | (F.col(mark + "n_repeat_words") * 100 > words * MAX_REPEAT_PERCENT)
    chance = model.posterior(votes)
    return {"base_failed": failed, "posterior": chance, "kept": ~failed & (chance >= threshold)}


def judge(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, STATS, votes (by rule), base_failed, posterior, kept: one row per document."""
    stats = keep(measure(docs), "quality-stats")
    votes = rules()
    return stats.withColumns({**_verdict(stats, threshold),
                              "votes": F.create_map(*[x for n in sorted(votes) for x in (F.lit(n), votes[n])])})


def clean(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that `judge` would keep, with all their columns, without a shuffle."""
    rows = keep(measure_rows(docs), "quality-rows")
    return rows.filter(_verdict(rows, threshold, MARK)["kept"]).select(*[F.col(f"`{x}`") for x in docs.columns])


@query("op6_quality_rules")
def op6_quality_rules(spark, folder):
    return judge(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
