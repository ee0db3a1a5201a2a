"""Wide aggregates: all statistics of all columns in few passes over the table."""

from __future__ import annotations

import math
from collections.abc import Callable, Hashable, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparktab.functions.columns import dbl

WIDTH = 200          # aggregate expressions per pass
COMPILED = 15        # as many as a pass over all rows should have where they are moments or correlations: Spark doesn't compile much wider ones
DIGITS = 1 << 13     # parts of an interval that one pass of a rank selection counts
INTERVALS = 48       # intervals counted by one job


def wide_agg(df: DataFrame, stats: Mapping[Hashable, Column], width: int = WIDTH) -> dict:
    """Evaluate named aggregates; one job per `width` expressions."""
    keys = list(stats)
    out: dict = {}
    for start in range(0, len(keys), width):
        part = keys[start:start + width]
        row = df.agg(*[stats[k].alias(f"s{i}") for i, k in enumerate(part)]).first()
        out.update({k: row[i] for i, k in enumerate(part)})
    return out


def adjusted_skewness(col: Column) -> Column:
    """Sample skewness with the bias removed; null below three values."""
    n = F.count(col).cast("double")
    return F.when(n > 2, F.skewness(col) * F.sqrt(n * (n - 1)) / (n - 2))


@dataclass
class Place:
    """The value at a rank, how many are below it and how many equal it."""
    value: float | int
    below: int
    ties: int


def _octave(v: float) -> int:
    if v == 0:
        return 0
    return int(math.copysign(3000 if math.isinf(v) else math.frexp(abs(v))[1] + 1100, v))


def _part(v: Column, low: float | int, high: float | int, by_octave: bool) -> Column:
    """Number of the part of [low, high] that a value lies in. It never falls as the value grows, and low and high differ in it."""
    if isinstance(low, int):
        shift = max(0, (high - low).bit_length() - DIGITS.bit_length() + 1)
        return F.shiftright(v, shift) - F.lit(low >> shift)
    if by_octave:
        size = F.when(F.abs(v) == math.inf, 3000).otherwise(F.floor(F.log2(F.abs(v))) + 1100)
        return F.when(v == 0, 0).when(v < 0, -size).otherwise(size).cast("bigint")
    return F.floor((v - F.lit(low)) / F.lit(high - low) * F.lit(float(DIGITS)))


def select_ranks(df: DataFrame, values: Mapping[Hashable, Column], ranks: Callable[[Hashable, int], list[int]]) -> dict:
    """{(name, rank): Place} of bigint or double columns by radix selection; nulls and ranks past the end have no place.

    `ranks` gives the wanted ranks of a name whose column has so many values.

    Every pass counts, for each open interval of each column, how many values fall into each of at most DIGITS parts of it: rows
    (interval, part) that all tasks sum up together. A running sum over them picks the part with the rank, and the least and greatest value
    met in it are the next interval; one value left ends it. Only the picked parts come to the driver, one row per interval and rank.
    Parts are equally wide; where that leaves most rows in one part (or the width can't be held) the next pass takes
    powers of two, so that few passes do for any values.
    """
    names = list(values)
    base = df.select(*[values[n].alias(f"v{i}") for i, n in enumerate(names)])
    ends = wide_agg(base, {(i, f): fn(f"v{i}") for i in range(len(names)) for f, fn in (("lo", F.min), ("hi", F.max), ("n", F.count))})
    place: dict = {}
    open_: dict = {}  # (column, low, high, by octave): [(rank wanted, rank inside, below)]

    def narrowed(i: int, rank: int, inside: int, below: int, low, high, n: int, crowded: bool) -> None:
        if low == high:
            place[names[i], rank] = Place(low, below, n)
            return
        far = not isinstance(low, int) and (crowded or math.isinf(high - low)) and abs(_octave(low) - _octave(high)) > 2
        open_.setdefault((i, low, high, far), []).append((rank, inside, below))

    for i, name in enumerate(names):
        for r in sorted(set(ranks(name, ends[i, "n"]))):
            if r < ends[i, "n"]:
                narrowed(i, r, r, 0, ends[i, "lo"], ends[i, "hi"], ends[i, "n"], False)
    while open_:
        now, open_ = open_, {}
        spans = list(now)
        for start in range(0, len(spans), INTERVALS):
            part = spans[start:start + INTERVALS]
            hits = []
            for j, (i, low, high, far) in enumerate(part):
                v = F.col(f"v{i}")
                hits.append(F.when((v >= F.lit(low)) & (v <= F.lit(high)), F.struct(F.lit(j).alias("j"), _part(v, low, high, far).alias("d"), v.alias("v"))))
            for kind in (int, float):  # values keep their type
                own = [h for h, span in zip(hits, part) if isinstance(span[1], kind)]
                if not own:
                    continue
                counts = (base.select(F.explode(F.array(*own)).alias("x")).filter("x is not null")
                          .groupBy(F.col("x.j").alias("j"), F.col("x.d").alias("d"))
                          .agg(F.count(F.lit(1)).alias("n"), F.min("x.v").alias("lo"), F.max("x.v").alias("hi")))
                whole = W.partitionBy("j")
                running = counts.withColumns({"end": F.sum("n").over(whole.orderBy("d")), "all": F.sum("n").over(whole)})
                asked = [(j, rank, inside) for j, span in enumerate(part) if isinstance(span[1], kind) for rank, inside, _ in now[span]]
                wanted = df.sparkSession.createDataFrame(asked, "j int, rank bigint, inside bigint")
                found = running.join(F.broadcast(wanted), "j").filter((F.col("inside") < F.col("end")) & (F.col("inside") >= F.col("end") - F.col("n")))
                got = {(r["j"], r["rank"]): r for r in found.collect()}
                for j, span in enumerate(part):
                    for rank, inside, below in now[span] if isinstance(span[1], kind) else ():
                        r = got[j, rank]
                        under = r["end"] - r["n"]
                        narrowed(span[0], rank, inside - under, below + under, r["lo"], r["hi"], r["n"], r["n"] * 16 > r["all"])
    return place


def exact_quantiles(df: DataFrame, probs: Mapping[str, list[float]]) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles of many columns by radix selection; null for a column without values."""
    at: dict = {}

    def ranks(name: str, n: int) -> list[int]:
        at[name] = [(n - 1) * p for p in probs[name]] if n else []
        return [f(r) for r in at[name] for f in (math.floor, math.ceil)]

    found = select_ranks(df, {n: dbl(n) for n in probs}, ranks)

    def value(n: str, rank: float) -> float:
        a, b = (found[n, f(rank)].value for f in (math.floor, math.ceil))
        return a if a == b else a + (b - a) * (rank - math.floor(rank))

    return {n: [value(n, r) for r in at[n]] or [None] * len(probs[n]) for n in probs}


def gram_matrix(df: DataFrame) -> np.ndarray:
    """Summed products of all column pairs: one partial matrix per task, added up by Spark."""
    width = len(df.columns)

    def partial(batches):
        total = np.zeros((width, width))
        for b in batches:
            x = b.to_numpy(dtype="float64")
            total += x.T @ x
        yield pd.DataFrame({"i": np.arange(width * width), "v": total.ravel()})

    cells = df.mapInPandas(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(width * width)
    for r in cells:
        out[r["i"]] = r["v"]
    return out.reshape(width, width)
