"""Explanations: contributions per row and feature in long form (key, feature, value, contribution)."""

from __future__ import annotations

import itertools
import math
import random
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktab.functions.aggregate import exact_quantiles, gram_matrix, wide_agg
from sparktab.functions.columns import c, dbl, spread
from sparktab.functions.lookup import lookup
from sparktab.functions.staging import stage, stage_path

BLOCK_ROWS = 4096  # of either side of a block of pairs in shap_kernel


def feature_importance(model: Model | list[Model], features: list[str], spark, top: int = 15) -> DataFrame:
    """Impurity importance; a list of models (one per target) is averaged."""
    many = model if isinstance(model, list) else [model]
    mean = np.mean([m.featureImportances.toArray() for m in many], axis=0)
    rows = sorted(zip(features, map(float, mean)), key=lambda r: (-r[1], r[0]))[:top]
    return spark.createDataFrame(rows, "feature string, importance double")


ALL_SUBSETS, ORDERS = 12, 1000  # features up to which all feature sets are averaged; seeded orders beyond


def conditional_map(coefs: list[float], cov: np.ndarray, seed: int = 42) -> np.ndarray:
    """Matrix M with contributions = M (x - mean) of a linear model whose features vary together.

    The value of a set of features is the model's mean given them, which is linear in them: their own coefficients plus the
    others' through the regression on the set. Averaging what a feature adds over all orders keeps it linear, so one
    matrix serves every row. All sets are averaged exactly up to ALL_SUBSETS features, else ORDERS seeded orders.
    """
    beta, p = np.array(coefs, dtype=float), len(coefs)

    def value(held: tuple[int, ...]) -> np.ndarray:
        row, at = np.zeros(p), list(held)
        rest = [i for i in range(p) if i not in held]
        if at:
            row[at] = beta[at] + np.linalg.pinv(cov[np.ix_(at, at)]) @ cov[np.ix_(at, rest)] @ beta[rest]
        return row

    out = np.zeros((p, p))
    if p <= ALL_SUBSETS:
        values = {s: value(s) for n in range(p + 1) for s in itertools.combinations(range(p), n)}
        for s, v in values.items():
            for i in range(p):
                if i not in s:
                    share = math.factorial(len(s)) * math.factorial(p - len(s) - 1) / math.factorial(p)
                    out[i] += share * (values[tuple(sorted((*s, i)))] - v)
        return out
    rng = random.Random(seed)
    for _ in range(ORDERS):
        order, before = rng.sample(range(p), p), np.zeros(p)
        for n, i in enumerate(order):
            now = value(tuple(sorted(order[:n + 1])))
            out[i] += (now - before) / ORDERS
            before = now
    return out


def shap_linear(df: DataFrame, key: str, coefs: dict[str, float], means: dict[str, float] | None = None,
                together: bool = False) -> DataFrame:
    """Contributions of every row and feature to a linear model: (key, feature, value, contribution).

    Features on their own: coef * (x - mean), the mean over `df` unless given. With `together`, features that vary together share
    what they tell of each other (see conditional_map); means and covariances come from one pass over the rows of `df` without gaps.
    """
    names = list(coefs)
    if together:
        known = df.select(*[dbl(f).alias(f) for f in names]).dropna()
        sums = gram_matrix(known.select(F.lit(1.0).alias("_one"), *[c(f) for f in names]))
        n = max(sums[0, 0], 1.0)
        mean = sums[0, 1:] / n
        cov = sums[1:, 1:] / n - np.outer(mean, mean)
        means = dict(zip(names, map(float, mean))) if means is None else means
        weight = conditional_map([coefs[f] for f in names], cov)
    else:
        means = means or wide_agg(df, {f: F.avg(dbl(f)) for f in names})
        weight = np.diag([float(coefs[f]) for f in names])
    off = {f: dbl(f) - F.lit(means[f]) for f in names}

    def told(i: int) -> Column:
        parts = [F.lit(float(w)) * off[g] for g, w in zip(names, weight[i]) if w or g == names[i]]
        return reduce(add, parts)

    cells = F.array(*[F.struct(F.lit(f).alias("feature"), dbl(f).alias("value"), told(i).alias("contribution")) for i, f in enumerate(names)])
    return df.select(c(key), F.inline(cells))


def linear_base(coefs: dict[str, float], intercept: float, means: dict[str, float]) -> float:
    return intercept + sum(w * means[f] for f, w in coefs.items())


@dataclass
class Tree:
    """Node arrays of one tree; node 0 is the root, left = -1 marks a leaf.

    A row goes left if its feature is at most `cut`, or one of `left_set` (categories) where that is given.
    """
    left: list[int]
    right: list[int]
    feature: list[int]
    cut: list[float]
    left_set: list[list[float] | None]
    value: list[float]      # times the tree's weight
    cover: list[float]      # training rows

    def goes_left(self, node: int, x: np.ndarray) -> np.ndarray:
        of = x[:, self.feature[node]]
        return of <= self.cut[node] if self.left_set[node] is None else np.isin(of, self.left_set[node])

    def share(self, node: int, child: int) -> float:
        return self.cover[child] / self.cover[node] if self.cover[node] else 0.0


def model_trees(model: Model, spark, value_of_class: int = 1) -> list[Tree]:
    """Node arrays of all trees of a tree model, from its saved node table."""
    path = stage_path(spark, "tree")
    model.write().save(path)
    nodes = spark.read.parquet(path + "/data")
    if "treeID" not in nodes.columns:
        nodes = nodes.select(F.lit(0).alias("treeID"), F.struct(*nodes.columns).alias("nodeData"))
    weights = list(getattr(model, "treeWeights", [1.0]))
    forest = type(model).__name__.startswith("RandomForest")
    boosted = type(model).__name__.startswith("GBT")
    classes = not boosted and type(model).__name__.endswith("ClassificationModel")
    found: dict[int, dict] = {}
    for r in nodes.select("treeID", "nodeData.*").collect():  # nodes of one model, not rows of data
        found.setdefault(r["treeID"], {})[r["id"]] = r
    out = []
    for t, held in sorted(found.items()):
        scale = 1.0 / len(weights) if forest else weights[t]
        rows = [held[i] for i in range(len(held))]
        split = [r["split"] for r in rows]
        inner = [r["leftChild"] >= 0 for r in rows]
        classed = [s["numCategories"] != -1 for s in split]
        out.append(Tree(
            [r["leftChild"] for r in rows], [r["rightChild"] for r in rows], [s["featureIndex"] for s in split],
            [s["leftCategoriesOrThreshold"][0] if i and not k else math.nan for s, i, k in zip(split, inner, classed)],
            [list(s["leftCategoriesOrThreshold"]) if i and k else None for s, i, k in zip(split, inner, classed)],
            [scale * (r["impurityStats"][value_of_class] / (sum(r["impurityStats"]) or 1.0) if classes else r["prediction"]) for r in rows],
            [float(r["rawCount"]) for r in rows]))
    return out


def _with(poly: list[np.ndarray], zero: float, one: np.ndarray) -> list[np.ndarray]:
    """Coefficients after a factor (zero + one t) is taken in: by how many features of the path a row has kept."""
    out = [poly[0] * zero]
    out += [poly[i] * zero + poly[i - 1] * one for i in range(1, len(poly))]
    return [*out, poly[-1] * one]


def _without(poly: list[np.ndarray], zero: float, one: np.ndarray) -> list[np.ndarray]:
    """Coefficients after the factor is taken out again."""
    m = len(poly) - 1
    out = [poly[0]] * m
    above = poly[m]
    for i in range(m - 1, -1, -1):  # divided by (zero + t) from the top where one is 1, by zero elsewhere
        out[i] = np.where(one, above, poly[i] / zero if zero else 0.0)
        above = poly[i] - out[i] * zero
    return out


def _leaf_sum(poly: list[np.ndarray], zero: float, one: np.ndarray, weight: list[float]) -> np.ndarray:
    """Sum of weight times the coefficients without one factor, without keeping them."""
    m = len(poly) - 1
    total, above = 0.0, poly[m]
    plain = sum(w * p for w, p in zip(weight, poly[:m])) / zero if zero else np.zeros_like(above)
    for i in range(m - 1, -1, -1):
        total = total + weight[i] * above
        above = poly[i] - above * zero
    return np.where(one, total, plain)


def path_contributions(x: np.ndarray, trees: list[Tree]) -> np.ndarray:
    """Shapley values of each row and feature, what a row doesn't know being averaged by the trees' covers.

    A walk over the nodes carries, for each feature on the way, the share of covers and whether a row agrees, and the polynomial of
    all of them: going down takes a factor in, a feature met again has its old one taken out first. A leaf's value is dealt by what is left
    without each feature's factor. The work is rows x leaves x depth^2, the memory rows x depth, whatever the depth.
    """
    phi = np.zeros_like(x)
    rows = len(x)
    weights: dict[int, list[float]] = {}
    for tree in trees:
        todo = [(0, {}, [np.ones(rows)])]
        while todo:
            node, held, poly = todo.pop()
            if tree.left[node] < 0:
                d = len(held)
                if not d:
                    continue
                weight = weights.setdefault(d, [math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)])
                for f, (zero, one) in held.items():
                    phi[:, f] += tree.value[node] * (one - zero) * _leaf_sum(poly, zero, one, weight)
                continue
            f, goes = tree.feature[node], tree.goes_left(node, x)
            zero, one = held.get(f, (1.0, None))
            base = poly if one is None else _without(poly, zero, one)
            for child, follows in ((tree.left[node], goes), (tree.right[node], ~goes)):
                share = zero * tree.share(node, child)
                now = follows if one is None else one & follows
                if not share and not now.any():
                    continue  # no training row went there and none of these does
                todo.append((child, {**held, f: (share, now)}, _with(base, share, now)))
    return phi


def tree_base(trees: list[Tree]) -> float:
    """Mean output by covers."""
    total = 0.0
    for tree in trees:
        todo = [(0, 1.0)]
        while todo:
            node, share = todo.pop()
            if tree.left[node] < 0:
                total += share * tree.value[node]
            else:
                todo += [(child, share * tree.share(node, child)) for child in (tree.left[node], tree.right[node])]
    return float(total)


def shap_tree(df: DataFrame, key: str, features: list[str], trees: list[Tree]) -> DataFrame:
    """Contributions of all rows to a tree model's output (class-1 share for classifiers)."""
    src = df.select(c(key), *[c(f).cast("double").alias(f) for f in features])
    shared = df.sparkSession.sparkContext.broadcast(trees)  # as large as the model
    kind = T.StructType([src.schema[key], T.StructField("phi", T.ArrayType(T.DoubleType())),
                         *[T.StructField(f, T.DoubleType()) for f in features]])

    def run(batches):
        for rows in batches:
            phi = path_contributions(rows[features].to_numpy(dtype="float64"), shared.value)
            yield rows.assign(phi=list(phi))[[key, "phi", *features]]

    cells = F.array(*[F.struct(F.lit(f).alias("feature"), c(f).alias("value"), F.col("phi")[i].alias("contribution"))
                      for i, f in enumerate(features)])
    return spread(src).mapInPandas(run, kind).select(c(key), F.inline(cells))


def output_column(pred: DataFrame, classifier: bool):
    return vector_to_array("probability")[1] if classifier and "probability" in pred.columns else F.col("prediction")


def shap_kernel(df: DataFrame, background: DataFrame, key: str, features: list[str], model: Model,
                permutations: int = 4, classifier: bool = False, seed: int = 42) -> DataFrame:
    """Shapley values of any model over seeded feature orders: (key, feature, contribution, base_value).

    The value of a set of features is the mean prediction over all background
    rows with these features taken from the row, so the contributions of a row
    add up to its prediction minus `base_value`, the mean prediction of the
    background. Rows that agree in the set are valued once, and background rows
    that agree outside it count as one with a weight. The pairs of a set are
    dealt in blocks of bounded size.
    """
    rng = random.Random(seed)
    share: dict[tuple, dict[int, float]] = {}  # set of features -> feature -> weight of the set's value
    for _ in range(permutations):
        o = list(range(len(features)))
        rng.shuffle(o)
        for s, i in enumerate(o):
            for part, sign in ((o[:s + 1], 1.0), (o[:s], -1.0)):
                held = share.setdefault(tuple(sorted(part)), {})
                held[i] = held.get(i, 0.0) + sign / permutations
    sets = sorted(share)
    none = sets.index(())
    own = lambda inside: F.array(*[F.struct(F.lit(n).alias("_s"), F.array(F.lit(float(n)), *[
        c(f) if (i in s) == inside else F.lit(0.0) for i, f in enumerate(features)]).alias("_x")) for n, s in enumerate(sets)])
    rows = df.select(c(key), *[(dbl(f) + F.lit(0.0)).alias(f) for f in features])  # -0.0 and 0.0 are one value
    given = background.select(*[(dbl(f) + F.lit(0.0)).alias(f) for f in features])
    total, against = rows.count(), given.count()
    if not against:
        raise ValueError("the background has no rows")
    cells = stage(rows.select(F.inline(own(True))).groupBy("_s", "_x").agg((F.count(F.lit(1)) / max(total, 1)).alias("share")), "shap-cells")
    if not total:  # the base value is still that of the background
        cells = cells.sparkSession.createDataFrame([(none, [float(none)] + [0.0] * len(features), 0.0)], cells.schema)
    others = stage(given.select(F.inline(own(False))).groupBy("_s", F.col("_x").alias("_b")).agg(F.count(F.lit(1)).alias("_w")), "shap-background")
    na, nb = (max(1, math.ceil(x.groupBy("_s").count().agg(F.max("count")).first()[0] / BLOCK_ROWS)) for x in (cells, others))
    slots = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = cells.select("_s", "_x", F.pmod(F.xxhash64("_x"), F.lit(na)).cast("int").alias("_a")).withColumn("_c", slots(nb))
    right = others.withColumn("_c", F.pmod(F.xxhash64("_b"), F.lit(nb)).cast("int")).withColumn("_a", slots(na))
    inside = F.array(*[F.array(*[F.lit(i in s) for i in range(len(features))]) for s in sets])
    grid = left.join(right, ["_s", "_a", "_c"]).select("_x", "_w", *[
        F.when(F.get(F.get(inside, F.col("_s")), F.lit(i)), F.get("_x", F.lit(i + 1))).otherwise(F.get("_b", F.lit(i + 1))).alias(f)
        for i, f in enumerate(features)])
    scored = model.transform(VectorAssembler(inputCols=features, outputCol="features").transform(grid))
    scored = scored.withColumn("_f", output_column(scored, classifier))
    values = scored.groupBy("_x").agg((F.sum(F.col("_f") * F.col("_w")) / F.sum("_w")).alias("_v"))
    values = stage(values.join(cells.select("_x", "share"), "_x"), "shap-values")
    base = values.filter(F.get("_x", F.lit(0)) == float(none)).first()["_v"]
    parts = rows.select(c(key), F.inline(own(True))).filter(F.col("_s") != none)
    weights = F.array(*[F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in sorted(share[s].items())]) for s in sets])
    moves = lookup(parts, values, "_x", ["_v"], "share").select(c(key), "_v", F.inline(F.get(weights, F.col("_s"))))
    # what the empty set takes off is the same for each row
    off = F.get(F.array(*[F.lit(share[()].get(i, 0.0) * base) for i in range(len(features))]), F.col("i"))
    names = F.array(*[F.lit(f) for f in features])
    return (moves.groupBy(c(key), "i").agg(F.sum(F.col("_v") * F.col("w")).alias("_v"))
            .select(c(key), F.get(names, F.col("i")).alias("feature"), (F.col("_v") + off).alias("contribution"), F.lit(base).alias("base_value")))


def shap_importance(contributions: DataFrame, top: int = 15) -> DataFrame:
    return (contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance"))
            .orderBy(F.desc("importance"), "feature").limit(top))


def shap_beeswarm(contributions: DataFrame, top: int = 15) -> DataFrame:
    """Rows of the top features with the value scaled to 0..1."""
    stats = contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("m"), F.min("value").alias("lo"),
                                                 F.max("value").alias("hi")).orderBy(F.desc("m"), "feature").limit(top)
    # one row per shown feature, at most `top`
    return (contributions.join(F.broadcast(stats), "feature")
            .withColumn("value_norm", (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-8))
            .drop("m", "lo", "hi"))


def shap_waterfall(contributions: DataFrame, key: str, base: float, row=None, top: int = 15) -> DataFrame:
    """Base value, largest contributions with their values, and prediction: of all rows or one.

    A group holds one entry per feature of one row.
    """
    one = contributions if row is None else contributions.filter(c(key) == F.lit(row))
    parts = F.array_sort(F.collect_list(F.struct((-F.abs("contribution")).alias("o"), "feature", "value", "contribution")))
    g = one.groupBy(c(key)).agg(F.sum("contribution").alias("_s"), F.slice(parts, 1, top).alias("_p"))
    return g.select(c(key), F.lit(base).alias("base_value"), F.col("_p.feature").alias("features"),
                    F.col("_p.value").alias("feature_values"), F.col("_p.contribution").alias("contributions"),
                    (F.lit(base) + F.col("_s")).alias("prediction"))


def shap_dependence(contributions: DataFrame, feature: str) -> DataFrame:
    return contributions.filter(F.col("feature") == feature).select("value", "contribution")


def lowess_trend(points: DataFrame, x: str = "value", y: str = "contribution", bins: int = 50,
                 frac: float = 0.3) -> DataFrame:
    """Local linear trend over quantile bins: sums per bin in Spark, one small fit per bin."""
    edges = sorted(set(exact_quantiles(points, {x: [i / bins for i in range(1, bins)]})[x]))
    v = dbl(x)
    where = sum((F.when(v > e, 1).otherwise(0) for e in edges), F.lit(0))
    sums = points.filter(v.isNotNull() & dbl(y).isNotNull()).groupBy(where.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mx"), F.avg(dbl(y)).alias("my"),
        F.covar_pop(v, dbl(y)).alias("cxy"), F.var_pop(v).alias("cxx")).orderBy("bin").collect()
    n, mx, my, cxy, cxx = (np.array([r[k] for r in sums], dtype=float) for k in ("n", "mx", "my", "cxy", "cxx"))
    rows = []
    for i in range(len(sums)):
        gap = np.abs(mx - mx[i])
        reach = np.sort(gap)[min(len(gap) - 1, max(2, int(np.ceil(frac * len(gap)))))] or 1.0
        w = n * np.clip(1 - (gap / reach) ** 3, 0, 1) ** 3
        ax, ay = (w @ mx) / w.sum(), (w @ my) / w.sum()
        sxx = w @ (cxx + (mx - ax) ** 2)
        slope = (w @ (cxy + (mx - ax) * (my - ay))) / sxx if sxx > 0 else 0.0
        rows.append((float(mx[i]), float(ay + slope * (mx[i] - ax)), int(n[i])))
    return points.sparkSession.createDataFrame(rows, "x double, trend double, n bigint")
