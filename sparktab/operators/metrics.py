"""Evaluation: one grouped count or one wide aggregate behind every metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparktab.functions.columns import c, dbl, rounded
from sparktab.functions.order import prefix_sums
from sparktab.functions.staging import stage
from sparktab.operators.profile import histogram


def _regression_cells(y: Column, p: Column) -> dict[str, Column]:
    err = y - p
    n = F.count(err)
    rss, tss = F.sum(err * err), F.var_pop(F.when(err.isNotNull(), y)) * n
    return {
        "rmse": F.sqrt(rss / n), "mae": F.avg(F.abs(err)),
        "r2": F.when(tss > 0, 1 - rss / tss).when(rss == 0, 1.0).otherwise(0.0),
        "mape": F.avg(F.when(F.abs(y) > 1e-8, F.abs(err / F.nullif(y, F.lit(0.0))))) * 100}


def regression_metrics(df: DataFrame, label: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    """rmse, mae, r2 and mape (rows with a non-zero label), rounded to 4."""
    cells = [rounded(v).alias(k) for k, v in _regression_cells(dbl(label), dbl(prediction)).items()]
    return df.groupBy(*[c(b) for b in by or []]).agg(*cells)


def confusion_counts(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Non-zero cells only, of any number of classes."""
    return (df.filter(c(label).isNotNull() & c(prediction).isNotNull())
            .groupBy(c(label).alias("label"), c(prediction).alias("prediction"))
            .agg(F.count(F.lit(1)).alias("n")))


def confusion_matrix(df: DataFrame, label: str, prediction: str, zeros: bool = True) -> DataFrame:
    """Count per (label, prediction): over all pairs of classes, or with `zeros` off only those that occur.

    All pairs of k classes are k * k rows by definition; with many classes take the ones that occur.
    """
    counts = confusion_counts(df, label, prediction)
    if not zeros:
        return counts
    counts = stage(counts, "confusion")
    names = counts.select("label").union(counts.select("prediction")).distinct()
    grid = names.crossJoin(names.withColumnRenamed("label", "prediction"))
    return (grid.join(counts, ["label", "prediction"], "left")
            .select("label", "prediction", F.coalesce("n", F.lit(0)).alias("n")))


def class_counts(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(class, support, chosen, hits, precision, recall, f1) of every class that is a label or a prediction."""
    counts = confusion_counts(df, label, prediction)
    zero, n = F.lit(0).cast("bigint"), F.col("n")
    sides = F.array(F.struct(F.col("label").alias("class"), n.alias("support"), zero.alias("chosen"), F.when(F.col("label") == F.col("prediction"), n).otherwise(zero).alias("hits")),
                    F.struct(F.col("prediction").alias("class"), zero.alias("support"), n.alias("chosen"), zero.alias("hits")))
    per = counts.select(F.inline(sides)).groupBy("class").agg(*[F.sum(x).alias(x) for x in ("support", "chosen", "hits")])
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    per = per.withColumns({"precision": share(F.col("hits"), F.col("chosen")), "recall": share(F.col("hits"), F.col("support"))})
    p, r = F.col("precision"), F.col("recall")
    return per.withColumn("f1", share(2 * p * r, p + r))


def per_class_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    kind = df.schema[label].dataType
    per = class_counts(df, label, prediction)
    return per.select(F.col("class").cast(kind).alias("class"), *[F.round(x, 4).alias(x) for x in ("precision", "recall", "f1")], "support")


def _safe(a: float, b: float) -> float:
    return a / b if b else 0.0


def classification_values(df: DataFrame, label: str, prediction: str, pos_label=None) -> dict:
    """accuracy, f1, precision, recall (binary for two label classes, else support-weighted), mcc, kappa.

    One row of sums over the classes reaches the driver, however many there are.
    """
    per = class_counts(df, label, prediction)
    whole = lambda x: F.col(x).cast("decimal(18,0)")
    support, scores = F.col("support"), F.struct("f1", "precision", "recall")
    is_one = F.coalesce(F.col("class").cast("string").try_cast("double") == 1, F.lit(False))
    chosen = is_one if pos_label is None else F.col("class") == F.lit(pos_label)
    row = per.agg(F.sum("support").alias("n"), F.sum("hits").alias("hit"), F.count_if(support > 0).alias("classes"),
                  *[F.sum(F.col(m) * support).alias(m) for m in ("f1", "precision", "recall")],
                  F.sum(whole("support") * whole("chosen")).alias("cross"), F.sum(whole("chosen") * whole("chosen")).alias("chosen2"),
                  F.sum(whole("support") * whole("support")).alias("support2"),
                  F.max_by(scores, F.when(support > 0, F.col("class"))).alias("last"), F.max(F.when(chosen, scores)).alias("asked"),
                  F.max((support > 0) & is_one).alias("one")).first()
    n, hit, cross = int(row["n"] or 0), int(row["hit"] or 0), int(row["cross"] or 0)
    out = {"accuracy": _safe(hit, n)}
    if row["classes"] == 2:
        one = row["asked"] if pos_label is not None or row["one"] else row["last"]
        out |= {m: float(one[m]) if one else 0.0 for m in ("f1", "precision", "recall")}
    else:
        out |= {m: _safe(float(row[m] or 0), n) for m in ("f1", "precision", "recall")}
    a, b = n * n - int(row["chosen2"] or 0), n * n - int(row["support2"] or 0)
    out["mcc"] = _safe(hit * n - cross, (a * b) ** 0.5)
    expected = _safe(cross, n * n)
    out["kappa"] = _safe(out["accuracy"] - expected, 1 - expected)
    return out


def classification_metrics(df: DataFrame, label: str, prediction: str, pos_label=None) -> DataFrame:
    v = classification_values(df, label, prediction, pos_label)
    names = ["accuracy", "f1", "precision", "recall", "mcc", "kappa"]
    return df.sparkSession.createDataFrame([tuple(round(float(v[m]), 4) for m in names)],
                                           ", ".join(f"{m} double" for m in names))


def _score_counts(df: DataFrame, positive: Column, score: Column) -> DataFrame:
    """Positives and negatives per distinct score: ties and hot scores collapse before the sort."""
    return (df.select(positive.cast("int").alias("y"), score.cast("double").alias("score"))
            .filter("y is not null and score is not null")
            .groupBy("score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")))


def auc_binary(df: DataFrame, positive: Column, score: Column) -> float | None:
    """ROC area with ties averaged, from running counts over the distinct scores."""
    run = prefix_sums(_score_counts(df, positive, score), ["score"], ["pos", "neg"])
    below = F.col("cum_neg") - F.col("neg")
    pos = F.col("pos").cast("double")
    r = run.agg(F.sum(pos * (below + F.col("neg") / 2.0)), F.sum("pos"), F.sum("neg")).first()
    return None if not r[1] or not r[2] else r[0] / (float(r[1]) * float(r[2]))


def auc_ovr_weighted(df: DataFrame, label: str, scores: dict) -> float | None:
    """One-vs-rest area per class, weighted by the class size: {class: score column}."""
    names = list(scores)
    cells = F.array(*[F.struct(F.lit(i).alias("k"), (c(label) == F.lit(k)).cast("int").alias("y"),
                               c(scores[k]).cast("double").alias("score")) for i, k in enumerate(names)])
    counts = (df.filter(c(label).isNotNull()).select(F.inline(cells)).groupBy("k", "score")
              .agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")))
    run = prefix_sums(counts, ["k", "score"], ["neg"])
    # the running sum goes over all classes: take off what earlier classes hold
    per = run.groupBy("k").agg(
        F.sum(F.col("pos").cast("double") * (F.col("cum_neg") - F.col("neg") / 2.0)).alias("a"),
        F.sum("pos").alias("p"), F.sum("neg").alias("n")).orderBy("k").collect()
    total, weight, done = 0.0, 0, 0
    for r in per:
        if r["p"] and r["n"]:
            total += r["p"] * (r["a"] - float(r["p"]) * done) / (float(r["p"]) * r["n"])
            weight += r["p"]
        done += r["n"]
    return total / weight if weight else None


def roc_curve(df: DataFrame, positive: Column, score: Column) -> DataFrame:
    """(threshold, fpr, tpr), one point per distinct score, from high to low."""
    counts = _score_counts(df, positive, score).withColumn("score", -F.col("score"))
    run = prefix_sums(counts, ["score"], ["pos", "neg"])
    t = counts.agg(F.sum("pos"), F.sum("neg")).first()
    return run.select((-F.col("score") + F.lit(0.0)).alias("threshold"),
                      F.round(F.col("cum_neg") / F.lit(float(t[1] or 1)), 6).alias("fpr"),
                      F.round(F.col("cum_pos") / F.lit(float(t[0] or 1)), 6).alias("tpr"))


def roc_micro(df: DataFrame, label: str, scores: dict) -> DataFrame:
    """Micro-average curve: every (row, class) pair is one binary case."""
    cells = F.array(*[F.struct((c(label) == F.lit(k)).alias("y"), c(col).alias("score"))
                      for k, col in scores.items()])
    return roc_curve(df.select(F.inline(cells)), F.col("y"), F.col("score"))


def multi_output_metrics(df: DataFrame, pairs: dict[str, tuple[str, str]], task: str = "regression") -> DataFrame:
    """Per target and their plain mean (target = "mean"): {target: (label, prediction)}."""
    if task == "regression":
        names = ["rmse", "mae", "r2"]
        wide = df.agg(*[_regression_cells(dbl(y), dbl(p))[m].alias(f"{t}|{m}")
                        for t, (y, p) in pairs.items() for m in names])
        per = wide.select(F.inline(F.array(*[F.struct(
            F.lit(t).alias("target"), *[rounded(c(f"{t}|{m}")).alias(m) for m in names]) for t in pairs])))
    else:
        names = ["accuracy", "f1"]
        rows = []
        for t, (y, p) in pairs.items():
            n, hit, f1 = class_counts(df, y, p).agg(F.sum("support"), F.sum("hits"), F.sum(F.col("f1") * F.col("support"))).first()
            rows.append((t, round(_safe(hit or 0, n or 0), 4), round(_safe(f1 or 0.0, n or 0), 4)))
        per = df.sparkSession.createDataFrame(rows, "target string, accuracy double, f1 double")
    mean = per.agg(F.lit("mean").alias("target"), *[rounded(F.avg(m)).alias(m) for m in names])
    return per.unionByName(mean)


def predicted_vs_actual(df: DataFrame, label: str, prediction: str, bins: int | None = None) -> DataFrame:
    """Pairs with the common range; with `bins`, counts on a square grid instead."""
    y, p = dbl(label), dbl(prediction)
    r = df.agg(F.least(F.min(y), F.min(p)), F.greatest(F.max(y), F.max(p))).first()
    if bins is None:
        return df.select(y.alias("actual"), p.alias("predicted"), F.lit(r[0]).alias("low"), F.lit(r[1]).alias("high"))
    lo, width = r[0], (r[1] - r[0]) or 1.0
    cell = lambda v: F.least(F.floor((v - lo) / width * bins), F.lit(bins - 1))
    return df.groupBy(cell(y).alias("actual_bin"), cell(p).alias("predicted_bin")).agg(F.count(F.lit(1)).alias("n"))


def residual_histogram(df: DataFrame, label: str, prediction: str, bins: int = 30) -> DataFrame:
    return histogram(df.select((dbl(label) - dbl(prediction)).alias("residual")), ["residual"], bins=bins)


def _order(task: str) -> list[Column]:
    key = F.asc_nulls_last("rmse") if task == "regression" else F.desc_nulls_last("accuracy")
    return [key, F.asc("model")]


def leaderboard(results: DataFrame, task: str) -> DataFrame:
    """Ranked models; failed ones (no metric) last. One row per trained model, so few."""
    metric = F.col("rmse" if task == "regression" else "accuracy")
    return (results.withColumn("failed", metric.isNull())
            .withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*_order(task)))))


def best_model(results: DataFrame, task: str) -> DataFrame:
    task = task.lower()
    metric = "rmse" if task == "regression" else "accuracy"
    key = F.struct((F.col(metric) if task == "regression" else -F.col(metric)).alias("m"), F.col("model"))
    key = F.when(F.col(metric).isNotNull(), key)
    return results.agg(F.min_by("model", key).alias("best_model"), F.min_by(metric, key).alias("best_score"))


def metric_comparison(results: DataFrame, metrics: list[str]) -> DataFrame:
    """Long form (model, metric, value)."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), c(m).cast("double").alias("value")) for m in metrics])
    return results.select("model", F.inline(cells))


def rank_models(results: DataFrame, primary: str, larger_is_better: bool, ties: list[str]) -> DataFrame:
    """Primary metric, then training time, scoring time, size, fold spread (all smaller first)."""
    first = F.desc_nulls_last(primary) if larger_is_better else F.asc_nulls_last(primary)
    w = W.partitionBy(F.lit(0)).orderBy(first, *[F.asc_nulls_last(x) for x in ties], F.asc("model"))
    return results.withColumn("rank", F.row_number().over(w))
