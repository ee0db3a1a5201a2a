"""Automatic preprocessing: all steps in order, fitted on the training rows, as one PipelineModel."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktab.functions.aggregate import exact_quantiles, wide_agg
from sparktab.functions.columns import c, numeric_columns, string_columns
from sparktab.functions.staging import stage
from sparktab.operators import balance, neighbors, profile
from sparktab.operators.base import Fitted
from sparktab.operators.clean import BooleanNormalizer, TypeCorrector, ingest
from sparktab.operators.encode import Encoder
from sparktab.operators.impute import Imputer
from sparktab.operators.scale import Scaler
from sparktab.operators.select import FeatureSelector
from sparktab.operators.split import split_random, split_stratified, split_time
from sparktab.operators.transform import DatetimeExpander, OutlierCapper, SkewFixer

LogRow = tuple[str, str, str, str]


@dataclass
class Prepared:
    train: DataFrame
    test: DataFrame
    model: PipelineModel
    task_type: str
    features: list[str]
    profile: dict
    log: list[LogRow] = field(default_factory=list)
    class_weights: dict | None = None

    def step_log(self) -> DataFrame:
        return self.train.sparkSession.createDataFrame(self.log, "step string, action string, reason string, status string")

    def overview(self) -> dict:
        """Steps by outcome, and the size of what came out."""
        outcome: dict[str, int] = {}
        for *_, status in self.log:
            outcome[status] = outcome.get(status, 0) + 1
        return {"task": self.task_type, "outcome": outcome, "columns": self.features,
                "rows": {"train": self.train.count(), "test": self.test.count()}, "weights": self.class_weights}


class AutoPreprocessor:
    """Ingest, profile, split, then fit transforms, imputation, encoding, selection and scaling.

    Everything is fitted on the training rows (`fit_scope="all"` fits all but the
    scaler on every row). The result holds the prepared parts and a PipelineModel
    that applies the same steps, with the same output columns, to new rows.
    """

    def __init__(self, target_col=None, task_type: str = "auto", is_time_series: bool = False,
                 date_col: str | None = None, test_size: float = 0.2, apply_smote: bool = False,
                 key: str | None = None, fit_scope: str = "train"):
        self.targets = [target_col] if isinstance(target_col, str) else list(target_col or [])
        self.task_type, self.is_time_series, self.date_col = task_type, is_time_series, date_col
        self.test_size, self.apply_smote, self.key, self.fit_scope = test_size, apply_smote, key, fit_scope

    def fit_transform(self, df: DataFrame) -> Prepared:
        df, log = ingest(df)
        key = self.key or "row_id"
        if self.key is None:
            # 52 bits: exact as a double, which the order statistics use
            df = df.withColumn(key, F.pmod(F.xxhash64(*[c(x) for x in df.columns]), F.lit(1 << 52)))
        targets = [x for x in self.targets if x in df.columns]
        seen = profile.full_profile(df.drop(key), targets[0] if targets else None)
        task = self.task_type if self.task_type != "auto" else seen.get("task_type", "unknown")
        df = self._split(df, key, targets, task, log)
        exclude = [*targets, key, "split"]
        scope = df if self.fit_scope == "all" else df.filter(F.col("split") == "train")
        train_rows = df.filter(F.col("split") == "train")
        stages: list[Fitted] = []

        def add(step, on):
            model = step.fit(on)
            stages.append(model)
            log.extend(model.log())
            return model.transform(on)

        for step in (BooleanNormalizer(exclude=exclude), TypeCorrector(exclude=exclude), DatetimeExpander(exclude=exclude),
                     OutlierCapper(exclude=exclude), SkewFixer(exclude=exclude), Imputer(exclude=exclude)):
            scope = add(step, scope)
        target = targets[0] if len(targets) == 1 else None
        scope = add(Encoder(target=target, exclude=exclude), scope)
        onehot = {f"{x}_{v}" for x, r in stages[-1]["rules"].items() if r["kind"] == "onehot" for v in r["values"][1:]}
        cols = [x for x in numeric_columns(scope, exclude) if x not in onehot]
        scope = add(FeatureSelector(columns=cols), scope)
        cols = [x for x in cols if x in scope.columns]
        if self.fit_scope == "all":
            scope = PipelineModel(stages).transform(train_rows)
        scope = add(Scaler(columns=cols), scope)
        model = PipelineModel(stages)
        out = model.transform(df)
        features = [x for x in out.columns if x not in exclude]
        train, test = (out.filter(F.col("split") == s).drop("split") for s in ("train", "test"))
        weights = None
        if task == "classification" and targets:
            advice = profile.imbalance_advice(train, targets[0]).first()
            log.append(("Class balance", advice["advice"], f"smallest share {advice['min_share']}",
                        "applied" if advice["imbalanced"] else "skipped"))
            if advice["imbalanced"]:
                weights = balance.weights_by_class(train, targets[0])
                if self.apply_smote:
                    train = neighbors.smote(stage(train, "smote"), key, targets[0], features)
                    log.append(("Made rows", "classes filled up to the largest", "synthetic rows", "applied"))
        return Prepared(train, test, model, task, features, seen, log, weights)

    def _split(self, df, key, targets, task, log):
        if not targets:
            return df.withColumn("split", F.lit("train"))
        if self.is_time_series and self.date_col:
            how, out = "by time", split_time(df, self.date_col, key, self.test_size)
        elif task == "classification":
            how, out = "by class", stage(split_stratified(df, targets[0], key, self.test_size), "split")
        else:
            how, out = "by key hash", split_random(df, key, self.test_size)
        log.append(("Split", how, f"test share {self.test_size}", "applied"))
        return out


def simple_preprocess(df: DataFrame, target: str | None = None) -> tuple[DataFrame, dict]:
    """Second path: strict number test, median, z-score flag; other columns "unknown" and label codes; all scaled."""
    cols = [x for x in df.columns if x != target]
    bad = wide_agg(df, {x: F.count_if(c(x).isNotNull() & c(x).cast("string").try_cast("double").isNull()) for x in cols})
    nums = [x for x in cols if bad[x] == 0]
    cats = [x for x in cols if bad[x]]
    out = df.withColumns({x: c(x).cast("string").try_cast("double") for x in nums if x in string_columns(df)}
                         | {x: c(x).cast("double") for x in nums if x not in string_columns(df)})
    medians = exact_quantiles(out, {x: [0.5] for x in nums})
    known = wide_agg(out, {"*": F.count(F.lit(1)), **{x: F.count(c(x)) for x in nums}})
    gaps = [x for x in nums if known[x] < known["*"]]
    out = out.withColumns({x: F.coalesce(c(x), F.lit(medians[x][0])) for x in gaps})
    flags = profile.zscore_outlier_flags(out, nums)
    coder = Encoder(strategy="label", columns=cats, missing="unknown").fit(out)
    out = coder.transform(out)
    out = Scaler(strategy="standard", columns=cols).fit(out).transform(out)
    return out, {"columns_analyzed": len(df.columns), "numeric_columns": nums, "encoded_columns": cats,
                 "imputed_columns": gaps, "outlier_columns": [x for x, f in flags.items() if f]}
