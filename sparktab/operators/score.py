"""Batch scoring with a saved or live pipeline."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktab.functions.columns import c
from sparktab.operators.clean import drop_target_if_present
from sparktab.operators.models import decode_labels


def score_batch(df: DataFrame, model: PipelineModel | str, targets: list[str] | None = None,
                labels: list[str] | None = None) -> DataFrame:
    """Input rows plus `prediction` (and `predicted_label` for classifiers).

    The target may be among the inputs and is taken out. Any failure is an error.
    """
    if isinstance(model, str):
        model = PipelineModel.load(model)
    rows = drop_target_if_present(df, targets or [])
    # steps may rewrite or drop columns: the originals travel beside them
    out = model.transform(rows.withColumn("_given", F.struct(*[c(x) for x in rows.columns])))
    keep = [x for x in ("prediction", "probability") if x in out.columns]
    out = out.select("_given.*", *keep)
    return decode_labels(out, labels) if labels else out


def score_probabilities(scored: DataFrame, labels: list[str]) -> DataFrame:
    """One `proba_<class>` column per class in place of the probability vector."""
    p = vector_to_array("probability")
    return scored.withColumns({f"proba_{v}": F.get(p, F.lit(i)) for i, v in enumerate(labels)}).drop("probability")
