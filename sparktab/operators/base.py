"""Fitted steps: estimators and models whose state is plain JSON values."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame


class _Valued(Params, DefaultParamsReadable, DefaultParamsWritable):
    """Keeps all settings or fitted values in one JSON-able parameter."""

    defaults: dict = {}

    def __init__(self, **values):
        super().__init__()
        self.values = Param(self, "values", "plain settings or fitted values")
        unknown = set(values) - set(self.defaults)
        if unknown:
            raise TypeError(f"unknown settings {sorted(unknown)}")
        self._set(values={**self.defaults, **values})

    def __getitem__(self, name: str):
        return self.getOrDefault(self.values)[name]


class Step(_Valued, Estimator):
    """fit(df) makes one or a few passes of statistics and returns a Fitted."""

    def _fit(self, dataset: DataFrame) -> Model:
        return self.learn(dataset)


class Fitted(_Valued, Model):
    """transform(df) is made of column expressions and lookups only."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.apply(dataset)

    def log(self) -> list[tuple[str, str, str, str]]:
        """(step, action, reason, status) of what was fitted."""
        return []
