"""Category encoders: label, one-hot, target mean, frequency, chosen by cardinality."""

from __future__ import annotations

from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparktab.functions.aggregate import wide_agg
from sparktab.functions.columns import c, dbl, numeric_columns, string_columns
from sparktab.functions.lookup import lookup
from sparktab.functions.order import with_position
from sparktab.functions.staging import stage_path
from sparktab.operators.base import Fitted, Step

MISSING = "__MISSING__"
LABEL_MAX, ONEHOT_MAX, TARGET_MAX = 2, 10, 100
LITERAL_MAX = 200  # categories held as literals; above that a mapping table


def choose_encoding(n_unique: int) -> str:
    if n_unique <= LABEL_MAX:
        return "label"
    if n_unique <= ONEHOT_MAX:
        return "onehot"
    return "target" if n_unique <= TARGET_MAX else "frequency"


def filled(name: str) -> Column:
    return F.coalesce(c(name).cast("string"), F.lit(MISSING))


def fill_missing_category(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({x: filled(x) for x in columns})


def distinct_counts(df: DataFrame, columns: list[str], exact_below: int = TARGET_MAX) -> dict[str, int]:
    """Distinct non-null values; exact near the limits, approximate far above them."""
    near = wide_agg(df, {x: F.approx_count_distinct(c(x)) for x in columns})
    low = [x for x in columns if near[x] <= 2 * exact_below]
    return {**near, **wide_agg(df, {x: F.count_distinct(c(x)) for x in low}, width=20)}


class Encoder(Step):
    """`strategy` forces one encoding; None chooses by cardinality. Targets must be numeric."""

    defaults = {"strategy": None, "target": None, "columns": None, "exclude": [], "missing": MISSING}

    def learn(self, df):
        cols = self["columns"] or string_columns(df, list(self["exclude"]) + [self["target"]])
        target = self["target"] if self["target"] in numeric_columns(df) else None
        sizes = distinct_counts(df, cols)
        rules, tables = {}, {}
        if not cols:
            return EncoderModel(rules=rules, tables=tables, missing=self["missing"])
        total, default = df.agg(F.count(F.lit(1)), F.avg(dbl(target)) if target else F.lit(None).cast("double")).first()
        total = float(max(total, 1))
        y = dbl(target) if target else F.lit(None).cast("double")
        kinds = {x: self["strategy"] or choose_encoding(sizes[x]) for x in cols}
        kinds = {x: "frequency" if k == "target" and target is None else k for x, k in kinds.items()}
        held = [x for x in cols if kinds[x] == "onehot" or sizes[x] + 1 <= LITERAL_MAX]
        groups: dict[str, dict] = {x: {} for x in held}
        if held:  # all columns with few values in one grouped pass
            cells = F.array(*[F.struct(F.lit(x).alias("column"), self._category(x).alias("value")) for x in held])
            seen = (df.select(y.alias("_y"), F.inline(cells)).groupBy("column", "value")
                    .agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("code")))
            for r in seen.collect():
                groups[r["column"]][r["value"]] = r
        for x in cols:
            kind, rule = kinds[x], {"kind": kinds[x], "n": sizes[x]}
            if kind == "target":
                rule["default"] = default
            if x in groups:
                got = groups[x]
                names = sorted(got)
                if kind == "target":
                    rule["map"] = {v: default if got[v]["code"] is None else got[v]["code"] for v in names}
                elif kind == "frequency":
                    rule["map"] = {v: got[v]["n"] / total for v in names}
                else:
                    rule["values"] = names
            else:
                table = df.groupBy(self._category(x).alias("value")).agg(
                    F.avg(y).alias("code"), (F.count(F.lit(1)) / total).alias("share"))
                if kind == "label":
                    table = with_position(table, ["value"], "code").withColumn("code", F.col("code").cast("int"))
                elif kind == "frequency":
                    table = table.withColumn("code", F.col("share"))
                path = stage_path(df.sparkSession, "mapping")
                table.select("value", "code", "share").write.parquet(path)
                tables[x] = path
                rule["rows"] = df.sparkSession.read.parquet(path).count()
            rules[x] = rule
        return EncoderModel(rules=rules, tables=tables, missing=self["missing"])

    def _category(self, name: str) -> Column:
        return F.coalesce(c(name).cast("string"), F.lit(self["missing"]))


class _TableWriter(DefaultParamsWriter):
    def saveImpl(self, path):
        model = self.instance
        spark = SparkSession.getActiveSession()
        for i, table in enumerate(model["tables"].values()):
            spark.read.parquet(table).write.parquet(f"{path}/tables/{i}")
        super().saveImpl(path)


class _TableReader(DefaultParamsReader):
    def load(self, path):
        model = super().load(path)
        values = dict(model.getOrDefault(model.values))
        values["tables"] = {x: f"{path}/tables/{i}" for i, x in enumerate(values["tables"])}
        model._set(values=values)
        return model


class EncoderModel(Fitted):
    defaults = {"rules": {}, "tables": {}, "missing": MISSING}

    def write(self):
        return _TableWriter(self)

    @classmethod
    def read(cls):
        return _TableReader(cls)

    def apply(self, df):
        out, gone = {}, []
        for x, rule in self["rules"].items():
            if x not in df.columns or x in self["tables"]:
                continue
            cat = F.coalesce(c(x).cast("string"), F.lit(self["missing"]))
            if rule["kind"] == "onehot":
                out |= {f"{x}_{v}": (cat == v).cast("int") for v in rule["values"][1:]}
                gone.append(x)
            elif rule["kind"] == "label":
                out[x] = _by_value(cat, {v: i for i, v in enumerate(rule["values"])}, -1)
            else:
                out[x] = _by_value(cat, rule["map"], rule.get("default", 0.0))
        df = df.withColumns(out).drop(*gone)
        for x, path in self["tables"].items():
            if x not in df.columns:
                continue
            rule, order = self["rules"][x], df.columns
            miss = -1 if rule["kind"] == "label" else rule.get("default", 0.0)
            mapping = df.sparkSession.read.parquet(path)
            df = df.withColumn(x, F.coalesce(c(x).cast("string"), F.lit(self["missing"])))
            df = lookup(df, mapping.withColumnRenamed("code", "_code"), x, ["_code"],
                        "share", rule["rows"], right_key="value")
            df = df.withColumn(x, F.coalesce(F.col("_code"), F.lit(miss))).select(*[c(n) for n in order])
        return df

    def log(self):
        return [("Encoding", f"{r['kind']} encode {x}", f"{r['n']} distinct values", "applied")
                for x, r in self["rules"].items()]


def _by_value(cat: Column, mapping: dict, default) -> Column:
    col = None
    for v, code in mapping.items():
        col = F.when(cat == v, F.lit(code)) if col is None else col.when(cat == v, F.lit(code))
    return F.lit(default) if col is None else col.otherwise(F.lit(default))
