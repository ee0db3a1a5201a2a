"""Sources and sinks: CSV with repair of ragged rows, encodings, JSON rows, splits, models."""

from __future__ import annotations

import importlib
import json
from urllib.parse import quote

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktab.functions.columns import c

RAW = "_raw_row"
WINDOWS = "windows-1252"  # read as iso-8859-1, whose control characters 0x80 to 0x9F then become the symbols that stand there
_CONTROLS = "".join(chr(b) for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore"))
_SYMBOLS = _CONTROLS.encode("iso-8859-1").decode("cp1252")


def _options(encoding: str, multi_line: bool) -> dict:
    return {"header": True, "encoding": "iso-8859-1" if encoding == WINDOWS else encoding, "quote": '"', "escape": '"', "mode": "PERMISSIVE",
            "columnNameOfCorruptRecord": RAW, "multiLine": multi_line}


def _infer(spark: SparkSession, paths, encoding: str, multi_line: bool) -> T.StructType:
    schema = spark.read.options(**_options(encoding, multi_line), inferSchema=True).csv(paths).schema
    name = lambda n: n.translate(str.maketrans(_CONTROLS, _SYMBOLS)) if encoding == WINDOWS else n
    return T.StructType([T.StructField(name(f.name), f.dataType) for f in schema if f.name != RAW])


def _common(schemas: list[T.StructType]) -> T.StructType:
    """One schema over files read apart: equal types stay, whole numbers widen, numbers become double, all else text."""
    def kind(types: list[T.DataType]) -> T.DataType:
        if all(t == types[0] for t in types):
            return types[0]
        if all(isinstance(t, (T.IntegerType, T.LongType)) for t in types):
            return T.LongType()
        return T.DoubleType() if all(isinstance(t, (T.IntegerType, T.LongType, T.DoubleType)) for t in types) else T.StringType()

    by: dict[str, list[T.DataType]] = {}
    for s in schemas:
        for f in s.fields:
            by.setdefault(f.name, []).append(f.dataType)
    return T.StructType([T.StructField(n, kind(t)) for n, t in by.items()])


def _csv(spark: SparkSession, paths, encoding: str, schema: T.StructType, multi_line: bool) -> DataFrame:
    opts = _options(encoding, multi_line)
    full = T.StructType(schema.fields + [T.StructField(RAW, T.StringType())])
    rows = spark.read.options(**opts).schema(full).csv(paths)
    # short and long rows both keep their text; only a long row fills one column more
    wide = T.StructType([T.StructField(f"f{i}", T.StringType()) for i in range(len(schema.fields) + 1)])
    probe = F.from_csv(c(RAW), wide.simpleString()[7:-1].replace(":", " "), {"nullValue": "\u0001", "quote": '"', "escape": '"'})
    # always true; without a field of the file in the condition Spark refuses a count, which reads no other column
    counted = F.coalesce(F.length(c(schema.fields[0].name).cast("string")), F.lit(0)) >= 0
    is_long = F.col(RAW).isNotNull() & probe[f"f{len(schema.fields)}"].isNotNull() & counted
    out = rows.filter(~is_long).drop(RAW)
    if encoding == WINDOWS:
        out = out.withColumns({f.name: F.translate(c(f.name), _CONTROLS, _SYMBOLS) for f in schema.fields if isinstance(f.dataType, T.StringType)})
    return out


def file_traits(spark: SparkSession, path) -> list[tuple[str, str, bool]]:
    """(file, encoding, has line breaks inside quotes) of each file.

    utf-16 by its mark, utf-8 when every line is valid, windows-1252 when there are bytes that iso-8859-1 keeps for
    control characters, else iso-8859-1. A break inside quotes leaves lines with an odd number of quotes. Lines are read as raw bytes in
    parallel splits; one row per file is left.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    raw = F.col("value").cast("binary")
    valid, mark = F.is_valid_utf8("value"), F.hex(F.substring(raw, 1, 2))
    found = lines.groupBy("file").agg(
        F.every(valid).alias("utf8"), F.bool_or(mark.isin("FFFE", "FEFF")).alias("marked"),
        F.bool_or(~valid & F.hex(raw).rlike("^(?:..)*[89][0-9A-F]")).alias("symbols"),
        F.bool_or(F.regexp_count("value", F.lit('"')) % 2 == 1).alias("broken"))
    kind = (F.when(F.col("marked"), "utf-16").when(F.col("utf8"), "utf-8").when(F.col("symbols"), "windows-1252").otherwise("iso-8859-1"))
    return [tuple(r) for r in found.select("file", kind, F.col("broken") | F.col("marked")).collect()]


def resolve_encoding(spark: SparkSession, path) -> dict[str, list[str]]:
    """Files by encoding: utf-8, utf-16, windows-1252 or iso-8859-1."""
    out: dict[str, list[str]] = {}
    for file, kind, _ in file_traits(spark, path):
        out.setdefault(kind, []).append(file)
    return out


def read_csv(spark: SparkSession, path, schema: T.StructType | None = None, encoding: str | None = None,
             multi_line: bool | None = None) -> DataFrame:
    """Header CSV. Rows with too many fields are left out, short rows are padded with null.

    Line breaks inside quotes belong to the field. Only files that have some are read as one split each; all others are split
    by size. `encoding` and `multi_line` are found per file unless given. Types are inferred once over all files.
    """
    if encoding and multi_line is not None:
        groups = {(encoding, multi_line): path}
    else:
        groups = {}
        for file, kind, broken in sorted(file_traits(spark, path)):
            groups.setdefault((encoding or kind, broken if multi_line is None else multi_line), []).append(file)
        groups = dict(sorted(groups.items()))
    if schema is None:
        schema = _common([_infer(spark, files, e, m) for (e, m), files in groups.items()])
    parts = [_csv(spark, files, e, schema, m) for (e, m), files in groups.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def from_dataframe(spark: SparkSession, source: DataFrame | str) -> DataFrame:
    return source if isinstance(source, DataFrame) else spark.table(source)


def from_json_rows(df: DataFrame, column: str, schema: str, strict: bool = True) -> DataFrame:
    """One JSON object per row to typed columns; a bad payload is an error when strict."""
    mode = "FAILFAST" if strict else "PERMISSIVE"
    return df.withColumn("_j", F.from_json(c(column), schema, {"mode": mode})).select(
        *[c(x) for x in df.columns if x != column], "_j.*")


def export_splits(df: DataFrame, path: str, fmt: str = "parquet", split_col: str = "split") -> None:
    writer = df.write.mode("overwrite").partitionBy(split_col)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def save_dataset(df: DataFrame, root: str, workspace_id: str) -> None:
    df.write.mode("overwrite").parquet(f"{root}/dataset/workspace_id={quote(workspace_id)}")


def load_dataset(spark: SparkSession, root: str, workspace_id: str) -> DataFrame | None:
    path = f"{root}/dataset/workspace_id={quote(workspace_id)}"
    return spark.read.parquet(path) if _exists(spark, path) else None


def save_splits(df: DataFrame, root: str, workspace_id: str, split_col: str = "split") -> None:
    """Features, labels and the split column in one table, partitioned by the split."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(f"{root}/splits/workspace_id={quote(workspace_id)}")


def load_splits(spark: SparkSession, root: str, workspace_id: str) -> DataFrame | None:
    path = f"{root}/splits/workspace_id={quote(workspace_id)}"
    return spark.read.parquet(path) if _exists(spark, path) else None


def save_pipeline(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_models(spark: SparkSession, models: dict, path: str) -> None:
    """One directory per model and an index table; a failing write is an error."""
    rows = []
    for name, m in models.items():
        m.write().overwrite().save(f"{path}/models/{quote(name, safe='')}")
        kind = type(m)
        rows.append((name, kind.__module__, kind.__name__))
    spark.createDataFrame(rows, "name string, module string, class string").coalesce(1).write.mode("overwrite").json(f"{path}/index")


def list_saved_models(spark: SparkSession, path: str) -> list[str]:
    if not _exists(spark, f"{path}/index"):
        return []
    return sorted(r["name"] for r in spark.read.json(f"{path}/index").select("name").collect())


def load_models(spark: SparkSession, path: str, names: list[str] | None = None) -> dict:
    out = {}
    if not _exists(spark, f"{path}/index"):
        return out
    for r in spark.read.json(f"{path}/index").collect():
        if names is None or r["name"] in names:
            kind = getattr(importlib.import_module(r["module"]), r["class"])
            out[r["name"]] = kind.load(f"{path}/models/{quote(r['name'], safe='')}")
    return out


def rows_to_json(rows: list[dict]) -> list[str]:
    return [json.dumps(r) for r in rows]
