"""Experiment records as an append-only table: the newest version of an id counts.

Appends never rewrite files, so many jobs can record results at once. Deleting
appends a tombstone; `compact` rewrites the table with the live versions.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktab.functions.columns import c
from sparktab.functions.order import series_index
from sparktab.sources.io import _exists

SCHEMA = (
    "workspace_id string, created_at timestamp_ntz, updated_at timestamp_ntz, status string, dataset_name string,"
    " dataset_shape array<bigint>, target_col array<string>, task_type string,"
    " profile_summary struct<total_rows: bigint, total_columns: bigint>, preprocessing_steps array<struct<step: string,"
    " action: string, reason: string, status: string>>, recommendations array<string>,"
    " model_results map<string, double>, best_model string, best_score double, user_config map<string, string>,"
    " is_deleted boolean")
EVENTS = "workspace_id string, at timestamp_ntz, event string, description string, metadata map<string, string>"


def as_records(df: DataFrame) -> DataFrame:
    """Fill the record schema; absent fields become null."""
    empty = df.sparkSession.createDataFrame([], SCHEMA).schema
    return df.select(*[(c(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in empty])


class Experiments:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.table, self.events = spark, f"{root}/experiments", f"{root}/events"

    def append(self, records: DataFrame) -> None:
        """Store new versions of any number of records."""
        as_records(records).write.mode("append").parquet(self.table)

    def create(self, dataset_name: str | None = None, shape: tuple | None = None) -> str:
        wid, now = uuid.uuid4().hex[:8], dt.datetime.now()
        row = self.spark.createDataFrame(
            [(wid, now, now, "in-progress", dataset_name, list(shape or []))],
            "workspace_id string, created_at timestamp_ntz, updated_at timestamp_ntz, status string,"
            " dataset_name string, dataset_shape array<bigint>")
        self.append(row)
        self.add_event(wid, "workspace_created", "experiment opened")
        return wid

    def update(self, workspace_id: str, **fields) -> None:
        """Append a version with changed fields."""
        now = dt.datetime.now()
        cur = self.current().filter(F.col("workspace_id") == workspace_id)
        if cur.limit(1).count() == 0:
            raise KeyError(workspace_id)
        kinds = {f.name: f.dataType for f in cur.schema}
        row = self.spark.createDataFrame([(now, *fields.values())], ", ".join(
            ["updated_at timestamp_ntz", *[f"`{k}` {kinds[k].simpleString()}" for k in fields]])).first()
        self.append(cur.withColumns({k: F.lit(row[k]) if not isinstance(row[k], (dict, list)) else _lit(row[k])
                                     for k in ("updated_at", *fields)}))

    def current(self) -> DataFrame:
        """Newest version of each live record. A record has few versions, folded before the shuffle."""
        if not _exists(self.spark, self.table):
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(self.table)
        newest = rows.groupBy("workspace_id").agg(F.max_by(F.struct(*rows.columns), "updated_at").alias("r"))
        return newest.select("r.*").filter(~F.coalesce("is_deleted", F.lit(False)))

    def load(self, workspace_id: str) -> DataFrame:
        return self.current().filter(F.col("workspace_id") == workspace_id)

    def list(self) -> DataFrame:
        """Summaries, newest first."""
        return self.current().select(
            "workspace_id", F.coalesce("dataset_name", F.lit("Untitled")).alias("dataset_name"), "created_at",
            F.coalesce("task_type", F.lit("Unknown")).alias("task_type"), "status", "best_model", "best_score",
        ).orderBy(F.desc("created_at"), "workspace_id")

    def delete(self, ids: DataFrame, at: dt.datetime | None = None) -> None:
        """Tombstones for the ids of a (workspace_id) frame; unknown ids are ignored."""
        gone = self.current().join(ids.select("workspace_id").distinct(), "workspace_id", "left_semi")
        self.append(gone.withColumn("is_deleted", F.lit(True)).withColumn(
            "updated_at", F.lit(at or dt.datetime.now()).cast("timestamp_ntz")))

    def compact(self, target: str) -> None:
        self.current().write.mode("overwrite").parquet(target)

    def add_event(self, workspace_id: str, event: str, text: str, metadata: dict | None = None) -> None:
        row = (workspace_id, dt.datetime.now(), event, text, {k: str(v) for k, v in (metadata or {}).items()})
        self.spark.createDataFrame([row], EVENTS).write.mode("append").parquet(self.events)

    def timeline(self) -> DataFrame:
        return timeline(self.spark.read.schema(EVENTS).parquet(self.events), "workspace_id", ["at", "event"])


def _lit(v):
    if isinstance(v, dict):
        return F.create_map(*[F.lit(x) for kv in v.items() for x in kv])
    return F.array(*[F.lit(x) for x in v])


def timeline(events: DataFrame, key: str, order_by: list[str], **kw) -> DataFrame:
    """Events with their 0-based place per experiment, as rows: a long history is never one list."""
    return series_index(events, [key], order_by, "seq", **kw)


def list_models(models: DataFrame, key: str = "workspace_id", name: str = "model") -> DataFrame:
    """Distinct model names per experiment, sorted; the names of a catalogue are few."""
    pairs = models.select(c(key), c(name)).distinct()
    return pairs.groupBy(c(key)).agg(F.sort_array(F.collect_list(c(name))).alias("available_models"),
                                     F.count(F.lit(1)).alias("n_models"))
