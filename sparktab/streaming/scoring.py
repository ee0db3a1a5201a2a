"""Scoring of arriving JSON rows: the same model code as in batch, as a stream."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from sparktab.operators.score import score_batch


def score_stream(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str,
                 model: PipelineModel | str, targets: list[str] | None = None, labels: list[str] | None = None,
                 files_per_trigger: int = 1000, once: bool = True) -> StreamingQuery:
    """Read new JSON files, score, append parquet. Stateless, so no watermark is needed.

    File sink and checkpoint give each row exactly once, also over restarts.
    """
    rows = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(source))
    out = score_batch(rows, model, targets, labels)
    writer = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")
    return writer.outputMode("append").start()
