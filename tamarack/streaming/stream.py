"""Detection on streams: stateless, so the plan of a batch holds for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.engine import RuleSet, detect
from ..sources.events import MAX_LINE_BYTES, flatten_lines
from ..sources.flatten import FlattenOptions


def json_stream(spark: SparkSession, path: str, options: FlattenOptions = FlattenOptions(), max_line_bytes: int = MAX_LINE_BYTES, max_files: int = 100) -> DataFrame:
    """A folder of JSON lines as a stream of flat events. Ids are hashes of the lines, as a stream's lines have no number; equal lines share an id."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    return flatten_lines(lines.select(F.xxhash64("value").alias("event_id"), F.col("value").cast("binary").alias("value")), options, max_line_bytes)


def detect_stream(events: DataFrame, rules: RuleSet, key: str = "event_id") -> DataFrame:
    """Alerts of a stream of events, in append mode and without state."""
    return detect(events.filter("error is null") if "error" in events.columns else events, rules, key)


def start(alerts: DataFrame, path: str, checkpoint: str, every: str = "10 seconds", once: bool = False) -> StreamingQuery:
    """Writes alerts as Parquet; after a restart it goes on from the checkpoint, each alert once."""
    writer = alerts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
