"""Events: JSON lines with exact accounting, tables, and maps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FlattenError
from .flatten import FlattenOptions, flatten_text, multimap

MAX_LINE_BYTES = 16 << 20
ERRORS = ("io_read", "line_too_large", "json_parse", "flatten_not_object", "flatten_depth", "flatten_fields")
FLAT = "event_id long, event map<string,string>, fields map<string,array<string>>, error string"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """event_id (the number of the line in order of files and places, from 1) and value (bytes), blank lines included."""
    lines = spark.read.format("text").load(path).select(F.col("value").cast("binary").alias("value"))
    numbered = lines.rdd.zipWithIndex().map(lambda x: (x[1] + 1, x[0]["value"]))
    return spark.createDataFrame(numbered, "event_id long, value binary")


def lines_of(df: DataFrame, text: str = "value", key: str = "event_id") -> DataFrame:
    return df.select(F.col(key).cast("long").alias("event_id"), F.col(text).cast("binary").alias("value"))


def flatten_lines(lines: DataFrame, options: FlattenOptions = FlattenOptions(), max_line_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """(event_id, value) to FLAT. Blank lines are dropped; others have an error, or their fields. Works on streams too."""

    def one(line: bytes) -> tuple[dict | None, dict | None, str | None] | None:
        try:
            text = line.decode("utf-8").strip()
        except UnicodeDecodeError:
            return None, None, "json_parse"
        if not text:
            return None
        if len(text.encode()) > max_line_bytes:
            return None, None, "line_too_large"
        try:
            flat = flatten_text(text, options)
        except FlattenError as error:
            return None, None, error.kind
        clean = {k.encode("utf-8", "replace").decode(): v.encode("utf-8", "replace").decode() for k, v in flat.items()}
        return clean, multimap(clean), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, r) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (r := one(v or b"")) is not None]
            event = pa.map_(pa.string(), pa.string())
            fields = pa.map_(pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([
                pa.array([i for i, _ in found], pa.int64()),
                pa.array([None if r[0] is None else list(r[0].items()) for _, r in found], event),
                pa.array([None if r[1] is None else list(r[1].items()) for _, r in found], fields),
                pa.array([r[2] for _, r in found], pa.string()),
            ], ["event_id", "event", "fields", "error"])

    return lines.select("event_id", "value").mapInArrow(run, FLAT)


def accounting(flat: DataFrame) -> DataFrame:
    """One row: events_total, events_ok, events_failed, a count for each kind of error, flatten_total."""
    kinds = [F.count_if(F.coalesce(F.col("error") == k, F.lit(False))).alias(k) for k in ERRORS]
    flattening = F.count_if(F.coalesce(F.col("error").startswith("flatten_"), F.lit(False)))
    return flat.agg(F.count(F.lit(1)).alias("events_total"), F.count_if(F.col("error").isNull()).alias("events_ok"), F.count_if(F.col("error").isNotNull()).alias("events_failed"), *kinds, flattening.alias("flatten_total"))


def check_accounting(row: dict) -> None:
    if row["events_total"] != row["events_ok"] + row["events_failed"] or row["events_failed"] != sum(row[k] for k in ERRORS):
        raise AssertionError(f"the counts of events do not add up: {row}")


def error_samples(flat: DataFrame, n: int) -> DataFrame:
    """The first n errors in order of the line."""
    return flat.filter("error is not null").select("event_id", "error").orderBy("event_id").limit(n)


def from_maps(df: DataFrame, column: str = "event", key: str = "event_id") -> DataFrame:
    """A map of text to the layout of arrays by lower-case key."""
    entries = F.array_sort(F.map_entries(column))
    keys = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    values = lambda k: F.transform(F.filter(entries, lambda e: F.lower(e["key"]) == k), lambda e: e["value"])
    return df.select(key, column, F.map_from_arrays(keys, F.transform(keys, values)).alias("fields"))


def from_table(df: DataFrame, key: str = "event_id") -> DataFrame:
    """Columns to the map layout; null columns are absent fields."""
    names = [c for c in df.columns if c != key]
    entries = F.array(*(F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("string").alias("value")) for c in names))
    present = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    return from_maps(df.select(key, present.alias("event")), "event", key)
