"""Alerts as lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAN = ["matched_identifiers", "rule_id", "rule_level", "rule_title", "score", "tags"]


def ndjson(alerts: DataFrame, include_event: bool = False, event: str = "event") -> DataFrame:
    """event_id, rule_idx and value: a JSON object with sorted keys; with the event under `event` on request."""
    names = sorted(LEAN + (["event"] if include_event else []))
    line = F.to_json(F.struct(*((F.col(event) if n == "event" else F.col(n)).alias(n) for n in names)))
    return alerts.select("event_id", "rule_idx", line.alias("value"))


def text(alerts: DataFrame) -> DataFrame:
    return alerts.select("event_id", "rule_idx", text_line().alias("value"))


def text_line() -> Column:
    return F.concat_ws(" ", "rule_level", "rule_id", "rule_title")


def ordered(lines: DataFrame) -> DataFrame:
    """Lines by event and rule, alike for any number of partitions."""
    return lines.orderBy("event_id", "rule_idx").select("value")


def write(lines: DataFrame, path: str, mode: str = "error") -> None:
    """Text files whose names are in the order of their lines."""
    ordered(lines).write.mode(mode).text(path)
