"""Rules from folders."""

from __future__ import annotations

import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.engine import RuleSet

ENDINGS = (".yml", ".yaml")


def paths_in(folder: str, recursive: bool = False) -> list[Path]:
    found = Path(folder).rglob("*") if recursive else Path(folder).iterdir()
    return sorted(p for p in found if p.suffix in ENDINGS and p.is_file())


def load_folder(folder: str, recursive: bool = False, rules: RuleSet | None = None) -> tuple[RuleSet, int, int, float]:
    """The rules, how many loaded, how many were skipped, and milliseconds."""
    began, rules = time.perf_counter(), rules or RuleSet()
    ids, errors = rules.load_rules("\n---\n".join(p.read_text(encoding="utf-8") for p in paths_in(folder, recursive)))
    return rules, len(ids), len(errors), (time.perf_counter() - began) * 1000


def load_report(spark: SparkSession, folder: str) -> DataFrame:
    """What does not load in a tree of rules: category, n, and at most three examples each."""
    rows = []
    for path in paths_in(folder, recursive=True):
        _, errors = RuleSet().load_rules(path.read_text(encoding="utf-8", errors="replace"))
        rows += [(e.kind, f"{path}: {e}") for e in errors]
    failures = spark.createDataFrame(rows, "category string, example string")
    return failures.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_list("example")), 1, 3).alias("examples")).orderBy(F.desc("n"), "category")
