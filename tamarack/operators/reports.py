"""Reports over alerts, and comparison of sets of hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_rule(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("rule_idx", "rule_id", "rule_title").agg(F.count(F.lit(1)).alias("n"))


def per_level(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("rule_level").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("score"))


def top_rules(alerts: DataFrame, k: int) -> DataFrame:
    return per_rule(alerts).orderBy(F.desc("n"), "rule_idx").limit(k)


def compare_hits(hits: dict[str, DataFrame], key: str = "event_id") -> DataFrame:
    """Where engines' hits (key, rule_idx) differ: key, rule_idx and a flag for each engine."""
    flags = [df.select(key, "rule_idx").distinct().withColumn(name, F.lit(True)) for name, df in hits.items()]
    both = reduce(lambda a, b: a.join(b, [key, "rule_idx"], "full"), flags)
    filled = both.select(key, "rule_idx", *(F.coalesce(n, F.lit(False)).alias(n) for n in hits))
    return filled.filter(reduce(lambda a, b: a | b, [F.col(n) != F.col(next(iter(hits))) for n in hits]))


def disagreements(hits: dict[str, DataFrame], key: str = "event_id") -> DataFrame:
    """How many events each rule's engines differ on."""
    return compare_hits(hits, key).groupBy("rule_idx").agg(F.count(F.lit(1)).alias("n"))


def common_rules(loaded: dict[str, DataFrame]) -> DataFrame:
    """rule_idx of the rules that all engines loaded."""
    return reduce(DataFrame.intersect, [df.select("rule_idx") for df in loaded.values()])


def loaded_counts(loaded: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("engine"), "n") for name, df in loaded.items()])


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).unionByName(b.exceptAll(a))
