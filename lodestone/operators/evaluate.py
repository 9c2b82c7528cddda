"""Detector evaluation against truth, and comparison of detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate(truth: DataFrame, found: DataFrame, keys: list[str], by: str = "entity") -> DataFrame:
    """(by, tp, fp, fn, precision, recall, f1): truth and found hold keys and by; a repeated row counts once."""
    cols = [*keys, by]
    a, b = truth.select(*cols).distinct().withColumn("in_truth", F.lit(True)), found.select(*cols).distinct().withColumn("in_found", F.lit(True))
    both = a.join(b, cols, "full_outer")
    sums = both.groupBy(by).agg(F.count_if(F.col("in_truth") & F.col("in_found")).alias("tp"), F.count_if(F.col("in_truth").isNull()).alias("fp"), F.count_if(F.col("in_found").isNull()).alias("fn"))
    share = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    return sums.withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn")), "f1": share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def compare_detectors(findings: DataFrame) -> DataFrame:
    """findings(engine, column, entity, confidence) as one row for each column and entity with each engine's confidence."""
    return findings.groupBy("column", "entity").pivot("engine").agg(F.max("confidence"))
