"""Plain-text scan: lines and the count of lines holding a needle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def count_lines(lines: DataFrame, needles: dict[str, str]) -> DataFrame:
    """One row: ``n_lines`` and, per output name, lines containing the needle.

    A single aggregate (partial counts per task, one tiny merge).
    """
    aggs = [F.count(F.lit(1)).alias("n_lines")]
    for name, needle in needles.items():
        aggs.append(F.coalesce(F.sum(F.when(F.col("line").contains(needle), 1).otherwise(0)),
                               F.lit(0)).cast("long").alias(name))
    return lines.agg(*aggs)
