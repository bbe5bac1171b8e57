"""Stream sources and scoring (stream-static joins, running aggregates)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import RATING_SCHEMA, good_rows, parse_lines


def read_rating_stream(spark: SparkSession, path: str, sep: str = "::",
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming twin of ``read_ratings``: the same rows of the same files."""
    r = spark.readStream
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return good_rows(parse_lines(r.text(path), RATING_SCHEMA, sep))


def score_stream(stream: DataFrame, user_f: DataFrame, item_f: DataFrame,
                 mu: float, biased: bool = True) -> DataFrame:
    """Predictions for each arriving rating; unknown ids fall back to mu.

    The factor tables are static; each micro-batch joins against them
    (Spark picks broadcast or shuffle per batch from their sizes).
    """
    from ..plans.evaluate import score
    # k only sizes explicit broadcast checks; with no counts given the
    # join choice is Spark's own.
    return score(stream, user_f, item_f, mu, 0, biased=biased)


def running_rmse(scored: DataFrame) -> DataFrame:
    """Complete-mode aggregate: count and RMSE over everything seen."""
    return scored.agg(F.count(F.lit(1)).alias("n"),
                      F.sqrt(F.avg(F.pow(F.col("rating") - F.col("prediction"), 2)))
                       .alias("rmse"))
