"""Rating, item and book-rating file sources, and their fixtures.

Readers take an explicit schema (nothing is inferred) and keep bad lines
apart instead of failing the job. Every input line is either good or
rejected, with a reason: a wrong field count, a field that does not parse,
or an empty required field. ``mode="FAILFAST"`` raises on the first
malformed line instead.

The fixture writers turn the table views into files of the original
layouts, inside the session's shared folder, so the readers are exercised
on data derived from the given tables.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash_bucket, key
from ..session import read_or_build, scratch_path
from .tables import book_view, items_view, ratings_view

CORRUPT = "_corrupt_record"
RATING_SCHEMA = "user_id long, item_id long, rating double, ts long"
ITEM_SCHEMA = "item_id long, title string, genres_text string"
BOOK_SCHEMA = "user_id long, isbn string, rating int"

# Share of fixture lines turned bad, in percent per kind.
BAD_SHORT_BUCKET = 0      # ts field dropped -> 3 fields
BAD_NUMBER_BUCKET = 1     # rating replaced by the word "five"
BAD_EMPTY_BUCKET = 2      # rating left empty
BAD_BUCKETS = 100


def parse_lines(lines: DataFrame, schema: str, sep: str, quote: str | None = None,
                mode: str = "PERMISSIVE") -> DataFrame:
    """``lines(value)`` parsed by ``schema``: its columns, the whole ``line``,
    its number of fields and the corrupt-record column."""
    options = {"sep": sep, "mode": mode, "columnNameOfCorruptRecord": CORRUPT}
    if quote is not None:
        options |= {"quote": quote, "escape": quote}
    full = schema if mode == "FAILFAST" else schema + f", {CORRUPT} string"
    out = lines.select(F.col("value").alias("line"),
                       F.from_csv("value", full, options).alias("_row"))
    out = out.select("_row.*", "line")
    if mode == "FAILFAST":
        out = out.withColumn(CORRUPT, F.lit(None).cast("string"))
    return out


def _csv(spark: SparkSession, path: str, schema: str, sep: str, quote: str | None,
         mode: str) -> DataFrame:
    return parse_lines(spark.read.text(path), schema, sep, quote, mode)


def is_good(df: DataFrame):
    """A parsed line without corrupt record and without an empty field."""
    ok = F.col(CORRUPT).isNull()
    for c in df.columns:
        if c not in (CORRUPT, "line"):
            ok = ok & F.col(c).isNotNull()
    return ok


def good_rows(df: DataFrame) -> DataFrame:
    return df.where(is_good(df)).drop(CORRUPT, "line")


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected lines) of parsed lines; together, every line."""
    return good_rows(df), df.where(~is_good(df)).select("line", CORRUPT)


def read_ratings_raw(spark: SparkSession, path: str, sep: str = "::",
                     mode: str = "PERMISSIVE") -> DataFrame:
    return _csv(spark, path, RATING_SCHEMA, sep, None, mode)


def read_ratings(spark: SparkSession, path: str, sep: str = "::",
                 mode: str = "PERMISSIVE") -> DataFrame:
    """``user::item::rating::ts`` lines -> (user_id, item_id, rating, ts)."""
    return good_rows(read_ratings_raw(spark, path, sep, mode))


def read_items(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """``id,"title","g1|g2"`` lines -> (item_id, title, genres array)."""
    good = good_rows(_csv(spark, path, ITEM_SCHEMA, ",", '"', mode))
    return good.select("item_id", "title",
                       F.split(F.col("genres_text"), r"\|").alias("genres"))


def read_book_ratings_raw(spark: SparkSession, path: str,
                          mode: str = "PERMISSIVE") -> DataFrame:
    return _csv(spark, path, BOOK_SCHEMA, ";", '"', mode)


def read_book_ratings(spark: SparkSession, path: str,
                      mode: str = "PERMISSIVE") -> DataFrame:
    """``"user";"isbn";"rating"`` lines -> (user_id, isbn, rating)."""
    return good_rows(read_book_ratings_raw(spark, path, mode))


def reject_reasons(bad: DataFrame, sep: str, n_fields: int) -> DataFrame:
    """Why each line was rejected: ``field_count``, ``parse`` (a field does
    not parse) or ``null_field`` (a required field is empty)."""
    n = F.size(F.split(F.col("line"), F.lit("\\Q" + sep + "\\E"), -1))
    return bad.withColumn("reason", F.when(n != F.lit(n_fields), F.lit("field_count"))
                          .when(F.col(CORRUPT).isNotNull(), F.lit("parse"))
                          .otherwise(F.lit("null_field")))


# ---- fixtures ------------------------------------------------------------

def _tag(sf_dir: str) -> str:
    return hashlib.md5(sf_dir.rstrip("/").encode()).hexdigest()[:10]


def bad_kind(df: DataFrame) -> DataFrame:
    return df.withColumn("_bad", hash_bucket(
        key("bad", "@l_orderkey", "@l_linenumber", "@item_id", "@user_id"), BAD_BUCKETS))


def rating_lines_path(spark: SparkSession, sf_dir: str) -> str:
    """The ratings view written as ``::`` text with some bad lines."""
    path = scratch_path(spark, f"rating-lines-{_tag(sf_dir)}")

    def build(p):
        v = bad_kind(ratings_view(spark, sf_dir))
        u, i = F.col("user_id").cast("string"), F.col("item_id").cast("string")
        r, t = F.col("rating").cast("string"), F.col("ts").cast("string")
        line = (F.when(F.col("_bad") == BAD_SHORT_BUCKET, F.concat_ws("::", u, i, r))
                 .when(F.col("_bad") == BAD_NUMBER_BUCKET, F.concat_ws("::", u, i, F.lit("five"), t))
                 .when(F.col("_bad") == BAD_EMPTY_BUCKET, F.concat_ws("::", u, i, F.lit(""), t))
                 .otherwise(F.concat_ws("::", u, i, r, t)))
        v.select(line.alias("value")).write.mode("overwrite").text(p)

    read_or_build(spark, path, build)
    return path


def item_lines_path(spark: SparkSession, sf_dir: str) -> str:
    """Items as quoted CSV; titles keep their commas."""
    path = scratch_path(spark, f"item-lines-{_tag(sf_dir)}")

    def build(p):
        v = items_view(spark, sf_dir).select(
            "item_id", "title", F.array_join("genres", "|").alias("genres_text"))
        v.write.mode("overwrite").option("quoteAll", "true").option("escape", '"').csv(p)

    read_or_build(spark, path, build)
    return path


def book_lines_path(spark: SparkSession, sf_dir: str) -> str:
    """Book ratings as ``"user";"isbn";"rating"``."""
    path = scratch_path(spark, f"book-lines-{_tag(sf_dir)}")

    def build(p):
        v = book_view(spark, sf_dir).select("user_id", "isbn", "rating")
        v.write.mode("overwrite").option("sep", ";").option("quoteAll", "true").csv(p)

    read_or_build(spark, path, build)
    return path
