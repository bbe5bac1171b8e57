"""Views over the given parquet tables.

The rating fixture is ``lineitem`` joined to ``orders`` on the order key:
a customer "rates" a part with ``ceil(l_quantity / 10)`` (1..5) at the
order date. Items come from ``part``. Only the columns used are selected,
so the parquet scans read a pruned schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATING_COLS = ["user_id", "item_id", "rating", "ts"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return li.join(od, li.l_orderkey == od.o_orderkey, "inner")


def ratings_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item_id, rating, ts, l_orderkey, l_linenumber); every line."""
    return _order_lines(spark, sf_dir).select(
        F.col("o_custkey").cast("long").alias("user_id"),
        F.col("l_partkey").cast("long").alias("item_id"),
        F.ceil(F.col("l_quantity") / F.lit(10.0)).cast("double").alias("rating"),
        F.unix_timestamp(F.col("o_orderdate")).cast("long").alias("ts"),
        F.col("l_orderkey").cast("long").alias("l_orderkey"),
        F.col("l_linenumber").cast("int").alias("l_linenumber"),
    )


def items_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, title, genres array<string>) from ``part``."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    return p.select(
        F.col("p_partkey").cast("long").alias("item_id"),
        F.col("p_name").alias("title"),
        F.array(F.col("p_type"), F.col("p_brand")).alias("genres"),
    )


def book_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Book-style ratings (user_id, isbn, rating int 0..10; 0 = implicit).

    isbn is the part key zero-padded to 10 characters; the rating is
    ``l_quantity mod 11`` so that implicit (0) ratings occur.
    """
    return _order_lines(spark, sf_dir).select(
        F.col("o_custkey").cast("long").alias("user_id"),
        F.lpad(F.col("l_partkey").cast("string"), 10, "0").alias("isbn"),
        F.pmod(F.col("l_quantity").cast("int"), F.lit(11)).alias("rating"),
        F.col("l_orderkey").cast("long").alias("l_orderkey"),
        F.col("l_linenumber").cast("int").alias("l_linenumber"))


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, line): every line of every document, whole texts."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", F.posexplode(F.split(F.col("text"), "\n", -1))
                    .alias("line_no", "line"))
