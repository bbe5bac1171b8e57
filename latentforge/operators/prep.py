"""Cleaning, splitting, ordering and reshaping of rating tables.

Everything is a DataFrame expression; the per-user jobs and driver-side
maps of the original programs become one grouped aggregate or join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_bucket, hash_int, key
from ..functions.ranking import global_position
from .chunks import ROWS_PER_RANGE, chunked

# 80/20 split by hash bucket out of 10, default seed 0.
SPLIT_BUCKETS = 10
TRAIN_BUCKETS = 8
DEFAULT_SEED = 0
# Total order for "last rating wins" among repeated (user, item) pairs.
LAST_WINS_ORDER = ["ts", "l_orderkey", "l_linenumber", "rating"]


# ---- filters ------------------------------------------------------------

def explicit_ratings(df: DataFrame, col: str = "rating") -> DataFrame:
    """Drop implicit feedback (rating 0)."""
    return df.where(F.col(col) > 0)


def user_ratings(df: DataFrame, user_id: int) -> DataFrame:
    return df.where(F.col("user_id") == F.lit(user_id))


def user_rating_stats(df: DataFrame) -> DataFrame:
    """All users at once: one grouped aggregate instead of a job per user."""
    return df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_ratings"),
                                     F.sum("rating").alias("rating_sum"),
                                     F.min("item_id").alias("min_item"),
                                     F.max("item_id").alias("max_item"))


def pair_lookup(pairs: DataFrame, ratings: DataFrame) -> DataFrame:
    """Look many (user, item) pairs up at once; absent pairs are flagged.

    ``ratings`` must hold at most one row per pair (see ``dedupe_ratings``),
    so no join key can be hot.
    """
    r = ratings.select("user_id", "item_id", F.col("rating").alias("found_rating"))
    return (pairs.join(r, ["user_id", "item_id"], "left")
                 .withColumn("found", F.col("found_rating").isNotNull()))


# ---- split and orderings --------------------------------------------------

def split_flag(seed: int = DEFAULT_SEED) -> Column:
    """True for the training side; a pure function of (seed, user, item)."""
    return hash_bucket(key("split", seed, "@user_id", "@item_id"), SPLIT_BUCKETS) \
        < F.lit(TRAIN_BUCKETS)


def train_test_split(df: DataFrame, seed: int = DEFAULT_SEED) -> tuple[DataFrame, DataFrame]:
    flag = split_flag(seed)
    return df.where(flag), df.where(~flag)


def random_split(df: DataFrame, seed: int = DEFAULT_SEED) -> tuple[DataFrame, DataFrame]:
    """Spark's own sampler; its rows depend on the input partitioning."""
    a, b = df.randomSplit([0.8, 0.2], seed)
    return a, b


def split_counts(df: DataFrame, seed: int = DEFAULT_SEED) -> DataFrame:
    return (df.withColumn("is_train", split_flag(seed))
              .groupBy("is_train")
              .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("rating").alias("rating_sum")))


def user_permutation(users: DataFrame, seed: int = DEFAULT_SEED) -> DataFrame:
    """(user_id, position): users in a seeded pseudo-random order."""
    u = users.select("user_id").distinct().withColumn(
        "_h", hash_int(key("perm", seed, "@user_id")))
    return global_position(u, ["_h", "user_id"], "position").drop("_h")


def interaction_order(pairs: DataFrame, seed: int = DEFAULT_SEED) -> DataFrame:
    """(user_id, item_id, position): every interaction, shuffled by seed."""
    p = pairs.select("user_id", "item_id").withColumn(
        "_h", hash_int(key("order", seed, "@user_id", "@item_id")))
    return global_position(p, ["_h", "user_id", "item_id"], "position").drop("_h")


# ---- dedupe, digest, lists ---------------------------------------------------

def dedupe_ratings(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row per (user, item): the last rating by the total order.

    The max of struct(order..., rating) is the last row (ties on the order
    fall to the higher rating); it is a partial aggregate, so a pair
    repeated many times is combined map-side before the shuffle. (Measured
    faster than ``max_by`` with a struct ordering.) The rating is moved
    once if the order names it.
    """
    order = order or LAST_WINS_ORDER
    last = [*order] if "rating" in order else [*order, "rating"]
    key_ = F.struct(*[F.col(c).alias(f"_o{j}") for j, c in enumerate(last)])
    return (df.groupBy("user_id", "item_id")
              .agg(F.max(key_).getField(f"_o{last.index('rating')}").alias("rating")))


def pair_digest(df: DataFrame) -> DataFrame:
    """md5 of "user item", the key of the original rating lookup map."""
    return df.withColumn("digest", F.md5(F.concat_ws(" ", F.col("user_id").cast("string"),
                                                      F.col("item_id").cast("string"))))


def user_items(df: DataFrame, chunk_size: int = 4096,
               rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(user_id, chunk, items): each user's sorted item list in chunks.

    A user's items are cut into runs of at most ``chunk_size`` items, so a
    user holding a third of all ratings becomes many bounded rows rather
    than one unbounded array. The ratings are shuffled once (``chunks``).
    """
    return chunked(df.select("user_id", "item_id"), F.col("item_id"), chunk_size,
                   rows_per_range).withColumnRenamed("cells", "items")


def user_rows(df: DataFrame, chunk_size: int = 4096,
              rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(user_id, chunk, indices, values): sparse rating rows by item id.

    Same chunking as ``user_items``; the chunks of a user add up to the row.
    """
    g = chunked(df.select("user_id", "item_id", "rating"), F.struct("item_id", "rating"),
                chunk_size, rows_per_range)
    return g.select("user_id", "chunk",
                    F.transform("cells", lambda c: c["item_id"]).alias("indices"),
                    F.transform("cells", lambda c: c["rating"]).alias("values"))


def to_sparse_vectors(rows: DataFrame, dictionary: DataFrame, size: int) -> DataFrame:
    """``user_rows`` as sparse vectors: ``features(size, indices, values)``, the
    fields of an ``ml.linalg`` sparse vector.

    ``dictionary(item_id, index)`` gives dense positions 0..size-1 (the dense
    ids of ``encode_items`` serve). A user whose row was cut into chunks gets
    one vector per chunk; they have no position in common and add up to the
    user's row. Built by JVM functions: no Python per row.
    """
    cells = rows.select(*[c for c in rows.columns if c not in ("indices", "values")],
                        F.explode(F.arrays_zip("indices", "values")).alias("c"))
    keys = [c for c in cells.columns if c != "c"]
    placed = (cells.withColumn("item_id", F.col("c.indices"))
              .join(dictionary.select("item_id", "index"), "item_id")
              .groupBy(*keys).agg(F.sort_array(F.collect_list(
                  F.struct(F.col("index").cast("int").alias("i"),
                           F.col("c.values").alias("v")))).alias("p")))
    return placed.select(*keys, F.struct(
        F.lit(int(size)).alias("size"), F.transform("p", lambda x: x["i"]).alias("indices"),
        F.transform("p", lambda x: x["v"]).alias("values")).alias("features"))


def encode_items(df: DataFrame, col: str = "isbn", out: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """Dense integer ids for string item keys, in key order.

    Returns (encoded ratings, dictionary). The dictionary is built with a
    range-partitioned sort, not collected to the driver.
    """
    keys = df.select(col).distinct()
    dictionary = global_position(keys, [col], out)
    return df.join(dictionary, col), dictionary


# ---- aggregates ---------------------------------------------------------

def distinct_entities(df: DataFrame) -> DataFrame:
    users = df.select(F.lit("user").alias("kind"), F.col("user_id").alias("id")).distinct()
    items = df.select(F.lit("item").alias("kind"), F.col("item_id").alias("id")).distinct()
    return users.unionByName(items)


def dataset_summary(df: DataFrame, seed: int = DEFAULT_SEED) -> DataFrame:
    flag = split_flag(seed)
    return df.agg(
        F.count(F.lit(1)).alias("n_ratings"),
        F.countDistinct("user_id").alias("n_users"),
        F.countDistinct("item_id").alias("n_items"),
        F.sum(F.when(flag, 1).otherwise(0)).cast("long").alias("n_train"),
        F.sum(F.when(flag, 0).otherwise(1)).cast("long").alias("n_test"))


def global_mean(df: DataFrame, col: str = "rating") -> DataFrame:
    return df.agg(F.avg(col).alias("mean"), F.floor(F.avg(col)).cast("double").alias("floor_mean"))


def first_n_users(df: DataFrame, n: int) -> DataFrame:
    """The n smallest user ids (top-k: a limit is the feature here)."""
    return df.select("user_id").distinct().orderBy("user_id").limit(n)
