"""Joins of rating rows to per-id tables (factors, items).

When the caller knows the row count of the per-id table (one row per user
or item), it is broadcast only if that count times the row width fits a
byte budget. Beyond the budget the join is a shuffle join in which the
rating side is salted: each id of the small side is replicated into
``salt`` copies and each rating picks one copy by hash, so an item holding
a third of all ratings is spread over ``salt`` tasks instead of one. The
result is exact (one partner per rating).

When the count is not known, no extra job is run to get it: the join is
left to adaptive execution, which broadcasts a side measured to be small and
splits skewed partitions of the rating side. Spark can only split when each
side comes straight from its shuffle, so the per-id table has to be a stored
one (written with ``session.write_table``, or a model's factors), not an
aggregate in the same plan; the registered queries store theirs.

Two such joins in a row shuffle the ratings twice, the second time with a
vector in every row. If the caller knows the sizes of all three tables
(``sizes``) and neither factor table is small, ``join_factors`` cuts users
and items into blocks instead: a rating goes once, without a vector, to the
cell of its two blocks, and a factor row to each cell of its block. The
cells hold about ``CELL_BYTES`` of joined rows each.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Default broadcast budget and salt fan-out.
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024
DEFAULT_SALT = 16
_SALT = "_lf_salt"
# The grid of blocks: joined bytes of a cell, and bytes of a factor table
# below which Spark's own choice (a broadcast) is left alone.
CELL_BYTES = 256 * 1024 * 1024
GRID_MIN_BYTES = 16 * 1024 * 1024
_CELL, _SIDE, _ID, _U, _I = "_lf_cell", "_lf_side", "_lf_id", "_lf_u", "_lf_i"
_USER, _ITEM, _RATING = 0, 1, 2


def factor_row_bytes(k: int) -> int:
    """Rough in-memory size of (id, bias, array<double>[k]) in a hash relation."""
    return 8 + 8 + 16 + 8 * k + 32


def join_per_id(big: DataFrame, small: DataFrame, on: str, *, n_small: int | None,
                row_bytes: int, how: str = "inner",
                broadcast_bytes: int = DEFAULT_BROADCAST_BYTES,
                salt: int = DEFAULT_SALT, salt_cols: list[str] | None = None) -> DataFrame:
    """Join ``big`` to ``small`` (unique on ``on``), size-checked.

    ``n_small`` is the known row count of ``small`` (the caller counts it
    once, e.g. on a cached factor table); ``None`` leaves the choice to
    adaptive execution.
    """
    if n_small is None:
        return big.join(small, on, how)
    if n_small * row_bytes <= broadcast_bytes:
        return big.join(F.broadcast(small), on, how)
    salt_cols = salt_cols or [c for c in big.columns if c != on][:2] or [on]
    salted_big = big.withColumn(
        _SALT, F.pmod(F.xxhash64(*[F.col(c) for c in salt_cols]), F.lit(salt)))
    salted_small = small.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return salted_big.join(salted_small, [on, _SALT], how).drop(_SALT)


def grid_blocks(sizes: tuple[int, int, int], k: int, *, cell_bytes: int = CELL_BYTES,
                min_bytes: int = GRID_MIN_BYTES) -> int | None:
    """Blocks per side for tables of ``sizes`` rows (ratings, users, items), or
    ``None`` where two plain joins are left: a factor table is small, or its
    copies outnumber the ratings that would carry a vector."""
    n, n_users, n_items = sizes
    if min(n_users, n_items) * factor_row_bytes(k) <= min_bytes:
        return None
    blocks = math.ceil(math.sqrt(n * 2 * factor_row_bytes(k) / cell_bytes))
    return max(1, blocks) if (n_users + n_items) * max(1, blocks) < n else None


def grid_join(ratings: DataFrame, user_f: DataFrame, item_f: DataFrame, blocks: int,
              how: str = "inner") -> DataFrame:
    """``join_factors`` by ``blocks`` x ``blocks`` cells, one shuffle of the ratings.

    In a cell the rows are sorted by user and then by item, so that a factor
    row comes just before its ratings and is carried on to them; sorts and
    windows can spill, so an id with many ratings needs no memory of its own.
    Factor tables are unique on ``id``; a null id has no partner.
    """
    rest = [c for c in ratings.columns if c not in ("user_id", "item_id")]
    every = F.sequence(F.lit(0), F.lit(blocks - 1))

    def block(c):
        return F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")

    def cell(ublk, iblk):
        return (ublk * F.lit(blocks) + iblk).alias(_CELL)

    def factors(f, side, name, place):
        f = f.where(F.col("id").isNotNull()).select("id", F.struct("bias", "factors").alias(name))
        return (f.withColumn("_at", F.explode(every))
                 .select(place(block(F.col("id")), F.col("_at")), F.lit(side).alias(_SIDE),
                         F.col("id").alias(_ID), name))

    rows = ratings.select("item_id", *rest,
                          cell(block(F.col("user_id")), block(F.col("item_id"))),
                          F.lit(_RATING).alias(_SIDE), F.col("user_id").alias(_ID))
    users = factors(user_f, _USER, _U, cell)
    items = factors(item_f, _ITEM, _I, lambda own, other: cell(other, own))
    # More partitions than cells: few of them hold two.
    placed = (rows.unionByName(users, allowMissingColumns=True)
                  .unionByName(items, allowMissingColumns=True)
                  .repartition(8 * blocks * blocks, _CELL))

    def carry(df, side, name):
        before = (Window.partitionBy(_ID, _CELL, F.col(_SIDE) == F.lit(_ITEM - side))
                  .orderBy(_SIDE).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        out = (df.withColumn(name, F.first(name, ignorenulls=True).over(before))
                 .where(F.col(_SIDE) != F.lit(side)))
        if how == "inner":
            out = out.where((F.col(_SIDE) != F.lit(_RATING)) | F.col(name).isNotNull())
        return out

    # the other table's rows, which may have the same ids, are a group of their own
    met = carry(placed, _USER, _U).withColumn("user_id", F.col(_ID)).withColumn(
        _ID, F.when(F.col(_SIDE) == F.lit(_RATING), F.col("item_id")).otherwise(F.col(_ID)))
    met = carry(met, _ITEM, _I)
    return met.select("item_id", "user_id", *rest,
                      F.col(_U)["bias"].alias("bu"), F.col(_U)["factors"].alias("fu"),
                      F.col(_I)["bias"].alias("bi"), F.col(_I)["factors"].alias("fi"))


def join_factors(ratings: DataFrame, user_f: DataFrame, item_f: DataFrame, k: int, *,
                 n_users: int | None = None, n_items: int | None = None,
                 sizes: tuple[int, int, int] | None = None,
                 how: str = "inner", broadcast_bytes: int = DEFAULT_BROADCAST_BYTES,
                 salt: int = DEFAULT_SALT) -> DataFrame:
    """ratings ⋈ user factors ⋈ item factors.

    Factor tables are (id, bias, factors); output adds ``bu, fu, bi, fi``.
    ``sizes`` are the rows of the three tables, a rough figure for the ratings:
    the result does not depend on them, only the way it is computed.
    """
    blocks = grid_blocks(sizes, k) if sizes else None
    if blocks:
        return grid_join(ratings, user_f, item_f, blocks, how)
    u = user_f.select(F.col("id").alias("user_id"), F.col("bias").alias("bu"),
                      F.col("factors").alias("fu"))
    i = item_f.select(F.col("id").alias("item_id"), F.col("bias").alias("bi"),
                      F.col("factors").alias("fi"))
    rb = factor_row_bytes(k)
    j = join_per_id(ratings, u, "user_id", n_small=n_users, row_bytes=rb, how=how,
                    broadcast_bytes=broadcast_bytes, salt=salt,
                    salt_cols=["user_id", "item_id"])
    return join_per_id(j, i, "item_id", n_small=n_items, row_bytes=rb, how=how,
                       broadcast_bytes=broadcast_bytes, salt=salt,
                       salt_cols=["user_id", "item_id"])


def false_positives(predictions: DataFrame, items: DataFrame, *, max_rating: float = 1.0,
                    min_prediction: float = 4.0, n: int = 100) -> tuple[DataFrame, DataFrame]:
    """Low true rating, high prediction: (count, first ``n`` with titles).

    The filter runs before the join (Catalyst pushes it below), so only the
    few false positives meet the item table.
    """
    fp = predictions.where((F.col("rating") <= F.lit(max_rating)) &
                           (F.col("prediction") >= F.lit(min_prediction)))
    listed = (fp.join(items.select("item_id", "title"), "item_id")
                .select("user_id", "item_id", "title", "rating", "prediction"))
    count = fp.agg(F.count(F.lit(1)).alias("n_false_positives"))
    top = listed.orderBy(F.col("prediction").desc(), "user_id", "item_id").limit(n)
    return count, top
