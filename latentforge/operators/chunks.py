"""Sorted per-user lists in chunks of fixed positions, without a global sort.

A user's list is cut at every ``chunk_size``-th position, so the chunks are those
of ``row_number()`` over the user's items. Users of ordinary size are grouped and
sliced as a whole. A user beyond ``rows_per_range`` is first cut into ranges of
item ids, which are quantiles of the distinct items of all such users: a range
has about ``rows_per_range`` distinct items, so that is the bound of a (user,
range) group whoever the user is. Counts per (user, range) say at which position
a range begins, which fixes the limits of its chunks before anything is sorted.
Every rating is shuffled once, by (user, range); of the lists only the two chunks
that a range shares with its neighbours are shuffled again.

The input is read up to four times (counts, cut points, lists), two columns of it
except for the lists: a caller stores it first when it is not cheap to read.
Pairs are distinct, as ``dedupe_ratings`` leaves them (the bound of a group rests
on that, the result does not).
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import join_per_id

#: ratings of a user up to which one group holds the user's list
ROWS_PER_RANGE = 1 << 18
#: long and flag in a hash relation, roughly
HOT_ROW_BYTES = 48

_RANGE, _HOT, _OFF, _N = "_lf_range", "_lf_hot", "_lf_off", "_lf_n"


def item_cuts(items: DataFrame, rows_per_range: int) -> list[float]:
    """Limits between ranges of about ``rows_per_range`` of the distinct
    ``items(item_id)``: 8 bytes for as many items reach the driver."""
    n = items.count()
    parts = math.ceil(n / rows_per_range)
    if parts < 2:
        return []
    got = items.agg(F.percentile_approx(
        F.col("item_id").cast("double"), [j / parts for j in range(1, parts)],
        max(10000, 10 * parts)).alias("cuts")).first()["cuts"]
    return sorted(set(got))


def _slices(lists: DataFrame, chunk_size: int) -> DataFrame:
    """``(user_id, chunk, part, n, cells)``: the lists, cut where chunks end.
    ``lists`` has the position ``_OFF`` at which a list begins."""
    size = F.lit(chunk_size)
    first = (F.col(_OFF) / size).cast("long")
    last = ((F.col(_OFF) + F.size("cells") - 1) / size).cast("long")
    named = lists.withColumn("_lf_chunk", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.lit(0).cast("long"), F.col("_lf_chunk") * size - F.col(_OFF)).cast("int")
    hi = F.least(F.size("cells").cast("long"),
                 (F.col("_lf_chunk") + 1) * size - F.col(_OFF)).cast("int")
    return named.select("user_id", F.col("_lf_chunk").alias("chunk"), _RANGE, _OFF, _N,
                        F.slice("cells", lo + 1, hi - lo).alias("cells"))


def chunked(df: DataFrame, cell: Column, chunk_size: int,
            rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(user_id, chunk, cells): the sorted ``cell`` values of each user of
    ``df(user_id, item_id, ...)``, at most ``chunk_size`` in a row. ``cell`` sorts
    as ``item_id`` does."""
    per_user = df.groupBy("user_id").agg(F.count(F.lit(1)).alias(_N))
    hot = per_user.where(F.col(_N) > F.lit(rows_per_range)).select("user_id", F.lit(True).alias(_HOT))
    n_hot = hot.count()

    def marked():   # own column instances for every use
        return join_per_id(df, hot, "user_id", n_small=n_hot, row_bytes=HOT_ROW_BYTES, how="left")

    cuts = item_cuts(marked().where(_HOT).select("item_id").distinct(),
                     rows_per_range) if n_hot else []
    whole = F.lit(0).cast("long")
    if not cuts:
        lists = df.groupBy("user_id").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
        return _slices(lists.select("user_id", "cells", whole.alias(_RANGE), whole.alias(_OFF),
                                    F.size("cells").cast("long").alias(_N)),
                       chunk_size).select("user_id", "chunk", "cells")
    ranges = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_lf_item",
                        outputCol="_lf_bucket", handleInvalid="keep")

    def ranged():
        placed = ranges.transform(marked().withColumn("_lf_item", F.col("item_id").cast("double")))
        return placed.withColumn(_RANGE, F.when(
            F.col(_HOT) & F.col("item_id").isNotNull(), F.col("_lf_bucket").cast("long"))
            .otherwise(whole))

    # where each range of a hot user begins: a row per (hot user, range)
    counts = (ranged().where(_HOT).groupBy("user_id", _RANGE)
              .agg(F.count(F.lit(1)).alias("_lf_here")))
    of_user = Window.partitionBy("user_id")
    upto = of_user.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("user_id", _RANGE,
                           F.coalesce(F.sum("_lf_here").over(upto), whole).alias(_OFF),
                           F.sum("_lf_here").over(of_user).alias(_N))
    lists = ranged().groupBy("user_id", _RANGE).agg(
        F.sort_array(F.collect_list(cell)).alias("cells"))
    lists = (lists.join(starts, ["user_id", _RANGE], "left")
             .withColumn(_OFF, F.coalesce(_OFF, whole))
             .withColumn(_N, F.coalesce(_N, F.size("cells").cast("long"))))
    slices = _slices(lists, chunk_size)
    size = F.lit(chunk_size)
    full = F.size("cells") == F.least(size, F.col(_N) - F.col("chunk") * size)
    borders = (slices.where(~full).groupBy("user_id", "chunk").agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct(_RANGE, "cells"))), lambda x: x["cells"]))
        .alias("cells")))
    return slices.where(full).select("user_id", "chunk", "cells").unionByName(borders)
