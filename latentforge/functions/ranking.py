"""Row positions without a single-task window.

``row_number()`` over an unpartitioned window moves every row into one
task, and one partitioned by a hot key moves that key's rows into one task.
Both helpers here sort with a range exchange instead (a hot group is spread
over many partitions), then add per-partition offsets computed from a
table with one row per partition (or per group and partition).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_PID, _MID, _N, _OFF, _FIRST = "_lf_pid", "_lf_mid", "_lf_n", "_lf_off", "_lf_first"


def _sorted_with_ids(df: DataFrame, order_cols) -> DataFrame:
    s = (df.orderBy(*order_cols)
           .withColumn(_PID, F.spark_partition_id())
           .withColumn(_MID, F.monotonically_increasing_id()))
    # Materialise once so offsets and ids come from the same run.
    return cut_lineage(s)


def global_position(df: DataFrame, order_cols, name: str = "position") -> DataFrame:
    """0-based position of each row in the total order ``order_cols``.

    The order must be total (unique keys) for the result to be defined.
    """
    s = _sorted_with_ids(df, order_cols)
    counts = s.groupBy(_PID).agg(F.count(F.lit(1)).alias(_N),
                                 F.min(_MID).alias(_FIRST))
    before = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition: its size is bounded by the partition count.
    offsets = counts.select(_PID, _FIRST,
                            F.coalesce(F.sum(_N).over(before), F.lit(0)).alias(_OFF))
    out = s.join(F.broadcast(offsets), _PID).withColumn(
        name, (F.col(_OFF) + F.col(_MID) - F.col(_FIRST)).cast("long"))
    return out.drop(_PID, _MID, _OFF, _FIRST)


def group_position(df: DataFrame, group_cols, order_cols,
                   name: str = "position") -> DataFrame:
    """0-based position inside each group, ordered by ``order_cols``.

    A group holding a third of all rows is split over many sort partitions;
    the offsets table has at most one row per (group, partition), so no
    task ever holds more than one partition of rows.
    """
    group_cols = list(group_cols)
    s = _sorted_with_ids(df, [*group_cols, *order_cols])
    counts = s.groupBy(*group_cols, _PID).agg(F.count(F.lit(1)).alias(_N),
                                              F.min(_MID).alias(_FIRST))
    before = (Window.partitionBy(*group_cols).orderBy(_PID)
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*group_cols, _PID, _FIRST,
                            F.coalesce(F.sum(_N).over(before), F.lit(0)).alias(_OFF))
    out = s.join(offsets, [*group_cols, _PID]).withColumn(
        name, (F.col(_OFF) + F.col(_MID) - F.col(_FIRST)).cast("long"))
    return out.drop(_PID, _MID, _OFF, _FIRST)


def prefix_sums(df: DataFrame, order_cols, value_cols, suffix: str = "_before") -> DataFrame:
    """Sum of each value column over all rows strictly before, in a total order.

    Range-sorted; the running sum inside a partition is a window over one
    partition's rows, and the partition totals come from a table with one
    row per partition.
    """
    s = _sorted_with_ids(df, order_cols)
    totals = s.groupBy(_PID).agg(*[F.sum(c).alias(f"_lf_t_{c}") for c in value_cols])
    before = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(_PID, *[F.coalesce(F.sum(f"_lf_t_{c}").over(before), F.lit(0))
                                    .alias(f"_lf_o_{c}") for c in value_cols])
    inside = (Window.partitionBy(_PID).orderBy(_MID)
              .rowsBetween(Window.unboundedPreceding, -1))
    out = s.join(F.broadcast(offsets), _PID)
    for c in value_cols:
        out = out.withColumn(c + suffix, F.col(f"_lf_o_{c}") +
                             F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return out.drop(_PID, _MID, *[f"_lf_o_{c}" for c in value_cols])
