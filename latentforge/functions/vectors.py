"""Dense-vector arithmetic on ``array<double>`` columns.

All of these are Catalyst higher-order functions, so they run inside the
JVM (whole-stage codegen where Spark supports it) and never call Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0),
                       lambda acc, v: acc + v)


def elementwise(k: int, fn) -> Column:
    """array(fn(0), ..., fn(k-1)) for a known length k.

    Used instead of a lambda whenever the element expression refers to
    other columns of the row: explicit elements keep every column
    reference visible to the analyser (also across self-joins) and give
    whole-stage codegen straight-line code.
    """
    return F.array(*[fn(j) for j in range(k)])


def at(a: Column, j: int) -> Column:
    return F.element_at(a, j + 1)


def sgd_feature_step(own: Column, other: Column, err: Column, lr: Column,
                     lam: Column, k: int, train_dims: int | None = None) -> Column:
    """own + lr * (err * other - lam * own); dims >= train_dims stay put."""
    def step(j):
        o = at(own, j)
        if train_dims is not None and j >= train_dims:
            return o
        return o + lr * (err * at(other, j) - lam * o)
    return elementwise(k, step)
