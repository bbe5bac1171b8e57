"""Deterministic pseudo-random numbers as plain column expressions.

Every random choice in the library (split, permutation, initial factors,
sampling, block labels) is a function of a key string, so a run is
reproducible on any partitioning and the same numbers can be produced by
an SQL engine for checking. The SQL twins below are written in DuckDB's
dialect and are used only by the oracle queries.

Fixed values: a key is the parts joined by ':'; the uniform number uses the
first 7 hex digits of md5(key), i.e. 28 bits, divided by 2**28.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_SEP = ":"
HEX_DIGITS = 7
SCALE = float(1 << (4 * HEX_DIGITS))  # 268435456.0


def _as_col(x) -> Column:
    if isinstance(x, Column):
        return x.cast("string")
    if isinstance(x, str) and x.startswith("@"):
        return F.col(x[1:]).cast("string")
    return F.lit(str(x))


def key(*parts) -> Column:
    """Key string; a part written "@name" is a column, anything else a literal."""
    return F.concat_ws(KEY_SEP, *[_as_col(p) for p in parts])


def hash_int(k: Column) -> Column:
    """28-bit non-negative integer from md5 of a key."""
    return F.conv(F.substring(F.md5(k), 1, HEX_DIGITS), 16, 10).cast("long")


def hash_uniform(k: Column) -> Column:
    """Uniform in [0, 1)."""
    return hash_int(k).cast("double") / F.lit(SCALE)


def hash_bucket(k: Column, n: int | Column) -> Column:
    return F.pmod(hash_int(k), n if isinstance(n, Column) else F.lit(n))


def hash_gaussian(k: Column) -> Column:
    """Standard normal by Box-Muller over two uniforms of the key."""
    u1 = F.lit(1.0) - hash_uniform(F.concat_ws(KEY_SEP, k, F.lit("a")))
    u2 = hash_uniform(F.concat_ws(KEY_SEP, k, F.lit("b")))
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


# ---- SQL twins (DuckDB) --------------------------------------------------

def sql_key(*parts) -> str:
    """Parts: SQL expressions given as str; literals wrapped with sql_lit."""
    return "concat_ws('" + KEY_SEP + "', " + ", ".join(
        f"CAST({p} AS VARCHAR)" for p in parts) + ")"


def sql_lit(v) -> str:
    return "'" + str(v).replace("'", "''") + "'"


def sql_hash_int(k: str) -> str:
    return f"CAST(('0x' || substr(md5({k}), 1, {HEX_DIGITS})) AS BIGINT)"


def sql_hash_uniform(k: str) -> str:
    return f"(CAST({sql_hash_int(k)} AS DOUBLE) / {SCALE!r})"


def sql_hash_bucket(k: str, n) -> str:
    return f"({sql_hash_int(k)} % {n})"


def sql_hash_gaussian(k: str) -> str:
    u1 = f"(1.0 - {sql_hash_uniform(f'concat_ws({sql_lit(KEY_SEP)}, {k}, {sql_lit("a")})')})"
    u2 = sql_hash_uniform(f"concat_ws({sql_lit(KEY_SEP)}, {k}, {sql_lit('b')})")
    return f"(sqrt(-2.0 * ln({u1})) * cos({2.0 * math.pi!r} * {u2}))"
