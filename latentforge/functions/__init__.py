"""Column-expression helpers: hashing, vector arithmetic, positions."""

from .hashing import (hash_bucket, hash_gaussian, hash_int, hash_uniform, key,
                      sql_hash_bucket, sql_hash_gaussian, sql_hash_int,
                      sql_hash_uniform, sql_key, sql_lit)
from .ranking import global_position, group_position
from .vectors import at, dot, elementwise, sgd_feature_step

__all__ = [
    "key", "hash_int", "hash_uniform", "hash_bucket", "hash_gaussian",
    "sql_key", "sql_lit", "sql_hash_int", "sql_hash_uniform", "sql_hash_bucket",
    "sql_hash_gaussian", "global_position", "group_position", "dot",
    "sgd_feature_step", "elementwise", "at",
]
