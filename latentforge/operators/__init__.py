"""Relational operators: cleaning, splitting, ordering, reshaping, joins."""

from .joins import false_positives, join_factors, join_per_id
from .prep import (dataset_summary, dedupe_ratings, distinct_entities, encode_items,
                   explicit_ratings, first_n_users, global_mean, interaction_order,
                   pair_digest, pair_lookup, random_split, split_counts, split_flag,
                   to_sparse_vectors, train_test_split, user_items, user_permutation,
                   user_rating_stats, user_ratings, user_rows)

__all__ = [
    "explicit_ratings", "user_ratings", "user_rating_stats", "pair_lookup", "split_flag",
    "train_test_split", "random_split", "split_counts", "user_permutation",
    "interaction_order", "dedupe_ratings", "pair_digest", "user_items", "user_rows",
    "to_sparse_vectors", "encode_items", "distinct_entities", "dataset_summary",
    "global_mean", "first_n_users", "join_factors", "join_per_id", "false_positives",
]
