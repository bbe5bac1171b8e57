"""Sources: table views, rating / item / book files, planted data, text."""

from .files import (read_book_ratings, read_items, read_ratings, read_ratings_raw,
                    reject_reasons, split_rejects)
from .synth import planted_factors, synth_ratings
from .tables import book_view, items_view, ratings_view, table, text_lines
from .text import count_lines, read_lines

__all__ = [
    "table", "ratings_view", "items_view", "book_view", "text_lines",
    "read_ratings", "read_ratings_raw", "read_items", "read_book_ratings",
    "split_rejects", "reject_reasons", "planted_factors", "synth_ratings",
    "read_lines", "count_lines",
]
