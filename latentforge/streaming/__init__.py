"""Structured Streaming entry points for the existing operators.

The original programs have no streams; nothing here adds an operator. A
folder of ``user::item::rating::ts`` files can be read as a stream with
the same schema and bad-line handling as the batch source, scored against
a trained (static) factor model by a stream-static join, and reduced to a
running RMSE.
"""

from .scoring import read_rating_stream, running_rmse, score_stream

__all__ = ["read_rating_stream", "score_stream", "running_rmse"]
