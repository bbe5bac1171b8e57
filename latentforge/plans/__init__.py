"""Model plans: factor arithmetic, SGD, ALS, linear SVM, evaluation, tuning."""

from .factors import (SgdParams, flat_factors, gradient_step, init_factors, init_model,
                      prediction, sgd_deltas)
from .grid import fit_sgd_grid
from .sgd import (SgdModel, choose_blocks, fit_sgd, prepare, sampled_pairs, trace_frame,
                  update_counts)

__all__ = ["SgdParams", "SgdModel", "init_factors", "init_model", "prediction",
           "sgd_deltas", "gradient_step", "flat_factors", "fit_sgd", "fit_sgd_grid", "sampled_pairs",
           "trace_frame", "choose_blocks", "prepare", "update_counts"]
