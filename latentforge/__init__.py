"""latentforge: rating prediction on Spark DataFrames.

Sources read rating / item / book-rating files and the given tables;
operators clean, de-duplicate, split and reshape them; plans learn latent
factors (block-stratified SGD, ALS) and evaluate them.
"""

__version__ = "0.1.0"
