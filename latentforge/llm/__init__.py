"""Training-data operators: language modelling, quality, language id,
de-duplication, packing, token encoding and licence scans.

Every operator is a function over DataFrames; the modules are named after
what they do, ``queries.py`` registers one query per operator and holds the
SQL twins. The rest of the library does not import this subpackage.
"""
