"""Training-data operators: dedup, packing, token output, classifiers, mixing.

Nothing outside this subpackage imports it.
"""
