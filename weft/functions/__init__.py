"""Column functions beyond Spark's own."""

from weft.functions.keys import components, fold_xor

__all__ = ["components", "fold_xor"]
