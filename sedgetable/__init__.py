"""Sedgetable: literal-table rescue and review on Spark DataFrames.

Values stay literal strings. A derived value is a new column with an outcome
column beside it, keys are compared as recorded, and an ambiguous match is
reported instead of resolved.
"""

from sedgetable.core import SRC, WIDTH, data_columns, literalise, unpivot_cells

__all__ = ["SRC", "WIDTH", "data_columns", "literalise", "unpivot_cells"]
