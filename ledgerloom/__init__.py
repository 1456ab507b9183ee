"""Ledgerloom: report-library analytics as PySpark DataFrame operators.

Every operator takes and returns DataFrames. Nothing runs until the caller triggers an
action, except where a docstring says that a bounded size check is made up front.
"""

__version__ = "0.1.0"
