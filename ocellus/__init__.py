"""ocellus: perception analytics on Spark.

Operators take and return DataFrames. Nothing here imports :mod:`ocellus.llm`; that subpackage is optional.
"""

__version__ = "0.1.0"
