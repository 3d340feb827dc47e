"""tidegrain: page-to-evidence analytics on Spark DataFrames.

The core holds the table sources, column functions, relational operators,
query plans and streaming folds.  The optional subpackage ``llm`` holds the
operators for training-data pipelines; nothing in the core imports it.
"""

__version__ = "0.1.0"
