"""tracewright: a Spark-native engine for semi-structured logs and text.

Every operator is a function from DataFrames (or Columns) to a DataFrame (or
Column); nothing runs until the caller acts on the result.  The subpackage
``llm`` holds the text-corpus operators and is not imported from here.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package travel to the executors by value, so that it need
# not be installed there.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
