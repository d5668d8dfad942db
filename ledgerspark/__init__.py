"""ledgerspark: versioned, log-structured data as DataFrames.

Operators are functions from DataFrames and parameters to DataFrames. Catalyst plans every one of them; Python runs
only where a result depends on order (folds) or on bytes (codecs), and then on Arrow batches.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions go to the executors by value: they need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
