"""Spark-native preparation, analysis and evaluation of time-series and panel data."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors carry this package's code with them: workers need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
