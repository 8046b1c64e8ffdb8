"""Spark-native retail analytics: cleaning, marts, quality checks, loading, streams.

Functions that run inside Python workers are pickled by value, so executors
need no copy of this package on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
