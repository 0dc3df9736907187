"""Embedding-based anomaly scoring and governed evaluation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks are sent by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
