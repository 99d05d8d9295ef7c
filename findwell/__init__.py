"""findwell: hybrid document retrieval and corpus processing as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package run in Python workers that needn't have it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
