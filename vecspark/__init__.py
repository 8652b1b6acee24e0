"""Nearest-neighbour search and clustering of vectors on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run inside Python workers travel by value, so executors need
# no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
