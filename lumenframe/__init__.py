"""Spark-native analytics over images, buffers and text corpora.

The package is pickled by value, so functions that run in Python workers need
no copy of it on the executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
