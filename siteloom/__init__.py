"""Spark-native web-content ingest, indexing and batch retrieval."""

import sys

from pyspark import cloudpickle

# Helpers used inside tasks travel by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
