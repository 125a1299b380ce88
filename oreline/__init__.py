"""Spark-first analytics over source-code corpora and Git object graphs."""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

# Functions that run in Python workers travel by value: executors then need no
# installed copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
