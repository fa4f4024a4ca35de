"""Operators for training-data corpora. Functions of this subpackage travel to executors by value: nothing is installed there."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
