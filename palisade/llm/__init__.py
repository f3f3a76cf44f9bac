"""Operators for training-data pipelines. Functions sent to executors carry this package's code with them."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
