"""Conversational-corpus analytics as lazy Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in Python workers travel by value, so the
# workers need no copy of the repository on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
