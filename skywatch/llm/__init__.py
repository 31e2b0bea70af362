"""Operators of a training-data pipeline: one module each, their queries in ``queries.py``."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value: workers need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
