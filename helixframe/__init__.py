"""Labelled, keyed variant tables on Spark: clean, enrich, profile, split, train, evaluate."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run inside Python workers travel by value, so that executors need no installed
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
