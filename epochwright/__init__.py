"""Epoch analytics on Spark: labelled epochs, features, splits, models and agreement metrics."""

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers travel with their code, so executors need
# no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
