"""A PySpark-native engine for pipelines, tree queries and graph models."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors whole, so that these need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
