"""A PySpark-native engine for card-transaction analytics and training-data preparation."""

import sys

from pyspark import cloudpickle

# Functions that tasks run travel with the tasks, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
