"""quantloom: a Spark-native engine for quantitative time-series research."""

import sys

from pyspark import cloudpickle

# Functions handed to executors travel by value: workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
