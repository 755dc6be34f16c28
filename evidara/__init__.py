"""PySpark-native analytics over document evidence and event trajectories."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
