"""Forecast-statement analytics as plain Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

# functions sent to executors travel with their code, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
