"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so that executors need this package's dependencies only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
