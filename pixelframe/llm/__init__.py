"""Operators of a training-data pipeline. Nothing else in the package imports this subpackage."""

import sys

from pyspark import cloudpickle

# Workers need no copy of the package on their path: functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
