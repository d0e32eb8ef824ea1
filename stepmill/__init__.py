"""Trajectory analytics and training-data operators as Spark DataFrame plans.

Functions that run in Python workers are shipped by value, so executors need only PySpark and the
third-party packages, not a copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
