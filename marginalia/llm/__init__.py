"""Operators of a training-data pipeline: one module per operator, nothing else in the library imports them.

Python functions that run in tasks are shipped by value, so executors need no copy of this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
