"""Operators for training-data preparation.

Python workers get this subpackage's functions by value, so that executors need
no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
