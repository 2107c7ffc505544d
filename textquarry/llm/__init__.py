"""Training-data operators.

Functions of this package travel to executors by value, so tasks run where the package is not installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
