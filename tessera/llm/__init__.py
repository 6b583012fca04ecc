"""Operators that prepare training text at corpus scale. Nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# executors get these functions with the task, so the package need not be installed on them
cloudpickle.register_pickle_by_value(sys.modules[__name__])
