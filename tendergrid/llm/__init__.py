"""Operators for preparing training text; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Executors need not have this package: what a task runs travels with the task.
# Broadcast values are pickled plainly, so they hold built-in types and arrays only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
