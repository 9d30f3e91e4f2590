"""Operators for building training data: tokenising, filtering, deduplication, archives.

Nothing outside this subpackage imports it.  Functions that run in Python
workers are pickled by value, so executors need only the third-party libraries.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
